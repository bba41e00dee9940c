"""Skills and tasks as Markdown, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_FRONT = re.compile(r"\A---\n(.*?)\n---\n", re.S)
EXAMPLE = pa.struct([(n, pa.string()) for n in ("title", "input", "process", "output")])
REGISTRY = pa.struct([
    ("name", pa.string()), ("description", pa.string()), ("when_to_use", pa.list_(pa.string())), ("procedure", pa.list_(pa.string())),
    ("constraints", pa.list_(pa.string())), ("related_skills", pa.list_(pa.string())), ("examples", pa.list_(EXAMPLE)), ("error", pa.string()),
])
REGISTRY_DDL = "struct<name:string,description:string,when_to_use:array<string>,procedure:array<string>,constraints:array<string>,related_skills:array<string>,examples:array<struct<title:string,input:string,process:string,output:string>>,error:string>"


def front_matter(content: str) -> tuple[dict[str, str], str]:
    """``key: value`` lines between the first two rules, and what follows them; no front matter gives none."""
    m = _FRONT.match(content)
    if not m:
        return {}, content
    pairs = (line.split(":", 1) for line in m[1].split("\n") if ":" in line and not line.startswith((" ", "-")))
    bare = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    return {k.strip(): bare(v.strip()) for k, v in pairs}, content[m.end() :]


def section(body: str, name: str, level: str = "##") -> str:
    """Text under a heading, up to the next one of the same or a higher level."""
    m = re.search(rf"^{level}\s+{re.escape(name)}\s*$(.*?)(?=^#{{1,{len(level)}}}\s|\Z)", body, re.S | re.M)
    return m[1].strip() if m else ""


def bullets(text: str) -> list[str]:
    return [m.strip() for m in re.findall(r"^[-*]\s+(.+)$", text, re.M)]


def steps(text: str) -> list[str]:
    return [m.strip() for m in re.findall(r"^\d+\.\s+(.+)$", text, re.M)]


def _examples(body: str) -> list[dict]:
    out = []
    for m in re.finditer(r"^###\s+Example\s+\d+:?\s*(.*?)\s*$(.*?)(?=^#{1,3}\s|\Z)", body, re.S | re.M):
        part = lambda name: (re.search(rf"\*\*{name}:\*\*\s*(.*?)(?=\n\*\*\w+:\*\*|\Z)", m[2], re.S) or ["", ""])[1].strip()  # noqa: B023, E731
        out.append({"title": m[1], "input": part("Input"), "process": part("Process"), "output": part("Output")})
    return out


def parse_skill(content: str) -> dict:
    """A registry skill; ``error`` says what makes it invalid."""
    front, body = front_matter(content)
    name, description = front.get("name", ""), front.get("description", "")
    error = "no front matter" if not front else "no name" if not name else None if "Use when" in description else "description without 'Use when'"
    return {
        "name": name, "description": description, "when_to_use": bullets(section(body, "When to Use")), "procedure": steps(section(body, "Procedure")), "constraints": bullets(section(body, "Constraints")),
        "related_skills": [b.split(":", 1)[0].strip().strip("*`") for b in bullets(section(body, "Related Skills"))], "examples": _examples(body), "error": error,
    }


def parse_registry_skill(c: Column) -> Column:
    """Struct of a registry skill's parts."""

    def each(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([None if t is None else parse_skill(t) for t in array.to_pylist()], REGISTRY)

    return F.arrow_udf(each, REGISTRY_DDL)(c)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))


def _list(items: Column, mark: str | None = "- ") -> Column:
    shown = F.transform(items, lambda x, i: F.concat(F.lit(mark) if mark else F.concat((i + 1).cast("string"), F.lit(". ")), x, F.lit("\n")))
    return F.array_join(shown, "")


def render_skill(skill_uid: Column, name: Column, description: Column, when_to_use: Column, procedure: Column, constraints: Column, source_task_uids: Column) -> Column:
    """A skill as Markdown with front matter."""
    return F.concat(
        F.lit("---\nskill_uid: "), skill_uid, F.lit("\nname: "), name, F.lit("\ndescription: "), _quoted(description), F.lit("\n---\n\n## When to Use\n\n"), when_to_use,
        F.lit("\n\n## Procedure\n\n"), _list(procedure, None), F.lit("\n## Constraints\n\n"), _list(constraints), F.lit("\n## Source Tasks\n\n"), _list(source_task_uids),
    )


def render_task(task_uid: Column, title: Column, domain: Column, difficulty: Column, passage: Column, question: Column, output: Column) -> Column:
    """A task as Markdown with front matter."""
    return F.concat(
        F.lit("---\ntask_uid: "), task_uid, F.lit("\ntitle: "), _quoted(title), F.lit("\ndomain: "), domain, F.lit("\ndifficulty: "), difficulty,
        F.lit("\n---\n\n## Passage\n\n"), passage, F.lit("\n\n## Challenge\n\n"), question, F.lit("\n\n## Output\n\n"), output, F.lit("\n"),
    )


SKILL_DDL = "struct<skill_uid:string,name:string,description:string,when_to_use:string,procedure:array<string>,constraints:array<string>,source_task_uids:array<string>>"
TASK_DDL = "struct<task_uid:string,title:string,domain:string,difficulty:string,input:string,question:string,output:string>"


def _skill_back(content: str) -> dict:
    front, body = front_matter(content)
    return {
        "skill_uid": front.get("skill_uid", ""), "name": front.get("name", ""), "description": front.get("description", "").replace('\\"', '"'), "when_to_use": section(body, "When to Use"),
        "procedure": steps(section(body, "Procedure")), "constraints": bullets(section(body, "Constraints")), "source_task_uids": bullets(section(body, "Source Tasks")),
    }


def _task_back(content: str) -> dict:
    front, body = front_matter(content)
    out = {k: front.get(k, "").replace('\\"', '"') for k in ("task_uid", "title", "domain", "difficulty")}
    return out | {"input": section(body, "Passage"), "question": section(body, "Challenge"), "output": section(body, "Output")}


def parse_markdown(c: Column, entity: str) -> Column:
    """The struct of a ``skill`` or ``task`` that was rendered as Markdown."""
    read, ddl = {"skill": (_skill_back, SKILL_DDL), "task": (_task_back, TASK_DDL)}[entity]
    lists = {"procedure", "constraints", "source_task_uids"}
    names = [p.split(":")[0] for p in ddl[7:-1].split(",")]
    kind = pa.struct([(n, pa.list_(pa.string()) if n in lists else pa.string()) for n in names])

    def each(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([None if t is None else read(t) for t in array.to_pylist()], kind)

    return F.arrow_udf(each, ddl)(c)
