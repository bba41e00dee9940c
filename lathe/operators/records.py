"""Model replies and message lists to rows (P5-P13), and record checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.text import document_uid, extraction_method, skill_uid, strip, strip_fences, task_uid, thinking, without_thinking

QUERY_TYPES = ["YES_NO", "YES_NO_VERIFICATION", "SINGLE_WORD", "RANKING", "FREE_FORM"]
PRIMITIVES = ["observe", "distinguish", "enumerate", "compare", "select", "apply"]

#: Canonical name -> names that it may have, the first present wins.
TASK_ALIASES = {"task_uid": ["task_uid", "task_id", "problem_id"], "input": ["input", "passage"], "question": ["question", "challenge"]}
SKILL_ALIASES = {"skill_uid": ["skill_uid", "skill_id"], "source_task_uids": ["source_task_uids", "source_task_ids"]}
EPISODE_ALIASES = {"task_uid": ["task_uid", "task_id", "problem_id"], "passed": ["passed", "pass"]}


def canonical(df: DataFrame, aliases: Mapping[str, Sequence[str]], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Aliased columns merged under their canonical name; an empty string is a value, only null falls through; nulls then get defaults."""
    for name, names in aliases.items():
        have = [c for c in names if c in df.columns]
        if have:
            merged = F.coalesce(*have)
            df = df.withColumn("_merged", merged).drop(*have).withColumnRenamed("_merged", name)
    for name, value in (defaults or {}).items():
        fill = F.array().cast("array<string>") if value == [] else F.lit(value)
        df = df.withColumn(name, F.coalesce(name, fill) if name in df.columns else fill)
    return df


#: Required fields (aliases by ``|``) and optional ones with their JSON types.
SCHEMAS: dict[str, dict[str, str]] = {
    "task": {"task_uid|task_id": "string", "title": "string", "domain": "string", "question|challenge": "string", "input|passage": "string"},
    "trace": {"task_uid|task_id": "string", "procedural_steps": "array", "conclusion": "string"},
    "skill": {"skill_uid|skill_id": "string", "name": "string", "procedure": "array"},
    "verified_skill": {"skill_uid|skill_id": "string", "name": "string", "procedure": "array", "is_valid": "boolean", "defects": "array"},
}


def schema_errors(json: Column, entity: str) -> Column:
    """Messages of missing fields and wrong types of a JSON object, in the order of the entity's fields."""
    kinds = {"string": "STRING", "array": "ARRAY", "boolean": "BOOLEAN"}
    out = []
    whole = F.try_parse_json(json)
    for field, kind in SCHEMAS[entity].items():
        names = field.split("|")
        values = [F.try_variant_get(whole, f"$.{n}", "variant") for n in names]
        seen = F.coalesce(*[F.schema_of_variant(v) for v in values])
        right = F.startswith(seen, F.lit(kinds[kind]))
        out.append(F.when(seen.isNull(), F.lit(f"{entity} missing required field '{names[0]}'")).when(~right, F.concat(F.lit(f"{entity}.{names[0]}: expected {kind}, got "), F.lower(F.regexp_extract(seen, r"^(\w+)", 1)))))
    errors = F.filter(F.array(*out), lambda e: e.isNotNull())
    return F.when(whole.isNull(), F.array(F.lit(f"{entity} is not a JSON object"))).otherwise(errors)


def several_answers(output: Column, query_type: Column) -> Column:
    """Why a FREE_FORM answer is not a single one; null if it is."""
    text = F.coalesce(output, F.lit(""))
    marks = F.when(text.contains(" OR "), " OR ").when(text.contains(" / "), " / ").when(text.contains(" | "), " | ")
    return F.when(query_type != "FREE_FORM", F.lit(None)).when(strip(text) == "", "empty output").otherwise(F.when(marks.isNotNull(), F.concat(F.lit("several answers: '"), marks, F.lit("'"))))


def _blank(c: str) -> Column:
    return strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def incomplete_task() -> Column:
    """First blank field of a task, else null."""
    out = F.lit(None).cast("string")
    for c in ("query_type", "output", "input", "question", "task_uid"):
        out = F.when(_blank(c), c).otherwise(out)
    return out


def incomplete_trace() -> Column:
    return F.when(_blank("task_uid"), "task_uid").when(F.coalesce(F.size("procedural_steps"), F.lit(0)) <= 0, "procedural_steps")


def incomplete_skill() -> Column:
    return F.when(_blank("skill_uid"), "skill_uid").when(_blank("name"), "name").when(F.coalesce(F.size("procedure"), F.lit(0)) <= 0, "procedure")


def _objects(body: Column) -> Column:
    """JSON text of a list's objects, or of the one object, as an array; null for broken JSON."""
    whole = F.try_parse_json(body)
    text = F.when(F.startswith(F.schema_of_variant(whole), F.lit("ARRAY")), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return F.when(whole.isNull(), F.lit(None)).otherwise(F.from_json(text, "array<string>"))


def parse_tasks(replies: DataFrame) -> DataFrame:
    """Rows of reply, domain, source_artifact and model -> the tasks of each reply; broken JSON gives none.

    Defaults go by position; question and challenge, input and passage are
    aliases, the newer name after the older; an unknown query type is FREE_FORM.
    """
    rows = replies.select("domain", "source_artifact", "model", F.posexplode(_objects(strip_fences(F.col("reply")))).alias("i", "o"))
    get = lambda name: F.get_json_object("o", f"$.{name}")
    kind = F.upper(F.coalesce(get("query_type"), F.lit("FREE_FORM")))
    index = F.col("i").cast("string")
    return rows.select(
        task_uid(F.col("domain"), F.coalesce(get("title"), F.concat(F.lit("task-"), index)), F.col("i")).alias("task_uid"),
        F.coalesce(get("title"), F.concat(F.lit("Untitled task "), index)).alias("title"), "domain", "source_artifact", document_uid(F.col("source_artifact")).alias("source_document_uid"),
        F.coalesce(get("challenge"), get("question"), F.lit("")).alias("question"), F.coalesce(get("passage"), get("input"), F.lit("")).alias("input"),
        F.coalesce(get("acceptance_criteria.correct_conclusion"), get("output"), F.lit("")).alias("output"), F.coalesce(get("difficulty"), F.lit("intermediate")).alias("difficulty"),
        F.when(kind.isin(QUERY_TYPES), kind).otherwise("FREE_FORM").alias("query_type"), extraction_method(F.col("model"), "task-extraction").alias("extraction_method"),
        F.struct(F.from_json(get("acceptance_criteria.must_identify"), "array<string>").alias("must_identify"), get("acceptance_criteria.correct_conclusion").alias("correct_conclusion")).alias("acceptance_criteria"),
    )


def _as_object(text: Column) -> Column:
    """The JSON object in a reply: the fenced text, else from the first ``{`` to the last ``}``; null without one."""
    body = strip_fences(text)
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    is_object = lambda c: F.startswith(F.schema_of_variant(F.try_parse_json(c)), F.lit("OBJECT"))
    return F.when(F.coalesce(is_object(body), F.lit(False)), body).when(F.try_parse_json(body).isNull() & F.coalesce(is_object(inner), F.lit(False)), inner)


def _steps(o: Column) -> Column:
    items = F.coalesce(F.from_json(F.get_json_object(o, "$.steps"), "array<string>"), F.array().cast("array<string>"))
    get = lambda x, f: strip(F.coalesce(F.get_json_object(x, f"$.{f}"), F.lit("")))
    shown = lambda x: F.when(~x.startswith("{"), x).when(F.lower(get(x, "primitive")).isin(PRIMITIVES) & (get(x, "action") != ""), F.concat(F.upper(get(x, "primitive")), F.lit(": "), get(x, "action"))).otherwise(F.nullif(get(x, "action"), F.lit("")))
    return F.filter(F.transform(items, shown), lambda s: s.isNotNull())


CONCLUSION = r"(?i)^(conclusion:|in conclusion|therefore:|answer:)"


def parse_trace(reply: Column) -> Column:
    """Struct of thinking, procedural_steps and conclusion of a reply.

    JSON steps are ``PRIMITIVE: action`` for the six primitives and bare actions
    otherwise. Without steps, lines are taken: those with a conclusion mark give the
    conclusion, the last one winning, else the last line does; at most ten lines are
    steps, or the first 500 characters if no line is left.
    """
    text = without_thinking(reply)
    o = _as_object(text)
    steps = _steps(o)
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    marked, plain = F.filter(lines, lambda x: x.rlike(CONCLUSION)), F.filter(lines, lambda x: ~x.rlike(CONCLUSION))
    last = F.try_element_at(marked, F.lit(-1))
    said = F.coalesce(F.when(last.contains(":"), strip(F.regexp_replace(last, r"^[^:]*:", ""))).otherwise(last), F.lit(""))
    guess = (said == "") & (F.size(plain) > 0)
    rest = F.when(guess, F.slice(plain, F.lit(1), F.greatest(F.size(plain) - 1, F.lit(0)))).otherwise(plain)
    free = F.when(F.size(rest) > 0, F.slice(rest, 1, 10)).otherwise(F.array(F.substring(text, 1, 500)))
    good = F.coalesce(F.size(steps) > 0, F.lit(False)) & o.isNotNull()
    return F.struct(
        thinking(reply).alias("thinking"), F.when(good, steps).otherwise(free).alias("procedural_steps"),
        F.when(good, strip(F.coalesce(F.get_json_object(o, "$.conclusion"), F.lit("")))).otherwise(F.when(guess, F.element_at(plain, -1)).otherwise(said)).alias("conclusion"),
    )


def raw_steps(reply: Column) -> Column:
    """The steps of a JSON reply as (primitive, action), before normalisation."""
    items = F.filter(F.coalesce(F.from_json(F.get_json_object(_as_object(reply), "$.steps"), "array<string>"), F.array().cast("array<string>")), lambda x: x.startswith("{"))
    get = lambda x, f: strip(F.coalesce(F.get_json_object(x, f"$.{f}"), F.lit("")))
    return F.transform(items, lambda x: F.struct(F.lower(get(x, "primitive")).alias("primitive"), get(x, "action").alias("action")))


def key_messages(messages: DataFrame) -> DataFrame:
    """P8 over a long table (conv_id, turn, role, text): first non-empty system and user text, last assistant text, empty without one."""
    said = lambda role, keep_empty=False: (F.col("role") == role) & (F.lit(True) if keep_empty else F.coalesce(F.col("text"), F.lit("")) != "")
    first = lambda role: F.coalesce(F.min_by(F.when(said(role), F.col("text")), F.when(said(role), F.col("turn"))), F.lit(""))
    last = F.coalesce(F.max_by(F.when(said("assistant", True), F.col("text")), F.when(said("assistant", True), F.col("turn"))), F.lit(""))
    return messages.groupBy("conv_id").agg(first("system").alias("system_prompt"), first("user").alias("user_prompt"), last.alias("response"))


def key_messages_of(messages: Column) -> Column:
    """P8 over an array of (role, content)."""
    pick = lambda role, at, some: F.coalesce(F.try_element_at(F.filter(messages, lambda m: (m.role == role) & ((F.coalesce(m.content, F.lit("")) != "") if some else F.lit(True))), F.lit(at)).content, F.lit(""))
    return F.struct(pick("system", 1, True).alias("system_prompt"), pick("user", 1, True).alias("user_prompt"), pick("assistant", -1, False).alias("response"))


def import_episodes(episodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Harness episodes with the response of their steps (file, episode_id, step, text), joined by line ends in order; of its messages without steps."""
    said = steps.where(F.coalesce("text", F.lit("")) != "").groupBy("file", "episode_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "text"))), lambda x: x.text), "\n").alias("_steps"))
    key = key_messages_of(F.col("messages"))
    out = episodes.join(said, ["file", "episode_id"], "left").withColumn("_k", key)
    response = F.coalesce("_steps", F.col("_k.response"))
    return out.withColumn("system_prompt", F.col("_k.system_prompt")).withColumn("user_prompt", F.col("_k.user_prompt")).withColumn("response", response).withColumn("trace", parse_trace(response)).drop("_steps", "_k")


STEP_LINE = r"(?i)^(OBSERVE|DISTINGUISH|ENUMERATE|COMPARE|SELECT|APPLY|CONCLUDE):"


def parse_step(reply: Column) -> Column:
    """P10: one reasoning step of a reply: all of a ``CONCLUDE:`` text, else its first marked line, else its first line if the text is under 300 characters, else empty."""
    text = strip(without_thinking(reply))
    lines = F.transform(F.split(text, "\n"), strip)
    marked = F.get(F.filter(lines, lambda x: x.rlike(STEP_LINE)), F.lit(0))
    return F.when(text.rlike("(?i)^CONCLUDE:"), text).otherwise(F.coalesce(marked, F.when(F.length(text) < 300, lines[0]), F.lit("")))


def parse_skills(replies: DataFrame) -> DataFrame:
    """Rows of reply and model -> the skills of each reply, with ids from their sorted sources and name."""
    rows = replies.select("model", F.posexplode(_objects(strip_fences(F.col("reply")))).alias("i", "o"))
    get = lambda name: F.get_json_object("o", f"$.{name}")
    items = lambda *names: F.coalesce(*[F.from_json(get(n), "array<string>") for n in names], F.array().cast("array<string>"))
    name, sources = F.coalesce(get("name"), F.lit("unnamed-skill")), items("source_task_ids", "source_task_uids")
    return rows.select(
        skill_uid(sources, name).alias("skill_uid"), name.alias("name"), F.coalesce(get("description"), F.lit("")).alias("description"), items("procedure").alias("procedure"),
        F.coalesce(get("when_to_use"), F.lit("")).alias("when_to_use"), items("constraints").alias("constraints"), sources.alias("source_task_uids"), extraction_method(F.col("model"), "skill-extraction").alias("extraction_method"),
    )


# P5: prompts. The instruction texts are parameters; what is rendered from rows is here.


def trace_prompt(passage: Column, challenge: Column) -> Column:
    return F.concat(F.lit("## Passage\n\n"), passage, F.lit("\n\n## Challenge\n\n"), challenge)


def trace_summary(index: Column, task: Column, challenge: Column, steps: Column, conclusion: Column) -> Column:
    """One trace in the skill-extraction prompt, with its texts cut to 500 and 300 characters."""
    numbered = F.transform(steps, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.substring(s, 1, 300), F.lit("\n")))
    return F.concat(F.lit("### Trace "), index.cast("string"), F.lit(" (Task: "), task, F.lit(")\nChallenge: "), F.substring(challenge, 1, 500), F.lit("\nProcedural actions taken:\n"), F.array_join(numbered, ""), F.lit("Conclusion reached: "), F.substring(conclusion, 1, 300), F.lit("\n"))


def skill_prompts(traces: DataFrame, group: str, template: str = "{traces}") -> DataFrame:
    """One prompt per ``group`` of traces (task_uid, user_prompt, procedural_steps, conclusion, ord) in order."""
    cut = F.struct("ord", "task_uid", F.substring("user_prompt", 1, 500).alias("user_prompt"), F.transform("procedural_steps", lambda s: F.substring(s, 1, 300)).alias("procedural_steps"), F.substring("conclusion", 1, 300).alias("conclusion"))
    items = F.sort_array(F.collect_list(cut))  # cut first: whole texts are not gathered
    texts = F.transform("_t", lambda t, i: trace_summary(i + 1, t.task_uid, t.user_prompt, t.procedural_steps, t.conclusion))
    head, tail = template.split("{traces}", 1)
    return traces.groupBy(group).agg(items.alias("_t")).select(group, F.concat(F.lit(head), F.array_join(texts, "\n"), F.lit(tail)).alias("prompt"))


def criteria_text(must_identify: Column) -> Column:
    """The judge prompt's list of criteria."""
    return F.when(F.coalesce(F.size(must_identify), F.lit(0)) <= 0, "(none specified)").otherwise(F.array_join(F.transform(must_identify, lambda x: F.concat(F.lit("- "), x)), "\n"))


def render_template(template: str, **columns: Column) -> Column:
    """``{name}`` places of a template filled from columns; any of the prompts with its own instruction text."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else columns[p] for i, p in enumerate(parts)])
