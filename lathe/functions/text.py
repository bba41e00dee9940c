"""Text columns (T1-T16). Patterns are Unicode-aware where the rules are: ``(?U)`` widens \\s, \\w and \\d."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without outer blanks of any kind, line ends included."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def strip_right(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def uid(seed: Column) -> Column:
    """First 16 hex digits of the seed's SHA-256, in groups of four."""
    h = F.sha2(seed, 256)
    return F.concat_ws("-", *[F.substring(h, 1 + 4 * i, 4) for i in range(4)])


def document_uid(artifact: Column) -> Column:
    return uid(F.concat(F.lit("document|"), artifact))


def passage_uid(document: Column, chunk_index: Column, text: Column) -> Column:
    return uid(F.concat_ws("|", document, chunk_index.cast("string"), F.substring(F.sha2(text, 256), 1, 16)))


def task_uid(domain: Column, title: Column, index: Column) -> Column:
    return uid(F.concat_ws("|", domain, title, index.cast("string")))


def skill_uid(source_task_uids: Column, name: Column) -> Column:
    return uid(F.concat(F.array_join(F.array_sort(source_task_uids), "|"), F.lit("|"), name))


def extraction_method(model: Column, operation: Column | str, version: int = 1) -> Column:
    """``{model}-{operation}-v{n}`` without a leading ``claude-``, colons and slashes as hyphens."""
    name = F.translate(F.regexp_replace(model, "^claude-", ""), ":/", "--")
    return F.concat(name, F.lit("-"), F.lit(operation) if isinstance(operation, str) else operation, F.lit(f"-v{version}"))


# Patterns of the cleanup steps and what they put in place, in order.
#: T3
WHITESPACE = [(r"(?md)[ \t]+$", ""), (r"\n{3,}", "\n\n")]
#: T6
BLOCKS = [(r"([a-z])([A-Z])", "$1 $2"), (r"([.!?;:)])([A-Z])", "$1 $2"), (r"(?U)([a-zA-Z])(\d+)([A-Z])", "$1 $2 $3"), (r"(?U)(\d)([A-Z])(?=\s)", "$1 $2")]
#: T7
BOLD = [(r"\*{4}", "** **"), (r"(?U)\*\*\s+\*\*", " ")]
#: T9
PLAIN_TEXT = [
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\*\*\*([^*]+)\*\*\*", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"),
    (r"___([^_]+)___", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"),
    (r"(?Umd)^#{1,6}\s+", ""), (r"```[^\n]*\n?", ""), (r"`([^`]+)`", "$1"),
    (r"(?Umd)^(-{3,}|_{3,}|\*{3,})\s*$", ""), (r"\n{3,}", "\n\n"),
]


def _replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def normalize_whitespace(c: Column) -> Column:
    """No blanks at line ends, at most one empty line in a row, no outer blanks."""
    return strip(_replaced(c, WHITESPACE))


def space_blocks(c: Column) -> Column:
    """Blanks between run-together blocks."""
    return _replaced(c, BLOCKS)


def fix_markdown(c: Column) -> Column:
    """Doubled bold marks."""
    return _replaced(c, BOLD)


def markdown_to_text(c: Column) -> Column:
    """Markdown without its marks."""
    return strip(_replaced(c, PLAIN_TEXT))


def strip_fences(c: Column) -> Column:
    """Without the first line if it opens a code fence, nor a last line that closes it."""
    t = strip(c)
    body = F.when(F.instr(t, "\n") > 0, F.regexp_replace(t, r"\A[^\n]*\n", "")).otherwise("")
    return F.when(t.startswith("```"), strip(F.regexp_replace(body, r"(?U)(\A|\n)\s*```\s*\z", ""))).otherwise(t)


_THINK = r"(?s)<think>(.*?)</think>"


def thinking(c: Column) -> Column:
    """What the first ``<think>`` block holds, without outer blanks; empty without one."""
    return strip(F.regexp_extract(c, _THINK, 1))


def without_thinking(c: Column) -> Column:
    """The text without its first ``<think>`` block and outer blanks; unchanged without one."""
    block = F.regexp_extract(c, _THINK, 0)
    first = F.split(c, _THINK, 2)
    return F.when(block == "", c).otherwise(strip(F.concat(first[0], first[1])))


def message_text(content_json: Column, joiner: str = "", bare_strings: bool = False) -> Column:
    """Text of a message content that is a JSON string or a list of typed blocks; other text is itself.

    Blocks of type ``text`` are joined by ``joiner``; with ``bare_strings`` items that are strings count too.
    """
    items = F.from_json(content_json, "array<string>")
    kind, text = lambda x: F.get_json_object(x, "$.type"), lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))
    plain = lambda x: ~x.startswith("{")
    keep = (lambda x: F.coalesce(kind(x) == "text", F.lit(False)) | plain(x)) if bare_strings else (lambda x: F.coalesce(kind(x) == "text", F.lit(False)))
    joined = F.array_join(F.transform(F.filter(items, keep), lambda x: F.when(plain(x), x).otherwise(text(x))), joiner)
    string = F.from_json(F.concat(F.lit('{"s":'), content_json, F.lit("}")), "s string").s
    return F.when(F.trim(content_json).startswith("["), joined).when(F.trim(content_json).startswith('"'), string).otherwise(content_json)


def sentences(c: Column) -> Column:
    """Sentences without outer blanks, split after ., ! or ? and blanks."""
    return F.filter(F.transform(F.split(c, r"(?U)[.!?]\s+"), strip), lambda s: s != "")


def first_word(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?U)^\s*(\S+)", 1))
