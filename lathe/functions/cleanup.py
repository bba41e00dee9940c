"""Text rules that need a callback within a regex (T4, T5, T10, T11), as Arrow functions over a column."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions import text as T

# First parts of compounds that keep their hyphen.
COMPOUND_PREFIXES = frozenset("self well non pre post co re anti semi multi inter intra cross over under out up all ex half mid sub super ultra vice".split())

# Letter-spaced runs, words broken at line ends, words with inner hyphens.
_SPACED = re.compile(r"(?<![a-zA-Z])(?:[A-Za-z] ){3,}[A-Za-z](?:  (?:[A-Za-z] ){2,}[A-Za-z])*(?![a-zA-Z])")
_BROKEN = re.compile(r"(\w{2,})-\s*\n\s*(\w{2,})(?!-)")
_INLINE = re.compile(r"(\w{2,})-([a-z]\w+)(?!-)")


#: Texts that a worker holds as Python strings at once, of the 10,000 that Spark sends it in a batch.
SLICE = 256


def _slices(*arrays: pa.Array) -> Iterator[tuple[list, ...]]:
    for at in range(0, len(arrays[0]), SLICE):
        yield tuple(a.slice(at, SLICE).to_pylist() for a in arrays)


def _map(f: Callable[[str], object], kind: pa.DataType, ddl: str) -> Callable[[Column], Column]:
    def each(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            for (texts,) in _slices(array):
                yield pa.array([None if t is None else f(t) for t in texts], kind)

    return lambda c: F.arrow_udf(each, ddl)(c)


def close_letters(text: str, min_length: int = 4) -> str:
    """T4: letter-spaced words closed up; two blanks separate words; words of fewer letters stay spaced."""

    def word(part: str) -> str:
        letters = part.strip().split(" ")
        return "".join(letters) if len(letters) >= min_length and all(len(x) == 1 and x.isalpha() for x in letters) else part.strip()

    return _SPACED.sub(lambda m: " ".join(word(p) for p in m[0].split("  ")), text)


def join_hyphens(text: str, dictionary: frozenset[str] | None = None) -> str:
    """T5: hyphenated words joined, across lines and then within; not before a capital, after a compound prefix, nor to a word outside the dictionary, if one is given."""

    def join(m: re.Match) -> str:
        left, right = m.groups()
        apart = right[0].isupper() or left.lower() in COMPOUND_PREFIXES or bool(dictionary) and (left + right).lower() not in dictionary
        return m[0] if apart else left + right

    return _INLINE.sub(join, _BROKEN.sub(join, text))


def close_lettertracks(c: Column, min_length: int = 4) -> Column:
    return _map(lambda t: close_letters(t, min_length), pa.string(), "string")(c)


def rejoin_hyphens(c: Column, dictionary: frozenset[str] | None = None) -> Column:
    return _map(lambda t: join_hyphens(t, dictionary), pa.string(), "string")(c)


@dataclass(frozen=True)
class Cleanup:
    """Which steps run, in this order."""

    lettertracks: bool = True
    hyphens: bool = True
    block_spacing: bool = True
    markdown_artifacts: bool = True
    whitespace: bool = True
    is_markdown: bool = False
    min_lettertrack: int = 4
    dictionary: frozenset[str] | None = None


def clean(c: Column, options: Cleanup = Cleanup()) -> Column:
    """The configured cleanup of a text column."""
    if options.lettertracks and options.hyphens:  # one pass through Python
        c = _map(lambda t: join_hyphens(close_letters(t, options.min_lettertrack), options.dictionary), pa.string(), "string")(c)
    elif options.lettertracks:
        c = close_lettertracks(c, options.min_lettertrack)
    elif options.hyphens:
        c = rejoin_hyphens(c, options.dictionary)
    if options.block_spacing:
        c = T.space_blocks(c)
    if options.markdown_artifacts and options.is_markdown:
        c = T.fix_markdown(c)
    if options.whitespace:
        c = T.normalize_whitespace(c)
    return c


_HEADING, _IMAGE = re.compile(r"(#{1,6})\s+(.+)$"), re.compile(r"!\[([^\]]*)\]\(([^)]+)\)\s*$")
_BULLET, _NUMBER, _RULE = re.compile(r"(\s*)[-*+]\s+(.+)$"), re.compile(r"(\s*)\d+\.\s+(.+)$"), re.compile(r"(-{3,}|_{3,}|\*{3,})\s*$")
#: What ends a paragraph; a heading or item counts here even without a text.
_BREAK = re.compile(r"\s*$|#{1,6}\s+|```|!\[|\s*[-*+]\s+|\s*\d+\.\s+|(?:-{3,}|_{3,}|\*{3,})\s*$|>")
BLOCK = pa.struct([("block_type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("raw", pa.string())])


def markdown_blocks(text: str) -> list[dict]:
    """Typed blocks of a Markdown text."""
    lines, out, i = text.split("\n"), [], 0

    def add(kind: str, shown: str, raw: str, level: int | None = None) -> None:
        out.append({"block_type": kind, "level": level, "text": shown, "raw": raw})

    while i < len(lines):
        line, start = lines[i], i
        i += 1
        if m := _HEADING.match(line):
            add("heading", m[2].strip(), line, len(m[1]))
        elif line.startswith("```"):
            while i < len(lines) and not lines[i].startswith("```"):
                i += 1
            i = min(i + 1, len(lines))
            add("code", "\n".join(lines[start + 1 : i - 1]), "\n".join(lines[start:i]))
        elif m := _IMAGE.match(line):
            add("image", m[1], line)
        elif m := _BULLET.match(line):
            add("list_item", m[2].strip(), line, len(m[1]) // 2 + 1)
        elif m := _NUMBER.match(line):
            add("ordered_list_item", m[2].strip(), line, len(m[1]) // 2 + 1)
        elif _RULE.match(line):
            add("horizontal_rule", "", line)
        elif line.startswith(">"):
            while i < len(lines) and lines[i].startswith(">"):
                i += 1
            add("blockquote", "\n".join(x.lstrip("> ") for x in lines[start:i]), "\n".join(lines[start:i]))
        elif line.strip() and not _BREAK.match(line):
            while i < len(lines) and not _BREAK.match(lines[i]):
                i += 1
            add("paragraph", "\n".join(lines[start:i]), "\n".join(lines[start:i]))
    return out


def blocks(c: Column) -> Column:
    """Array of (block_type, level, text, raw); explode with ``posexplode``."""
    return _map(markdown_blocks, pa.list_(BLOCK), "array<struct<block_type:string,level:int,text:string,raw:string>>")(c)


def _clean_plain(text: str) -> str:
    return join_hyphens(close_letters(text))


def clean_json(text: str, fix: Callable[[str], str] = _clean_plain) -> str:
    """The texts of a JSON payload cleaned: of pages' blocks' lines' spans, else of blocks, else every ``text`` at any depth."""
    data = json.loads(text)

    def at(node, *path):
        if not path:
            if isinstance(node, dict) and isinstance(node.get("text"), str):
                node["text"] = fix(node["text"])
        elif isinstance(node, dict):
            for child in node.get(path[0]) or []:
                at(child, *path[1:])

    def every(node):
        for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else []:
            every(child)
        at(node)

    if isinstance(data, dict) and "pages" in data:
        at(data, "pages", "blocks", "lines", "spans")
    elif isinstance(data, dict) and "blocks" in data:
        at(data, "blocks")
    else:
        every(data)
    return json.dumps(data, ensure_ascii=False)


def clean_xml(text: str, fix: Callable[[str], str] = _clean_plain) -> str:
    """The texts of an XML payload cleaned: of ``span``, else of ``text`` elements, else of all."""
    root = ET.fromstring(text)
    found = list(root.iter("span")) or list(root.iter("text")) or list(root.iter())
    for node in found:
        if node.text:
            node.text = fix(node.text)
    return ET.tostring(root, encoding="unicode")


def clean_payload(kind: Column, c: Column) -> Column:
    """A payload cleaned by its file extension; one that does not parse stays as it is."""

    def tried(f: Callable[[str], str]) -> Callable[[str], str]:
        def one(t: str) -> str:
            try:
                return f(t)
            except (ValueError, ET.ParseError):
                return t

        return one

    def each(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        by = {"json": tried(clean_json), "xml": tried(clean_xml)}
        for batch in arrays:
            for kinds, texts in _slices(*batch):
                yield pa.array([None if t is None else by.get(k, _clean_plain)(t) for k, t in zip(kinds, texts)], pa.string())

    return F.arrow_udf(each, "string")(kind, c)
