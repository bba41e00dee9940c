"""License scans by ordered signature rules.

The rules are hand-written regexes (``license_rules``): names, sentences of license
texts and notices, and addresses; and SPDX tags, whose expressions are taken apart.
An Aho-Corasick automaton over the rules' keywords reads a text once; only rules all
of whose keywords occur are run. Of the detections, taken by priority, then length,
then position, one that lies inside the interval of an accepted detection is
suppressed. Phrase rules (the *base*) find the plain-word phrases that are always
reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import PLAIN, as_bytes
from lathe.llm.license_rules import ADDRESSES, NAMES, TEXTS

#: Phrase -> label; places where the words stand consecutively.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    confidence: float


class Detection(NamedTuple):
    label: str
    start: int
    end: int
    confidence: float


#: A few non-word bytes between the parts of a name.
GAP = "[^0-9a-z\\x80-\\xff]+"
EDGE_L, EDGE_R = "(?<![0-9a-z\\x80-\\xff])", "(?![0-9a-z\\x80-\\xff])"
TAG, GRANT, TEXT, NAME = 90, 80, 70, 50
#: Labels whose names may go with "only" or "or later".
VERSIONED = re.compile(r"(?:gpl|lgpl|agpl|gfdl)-[\d.]+")
SUFFIX = f"(?:(?P<only>{GAP}only)|(?P<later>\\+|{GAP}(?:or|and){GAP}(?:at{GAP}your{GAP}option{GAP})?(?:any{GAP})?(?:later|newer|above|higher)(?:{GAP}versions?)?))?"
#: What makes a name a grant, right before it.
GRANTED = re.compile(
    rf"{EDGE_L}(?:licensed|released|distributed|published|available|provided|covered|governed){GAP}(?:under|by){GAP}(?:the{GAP})?(?:terms{GAP}(?:and{GAP}conditions{GAP})?of{GAP})?(?:the{GAP}|an?{GAP})?$".encode("latin-1")
)
#: Bytes before a name in which its grant may stand.
REACH = 120
#: Labels of names that are common words as well.
UNSURE = frozenset("proprietary public-domain ruby unlicense fair json curl vim bsd".split())
#: Words that many names share; as gates they come last.
COMMON = frozenset("license public general software version free open source copyright the and under terms use for this any http org".split())


def in_bytes(form: str) -> str:
    """The form with its blanks as gaps."""
    return form.replace(" ?", "[^0-9a-z]{0,2}").replace(" ", GAP)


def keywords(form: str) -> tuple[str, ...]:
    """Up to three words that every text with the form must hold, the least common first."""
    fixed = re.sub(r"\(\?:[^()]*(?:\([^()]*\)\??[^()]*)*\)\??|\\.|\w\?|\[.*?\]\??|\w*\.\{.*?\}\??", " ", form)
    words = dict.fromkeys(re.findall(r"[a-z0-9]{3,}", fixed) or re.findall(r"[a-z0-9]+", fixed))
    return tuple(sorted(words, key=lambda w: (w in COMMON, -len(w)))[:3])


def _pattern(form: str) -> re.Pattern:
    return re.compile(form.encode("latin-1"), re.S)


def build_rules() -> list[Rule]:
    """The rules in order: names, texts, addresses."""
    rules = []
    for label, form in NAMES:
        suffix = SUFFIX if VERSIONED.fullmatch(label) else ""
        rules.append(Rule(label, _pattern(EDGE_L + in_bytes(form) + suffix + EDGE_R), keywords(form), NAME, 0.6 if label in UNSURE else 0.8))
    for label, form in TEXTS:
        rules.append(Rule(label, _pattern(EDGE_L + in_bytes(form) + EDGE_R), keywords(form), TEXT, 0.9))
    for label, form in ADDRESSES:
        rules.append(Rule(label, _pattern(form + EDGE_R), keywords(form), TEXT, 1.0))
    return rules


SPDX = re.compile(rb"spdx-license-identifier[ \t]*:([^\r\n]*)")
_TOKEN = re.compile(rb"[ \t(]*([a-z0-9][a-z0-9.+-]*)[ \t)]*")
KNOWN = {label for label, _ in NAMES + TEXTS + ADDRESSES} | {f"{label}-{x}" for label, _ in NAMES if VERSIONED.fullmatch(label) for x in ("only", "or-later")}


def spdx_operands(expression: bytes) -> list[tuple[str, int, int]]:
    """(label, start, end) of the known licenses and exceptions of an SPDX expression: operands joined by AND, OR and WITH."""
    out, at = [], 0
    while m := _TOKEN.match(expression, at):
        name = m[1].decode()
        label = name[:-1] + "-or-later" if name.endswith("+") else name
        if label in KNOWN:
            out.append((label, *m.span(1)))
        joint = _TOKEN.match(expression, m.end())
        if not joint or joint[1] not in (b"and", b"or", b"with"):
            break
        at = joint.end()
    return out


def _phrase(phrase: str) -> re.Pattern:
    return _pattern(EDGE_L + GAP.join(phrase.split()) + EDGE_R)


FOUND = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
    ("detections", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))),
])
FOUND_DDL = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>,labels:array<string>,score:double,detections:array<struct<label:string,start:bigint,end:bigint,confidence:double>>>"

_WORD_BYTE = np.frombuffer(PLAIN, np.uint8) != 32


class Scanner:
    """Scans lower-cased texts; made once per worker."""

    def __init__(self):
        self.rules = build_rules()
        self.phrases = [(_phrase(p), p.split()[0].encode(), p.split()[-1].encode(), label) for p, label in BASE.items()]
        self.by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            self.by_keyword.setdefault(rule.keywords[0], []).append(i)
        self.gate = ahocorasick.Automaton()
        for word in {w for rule in self.rules for w in rule.keywords}:
            self.gate.add_word(word, word)
        self.gate.make_automaton()

    def hits(self, low: bytes, rules: list[Rule]) -> list[tuple[tuple, Detection]]:
        """All detections of ``rules`` and of SPDX tags, with what orders them."""
        out = []
        for m in SPDX.finditer(low):
            for label, start, end in spdx_operands(m[1]):
                out.append((TAG, Detection(label, m.start(1) + start, m.start(1) + end, 1.0)))
        for rule in rules:
            for m in rule.pattern.finditer(low):
                named, start = m.groupdict(), m.start()
                label = rule.label + ("-only" if named.get("only") else "-or-later" if named.get("later") else "")
                grant = GRANTED.search(low, max(0, start - REACH), start) if rule.priority == NAME else None
                if grant:
                    out.append((GRANT, Detection(label, grant.start(), m.end(), 0.95)))
                else:
                    out.append((rule.priority, Detection(label, start, m.end(), rule.confidence)))
        return [((-priority, d.start - d.end, d.start, -d.confidence, d.label), d) for priority, d in out]

    def gated(self, low: bytes) -> list[Rule]:
        """The rules all of whose keywords occur."""
        present = {word for _, word in self.gate.iter(low.decode("latin-1"))}
        return [self.rules[i] for word in present for i in self.by_keyword.get(word, ()) if present.issuperset(self.rules[i].keywords)]

    def detect(self, low: bytes) -> list[Detection]:
        """Detections that are not suppressed, in order of acceptance; of equal intervals the first by confidence, then label."""
        kept: list[Detection] = []
        starts: list[int] = []  # of accepted intervals that lie in no other; their ends ascend too
        ends: list[int] = []
        for _, d in sorted(self.hits(low, self.gated(low))):
            at = bisect_right(starts, d.start)
            if at and ends[at - 1] >= d.end:
                continue
            kept.append(d)
            lo = bisect_left(starts, d.start)
            hi = bisect_right(ends, d.end, lo)
            starts[lo:hi], ends[lo:hi] = [d.start], [d.end]
        return kept

    def scan(self, text: bytes | None) -> dict:
        low = (text or b"").lower()
        mask = _WORD_BYTE[np.frombuffer(low, np.uint8)]
        begins = mask.copy()
        begins[1:] &= ~mask[:-1]
        base, places = set(), []
        for pattern, head, tail, label in self.phrases:
            if tail in low and head in low:
                at = [m.start() for m in pattern.finditer(low)]
                if at:
                    base.add(label)
                    places += at
        kept = self.detect(low)
        starts = np.searchsorted(np.flatnonzero(begins), places) if places else []
        confidences = [d.confidence for d in kept] + [0.8] * bool(base)
        # offsets are of UTF-8 bytes while scanning, of characters in the result
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(low, np.uint8) & 0xC0) != 0x80)]) if kept else None
        return {
            "n_words": int(begins.sum()), "n_base": len(places),
            "first_word": int(min(starts)) if places else None, "last_word": int(max(starts)) if places else None,
            "base_labels": sorted(base), "labels": sorted(base | {d.label for d in kept}),
            "score": max(confidences, default=0.0),
            "detections": [{"label": d.label, "start": int(chars[d.start]), "end": int(chars[d.end]), "confidence": d.confidence} for d in sorted(kept, key=lambda d: d[1:])],
        }


def scan_text(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    scanner = Scanner()
    for array in arrays:
        yield pa.array([scanner.scan(t) for t in as_bytes(array)], FOUND)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and the scan of every row's whole text.

    Null and empty texts have no words, no labels and score 0. ``score`` is the
    highest confidence of a detection that is not suppressed. Phrases of the base
    are counted at every place, whatever the rules find. Of rules that find the same
    interval the more confident, then the smaller label stays. Repeated rows each get
    a row; other columns are not read.
    """
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.arrow_udf(scan_text, FOUND_DDL)(text).alias("s")).select("doc_id", "s.*")
