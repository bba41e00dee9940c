"""Line deduplication by pairwise alignment.

A *block* is a run of consecutive lines with ``BLOCK_WORDS`` words or more; blank lines
do not count and go with the lines around them. Lines are keyed by the hash of the line
together with as many following (or preceding) ones as make up a block, so that a key
is a shortest block and every longer one is covered by such keys.

Documents that share a rare key, one with at most ``RARE`` holders, are paired, all
with all. A key with more holders pairs each of them with its earliest one, so the
number of pairs stays below ``RARE`` times that of keys. Each pair is aligned by
patience diff over all keys that pair it, and the aligned blocks are deleted from the
later document.

What a pair's alignment leaves stays, unless another pair aligns it: of two blocks
that crossed, the shorter one, and what stands more often in the later document than
in the earlier. Of a key with many holders, a pair without its earliest one could have
aligned what the pairs with it do not; the README has the share.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import as_bytes, checkpoint, keyed, salted_join, saved

#: Words that a block must have to be deleted.
BLOCK_WORDS = 10
#: A key with at most so many holders is rare: 15 pairs at most for six rows.
RARE = 6


def line_hashes(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line, without outer blanks; blank lines have hash 0."""
    lines = (text or b"").split(b"\n")
    words = np.fromiter((len(x.split()) for x in lines), np.int32, len(lines))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x.strip()) if w else 0 for x, w in zip(lines, words)), np.uint64, len(lines))
    return hashes.view(np.int64), words


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (by first) whose seconds increase."""
    tops: list[int] = []
    heads: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(heads[at - 1] if at else -1)
        tops[at : at + 1] = [j]
        heads[at : at + 1] = [n]
    out, n = [], heads[-1] if heads else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _once(keys: Sequence[int], lo: int, hi: int) -> dict[int, int]:
    """The place of each key that stands once in a part of ``keys``."""
    counts = Counter(keys[lo:hi])
    return {keys[i]: i for i in range(lo, hi) if counts[keys[i]] == 1}


def _counted(keys: Sequence[int], lo: int, hi: int) -> dict[tuple[int, int], int]:
    """The place of each first, second, … occurrence of a key."""
    seen, out = Counter(), {}
    for i in range(lo, hi):
        out[keys[i], seen[keys[i]]] = i
        seen[keys[i]] += 1
    return out


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned (i, j) with a[i] == b[j], both increasing.

    Keys that stand once in both are anchors, as many as keep their order; then those
    between anchors, and so on. Where none is unique, equal occurrences are anchors.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        for places in (_once, _counted):
            in_a, in_b = places(a, alo, ahi), places(b, blo, bhi)
            anchors = _increasing(sorted((i, in_b[key]) for key, i in in_a.items() if key in in_b))
            if anchors:
                break
        else:
            continue
        ends = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        out += anchors
        todo += [(i0 + 1, i1, j0 + 1, j1) for (i0, j0), (i1, j1) in zip(ends, ends[1:]) if i0 + 1 < i1 and j0 + 1 < j1]
    return sorted(out)


def align(shared: Sequence[tuple[Sequence[int], Sequence[int]]]) -> list[tuple[int, int]]:
    """Spans (first and last line) of the later document that are aligned with the earlier one.

    ``shared`` has for every key of both where it stands in each: the first and last
    line of each of its runs in turn.
    """
    a, b = (sorted((run[k], run[k + 1], n) for n, pair in enumerate(shared) for run in [pair[side]] for k in range(0, len(run), 2)) for side in (0, 1))
    return [b[j][:2] for _, j in patience([n for *_, n in a], [n for *_, n in b])]


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of lines without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def runs(hashes: np.ndarray, words: np.ndarray, least_words: int = BLOCK_WORDS) -> dict[int, list[int]]:
    """For each key the first and last lines of its runs: the shortest ones with ``least_words`` words from each line on, and up to each.

    A run has no more lines with words than it needs words, whatever the number of blank lines.
    """
    line = np.flatnonzero(words)
    ends = np.concatenate(([0], np.cumsum(words[line], dtype=np.int64)))
    last = np.searchsorted(ends, ends[:-1] + least_words) - 1
    first = np.searchsorted(ends, ends[1:] - least_words, "right") - 1
    spans = {(i, j) for i, j in enumerate(last.tolist()) if j < len(line)} | {(i, j) for j, i in enumerate(first.tolist()) if i >= 0}
    packed, number, out = hashes[line].tobytes(), line.tolist(), {}
    for i, j in sorted(spans):
        out.setdefault(xxhash.xxh64_intdigest(packed[8 * i : 8 * j + 8]), []).extend((number[i], number[j]))
    return out


def _runs(docs: DataFrame) -> DataFrame:
    """id, h, run, at: the key and places of every run of every document."""

    def cut(batches):
        for batch in batches:
            rows = [runs(*line_hashes(t)) for t in as_bytes(batch.column("text"))]
            row = pa.array(np.repeat(np.arange(len(rows)), [len(x) for x in rows]))
            run = np.fromiter((key for x in rows for key in x), np.uint64).view(np.int64)
            at = pa.array([places for x in rows for places in x.values()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("h").take(row), pa.array(run), at], ["id", "h", "run", "at"])

    rows = keyed(docs).select(F.col("_lathe_id").alias("id"), F.col("_lathe_h").alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "id bigint, h bigint, run bigint, at array<int>")


def _pairs(docs: DataFrame) -> DataFrame:
    """id0, h0, at0 and id, h, at: an earlier and a later document that a key pairs, and where it stands in both."""
    every = saved(_runs(docs), "runs")
    doc, place = F.struct("id", "h"), F.struct("id", "h", "at")
    holders = every.groupBy("run").agg(F.min(doc).alias("a"), F.max(doc).alias("z"), F.count("*").alias("n")).where("a <> z").select("run", "a", "n")
    shared = checkpoint(salted_join(every, holders, ["run"], F.col("id"), 4))
    held = shared.where(F.col("n") <= RARE).groupBy("run").agg(F.sort_array(F.collect_set(place)).alias("held"))  # RARE rows at most
    later = lambda x, y: (y.id > x.id) | ((y.id == x.id) & (y.h > x.h))
    pair = lambda x, y: F.struct(x.id.alias("id0"), x.h.alias("h0"), x["at"].alias("at0"), y.id.alias("id"), y.h.alias("h"), y["at"].alias("at"))
    rare = held.select(F.explode(F.flatten(F.transform("held", lambda x: F.transform(F.filter("held", lambda y: later(x, y)), lambda y: pair(x, y))))).alias("p")).select("p.*")
    frequent = shared.where(F.col("n") > RARE)
    of_first = frequent.where(doc == F.col("a")).select("run", F.col("at").alias("at0")).distinct()
    star = salted_join(frequent.where(doc != F.col("a")), of_first, ["run"], F.col("id"), 4)
    return rare.unionByName(star.select(F.col("a.id").alias("id0"), F.col("a.h").alias("h0"), "at0", "id", "h", "at"))


def repeated_blocks(docs: DataFrame) -> DataFrame:
    """id, h (row key) and the sorted numbers of the lines that lie in a block aligned with an earlier document's."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    spans_of = "array<struct<first:int,last:int>>"

    def aligned(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([merged(align([(x["at0"], x["at"]) for x in shared])) for shared in array.to_pylist()], span)

    def united(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([merged([(x["first"], x["last"]) for x in spans]) for spans in array.to_pylist()], span)

    pairs = _pairs(docs).groupBy("id0", "h0", "id", "h").agg(F.collect_list(F.struct("at0", "at")).alias("shared"))
    found = pairs.select("id", "h", F.explode(F.arrow_udf(aligned, spans_of)("shared")).alias("s"))
    spans = found.groupBy("id", "h").agg(F.collect_set("s").alias("spans")).select("id", "h", F.arrow_udf(united, spans_of)("spans").alias("spans"))
    return spans.select("id", "h", F.flatten(F.transform("spans", lambda x: F.sequence(x["first"], x["last"]))).alias("gone"))


def delete_repeated_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` without the blocks of lines that are aligned with an earlier document's, and ``_lathe_gone``, the numbers of the deleted lines (null: none).

    Documents are ordered by doc_id, null last, then by a hash of the text. Lines
    are compared without outer blanks; blank lines go only inside a block, of which they are no part. Every
    row stays, with an empty text if all its lines go; a null text stays null.
    Rows that repeat (doc_id, text) are one document and lose the same lines;
    extra columns are kept.
    """
    return _struck(docs, repeated_blocks(docs))


def _struck(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the lines numbered in ``gone``."""
    gone = gone.select(F.col("id").alias("_lathe_id"), F.col("h").alias("_lathe_h"), F.col("gone").alias("_lathe_gone"))

    def strike(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in arrays:
            out = []
            for text, lines in zip(texts.to_pylist(), gone.to_pylist()):
                if text is not None:
                    lines = set(lines)
                    text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in lines)
                out.append(text)
            yield pa.array(out, pa.string())

    joined = keyed(docs).join(gone, ["_lathe_id", "_lathe_h"], "left")
    hit = F.col("_lathe_gone").isNotNull()
    struck = F.arrow_udf(strike, "string")(F.when(hit, F.col("text").cast("string")), "_lathe_gone")
    return joined.withColumn("text", F.when(hit, struck).otherwise(F.col("text"))).select(*docs.columns, "_lathe_gone")
