"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every window of ``window`` consecutive plain words of a benchmark item is a
pattern (an item of fewer words is one window). Documents are searched as byte
strings of blank-joined plain words, so a pattern with its outer blanks can only
match at word boundaries. A shift table over blocks of the patterns' first ``m``
bytes (``m``: the shortest pattern) skips positions at which no pattern can end;
suffix blocks with shift zero select the patterns to compare directly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import as_bytes, checkpoint, keyed, plain, saved

SPANS = "array<struct<first:bigint,last:bigint>>"
HIT = "struct<n_words:bigint,n_hit:bigint,item_ids:array<bigint>,spans:array<struct<first:bigint,last:bigint>>>"


class WuManber:
    """Finds every occurrence of each of a set of byte strings."""

    def __init__(self, patterns: Iterable[bytes], block: int = 8):
        patterns = list(patterns)
        self.m = min(map(len, patterns))
        self.block = min(block, self.m)
        self.far = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.m + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.far), self.m - end)
            self.buckets[p[self.m - self.block : self.m]].append(p)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        m, block, far, shift = self.m, self.block, self.far, self.shift.get
        pos, n = m, len(text)
        while pos <= n:
            tail = text[pos - block : pos]
            s = shift(tail, far)
            if s:
                pos += s
                continue
            for p in self.buckets[tail]:
                if text.startswith(p, pos - m):
                    yield pos - m, p
            pos += 1


def item_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct (pattern binary, item_id) of all items."""

    def cut(batches):
        for batch in batches:
            ids, out, owners = batch.column("item_id").to_pylist(), [], []
            for item, text in zip(ids, as_bytes(batch.column("text"))):
                words = plain(text).split()
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    out.append(b" " + b" ".join(words[i : i + window]) + b" ")
                    owners.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(owners, pa.int64())], ["pattern", "item_id"])

    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "pattern binary, item_id bigint").distinct()


def matcher(owners: dict[bytes, list[int]], spark) -> Column:
    """Arrow UDF text -> HIT for one block of patterns, which is broadcast."""
    shared = spark.sparkContext.broadcast(owners)

    @F.arrow_udf(HIT)
    def match(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        owners, by_words = shared.value, defaultdict(list)
        for p in owners:
            by_words[p.count(b" ") - 1].append(p)  # short windows would shorten all shifts
        automata = [(k, WuManber(ps)) for k, ps in by_words.items()]
        for array in arrays:
            rows = []
            for text in as_bytes(array):
                norm = plain(text)
                n = norm.count(b" ") - 1
                starts, items, spans = None, set(), []
                for k, automaton in automata:
                    for at, p in automaton.search(norm):
                        if starts is None:
                            starts = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
                        first = int(np.searchsorted(starts, at))
                        spans.append((first, first + k))
                        items.update(owners[p])
                merged = union(spans)
                rows.append({"n_words": n, "n_hit": sum(b - a for a, b in merged), "item_ids": sorted(items), "spans": [{"first": a, "last": b - 1} for a, b in merged]})
            yield pa.array(rows, HIT_ARROW)

    return match.asNondeterministic()  # never evaluated twice for one row


HIT_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint half-open intervals that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def pattern_blocks(benchmark: DataFrame, window: int, max_patterns: int) -> tuple[int, Iterator[dict[bytes, list[int]]]]:
    """The number of blocks of about ``max_patterns`` windows, and the blocks, of which the driver holds one at a time."""
    windows = checkpoint(item_windows(benchmark, window))
    blocks = max(1, -(-windows.select("pattern").distinct().count() // max_patterns))

    def each() -> Iterator[dict[bytes, list[int]]]:
        for b in range(blocks):
            owners: dict[bytes, list[int]] = defaultdict(list)
            for row in windows.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).toLocalIterator():
                owners[bytes(row.pattern)] += [] if row.item_id is None else [row.item_id]
            yield dict(owners)

    return blocks, each()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_patterns: int = 200_000) -> DataFrame:
    """The columns of ``docs`` and a struct column ``contamination`` of n_words, n_hit, item_ids and word spans.

    A null or empty text has no words and no hits; an item without words has no
    window; a null item_id marks words but is not listed; repeated items count
    once; repeated documents each get a row. An existing column named
    ``contamination`` is replaced. A benchmark of more than ``max_patterns`` windows
    is searched in blocks, one job after the other over all documents; the hits of
    each are saved, and neither the driver nor a worker holds more than one block.
    """
    text = F.col("text").cast("string")
    n, blocks = pattern_blocks(benchmark, window, max_patterns)
    if n == 1:
        return docs.withColumn("contamination", matcher(next(blocks), docs.sparkSession)(text))
    rows, hits = keyed(docs.select("doc_id", "text")), None
    for owners in blocks:
        found = rows.select("_lathe_id", "_lathe_h", matcher(owners, docs.sparkSession)(text).alias("c")).where("c.n_hit > 0")
        found = saved(found.dropDuplicates(["_lathe_id", "_lathe_h"]), "contamination")
        owners.clear()
        hits = found if hits is None else hits.unionByName(found)
    every = lambda f: F.flatten(F.collect_list(f"c.{f}"))  # noqa: E731  of one block each
    hits = hits.groupBy("_lathe_id", "_lathe_h").agg(F.array_sort(F.array_distinct(every("item_ids"))).alias("_items"), _union_column(every("spans")).alias("_spans"))
    spans = F.coalesce("_spans", F.array().cast(SPANS))
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s.last - s.first + 1)
    contamination = F.struct(count_words(text).alias("n_words"), n_hit.alias("n_hit"), F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"), spans.alias("spans"))
    others = [c for c in docs.columns if c != "contamination"]
    return keyed(docs).join(hits, ["_lathe_id", "_lathe_h"], "left").select(*others, contamination.alias("contamination"))


def count_words(text: Column) -> Column:
    """Number of plain words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("bigint")


def _union_column(spans: Column) -> Column:
    """Merge an array of inclusive spans into disjoint ones."""
    def put(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.first.alias("first"), F.greatest(last.last, s.last).alias("last"))))
        return F.when((F.size(acc) > 0) & (s.first <= F.try_element_at(acc, F.lit(-1)).last + 1), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), put)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents in which a window occurs."""
    return find_contamination(docs, benchmark, window).where("contamination.n_hit = 0").select(*docs.columns)
