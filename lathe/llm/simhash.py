"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits have a common variant
within half that radius of each: one bit of one and one of the other, or, at
distance three, one of one and two of the other. Every distinct fingerprint
emits all variants within one bit; as fingerprints at distance three differ in
parity, only those of odd parity emit two-bit variants, and as two of any three
bits lie in the same half, only pairs of bits in one half are needed. Variants
are shuffled in packed blocks by their hash; equal variants collide, and
colliding pairs are verified and deduplicated. A variant is emitted by at most
2081 fingerprints, so no block holds a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import NO_ID, as_bytes, checkpoint, salted_join
from lathe.llm.graph import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
NEAR = np.array([0] + [1 << i for i in range(64)], np.uint64)
PAIRS = np.array([1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)], np.uint64)
MASKS = np.concatenate([NEAR, PAIRS])
#: Variants of a fingerprint on average.
VARIANTS = 65 + len(PAIRS) // 2


def block_sizes(n: int, least_parts: int) -> tuple[int, int]:
    """Number of blocks for n fingerprints, and fingerprints that a task expands at once.

    A block holds 1.5 million variants, and up to 20 million (some 500 MB while
    sorted) once there are over 50,000 blocks; expansions grow with the number of
    blocks, up to 16,384 fingerprints, so that packed rows keep about 32 variants.
    """
    total = n * VARIANTS
    block = min(max(1_500_000, total // 50_000), 20_000_000)
    parts = max(least_parts, -(-total // block))
    return parts, min(max(2048, 32 * parts // VARIANTS), 16_384)


_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - SHINGLE].tolist()
    parts = [joined[a:b] for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def fingerprint(text: bytes | None) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes; 0 without words. Signed 64-bit."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        b = h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8) + _PLACE
        ones += (np.bincount(b.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints_of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in arrays:
        yield pa.array([fingerprint(t) for t in as_bytes(array)], pa.int64())


def fingerprints(docs: DataFrame) -> DataFrame:
    """_id, _h (row key) and fp of every row."""
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_h"),
        F.arrow_udf(fingerprints_of, "bigint")(text).alias("fp"),
    )


def link(fps: DataFrame) -> DataFrame:
    """Distinct fp -> (a, b): pairs within RADIUS bits that connect all fingerprints which such pairs connect."""
    parts, chunk = block_sizes(fps.count(), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def emit(batches):
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(all_fps), chunk):
                x = all_fps[lo : lo + chunk]
                odd = x[np.bitwise_count(x) % 2 == 1]
                v = np.concatenate([(x[:, None] ^ NEAR).ravel(), (odd[:, None] ^ PAIRS).ravel()])
                code = np.concatenate([np.tile(np.arange(65, dtype=np.uint16), len(x)), np.tile(np.arange(65, len(MASKS), dtype=np.uint16), len(odd))])
                part = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
                order = np.argsort(part.astype(np.uint32), kind="stable")
                v, code = v[order], code[order]
                keys, at = np.unique(part[order], return_index=True)
                cut = [*at.tolist(), len(v)]
                rows = list(zip(cut, cut[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.astype(np.int32), pa.int32()),
                    pa.array([v[a:b].tobytes() for a, b in rows], pa.binary()),
                    pa.array([code[a:b].tobytes() for a, b in rows], pa.binary()),
                ], ["part", "variants", "codes"])

    def meet(table: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(table.column("variants").to_pylist()), np.uint64)
        code = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint16)
        order = np.argsort(v, kind="stable")
        s = v[order]
        same = np.zeros(len(s), bool)
        if len(s) > 1:
            same[1:] = s[1:] == s[:-1]
            same[:-1] |= same[1:].copy()
        v, code = s[same], code[order[same]]
        order = np.lexsort((code, v))
        v, code = v[order], code[order]
        center = v ^ MASKS[code]
        first = np.ones(len(v), bool)
        first[1:] = v[1:] != v[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
        # all within one bit of a variant are two bits apart at most, three from those within two bits
        use = ~first & (code[head] < 65)
        a, b = center[head[use]], center[use]
        near = np.bitwise_count(a ^ b) <= RADIUS
        pairs = np.unique(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], axis=1).view(np.int64), axis=0) if near.any() else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    # a fingerprint grows some 700-fold: spread them first, so that a task emits about one block
    spread = fps.select("fp").repartition(parts)
    blocks = spread.mapInArrow(emit, "part int, variants binary, codes binary")
    return blocks.repartitionById(parts, "part").groupBy("part").applyInArrow(meet, "a bigint, b bigint").distinct()


def components(docs: DataFrame) -> DataFrame:
    """_id, _h, fp and rep (struct of the smallest row key reachable) of every row of ``docs``."""
    rows = checkpoint(fingerprints(docs))
    fps = checkpoint(rows.groupBy("fp").agg(F.min(F.struct("_id", "_h")).alias("low"), F.count("*").alias("n")))
    roots = checkpoint(connected_components(link(fps)))
    # the root of a component is not a row of roots
    member = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    member = fps.join(member, fps.fp == member.node).select("fp", "low", "root")
    lows = member.groupBy("root").agg(F.min("low").alias("rep"))
    member = salted_join(member, lows, ["root"], F.col("fp")).select(F.col("fp").alias("node"), "rep")
    shared = fps.join(member, fps.fp == member.node, "left").where("n > 1 or rep is not null").select("fp", F.coalesce("rep", "low").alias("rep"))
    own = F.struct("_id", "_h")
    return salted_join(rows, shared, ["fp"], F.col("_id"), how="left").select("_id", "_h", "fp", F.coalesce("rep", own).alias("rep"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Texts are whole; A-Z are lower-cased; a text of fewer than three words is one
    shingle, one without words (null included) has fingerprint zero and links
    like any other. ``component_id`` is the smallest doc_id reachable over links
    of at most three differing bits; a null doc_id sorts after all others, and a
    component of such rows alone has a null id. Repeated rows each get a row.
    """
    value = lambda c: F.nullif(c, F.lit(NO_ID))
    return components(docs).select(value(F.col("_id")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), value(F.col("rep._id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, of its repeats one."""
    keep = components(docs).where((F.col("_id") == F.col("rep._id")) & (F.col("_h") == F.col("rep._h"))).select(F.col("_id").alias("_lathe_id"), F.col("_h").alias("_lathe_h")).distinct()
    text = F.col("text").cast("string")
    keyed = docs.withColumn("_lathe_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn("_lathe_h", F.xxhash64(text))
    again = F.row_number().over(Window.partitionBy("_lathe_id", "_lathe_h").orderBy("_lathe_h"))
    return keyed.join(keep, ["_lathe_id", "_lathe_h"]).withColumn("_lathe_n", again).where("_lathe_n = 1").select(*docs.columns)
