"""Mixing sources to target weights by subset-sum budget fitting.

Each source's target is split into whole passes over the source and a remaining
budget. The remaining budget is filled by documents *counted by exact length*: a
proportional share of every length, and a bounded-knapsack dynamic programme over the
last words. Where that leaves words, the programme covers more and more of the budget,
in the end all of it. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import checkpoint, salted_join

#: Words that the dynamic programme covers at first, and how much more in each further attempt.
DP_WORDS, MORE = 20_000, 8
#: Sums that an attempt may look at, over all lengths, and at once (four bytes each).
WORK, MOST_SUMS = 4_000_000_000, 50_000_000
#: Documents of one (source, length) that one part of their seeded deal holds on average at most; at least 64 parts.
PART_ROWS, LEAST_PARTS = 2_000_000, 64


def count_words(text: Column) -> Column:
    """Number of blank-split words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` and ``_rank``, their place in code-point order from 0, null last: sorted by range, numbered by prefix sums over the partitions."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = checkpoint(sources.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = sorted(ranged.groupBy("_p").count().collect())  # one row per partition
    base = dict(zip((p for p, _ in sizes), [0, *accumulate(n for _, n in sizes)]))
    starts = F.broadcast(sources.sparkSession.createDataFrame(list(base.items()), "_p int, _base bigint"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(starts, "_p").withColumn("_rank", F.col("_base") + within - 1).drop("_p", "_base")


def source_targets(sources: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) with each source's ``target``: capped sharing of the total.

    Sources in code-point order, null last, take the weights in turn. A round
    shares what is left by weight among the sources that are not yet capped, and
    caps those above ``most`` times their size; only sums of a round reach the
    driver, and these are of whole numbers, so they do not depend on row order.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = checkpoint(_ranked(sources).withColumn("_weight", F.get(cycle, (F.col("_rank") % len(weights)).cast("int"))))
    cap, share = most * F.col("source_size"), 0.0
    while True:
        capped = F.lit(share) * F.col("_weight") > cap
        total, taken, weight = weighted.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("_weight")))).first()
        last, share = share, ((total or 0) - most * (taken or 0)) / weight if weight else share
        if share <= last:  # no source was capped anew
            return weighted.select("source", "source_size", F.when(capped, cap).otherwise(F.lit(share) * F.col("_weight")).alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS, work: int = WORK, most_sums: int = MOST_SUMS) -> np.ndarray:
    """How many documents of each length to take for the largest sum up to ``budget``.

    An attempt takes the same share of every length, then longer lengths, until about
    ``dp_words`` words are left, and fits these by the programme. A sum equal to the
    budget is the largest. Otherwise ``MORE`` times as many words are left to the
    programme, until it covers the whole budget and so finds the largest sum.

    That is so for every budget whose sums, in units of the lengths' common divisor,
    are at most ``most_sums`` and, times the parts that lengths are dealt in (about the
    logarithms of their counts), at most ``work``. Beyond, the best attempt is taken. It
    lacks fewer words than the shortest document that it leaves has.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    best = np.zeros(len(sizes), np.int64)
    if budget <= 0 or total == 0:
        return best
    if budget >= total:
        return counts.copy()
    unit, room = int(np.gcd.reduce(sizes)), dp_words
    while True:
        take = _share(sizes, counts, budget, total, room) if budget > 2 * room else np.zeros(len(sizes), np.int64)
        left, whole = (budget - int(take @ sizes)) // unit, not take.any()
        parts = int(np.ceil(np.log2(np.minimum(counts - take, left // np.maximum(sizes // unit, 1)) + 1)).sum())
        if best.any() and (left > most_sums or parts * left > work):
            return best
        take = take + _knapsack(sizes // unit, counts - take, left)
        if not best.any() or take @ sizes > best @ sizes:
            best = take
        if whole or int(best @ sizes) == budget // unit * unit:
            return best
        room *= MORE


def _share(sizes: np.ndarray, counts: np.ndarray, budget: int, total: int, room: int) -> np.ndarray:
    """The same share of every length, then longer lengths, while ``room`` words are left."""
    take = (counts * ((budget - room) / total)).astype(np.int64)
    left = budget - int((take * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i] > 0 and left - sizes[i] >= room:
            k = min(int(counts[i] - take[i]), int((left - room) // sizes[i]))
            take[i] += k
            left -= k * int(sizes[i])
    return take


def _knapsack(sizes: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: each length's count is split in powers of two; ``made`` keeps the part that first reached a sum."""
    take = np.zeros(len(sizes), np.int64)
    made = np.full(budget + 1, -1, np.int32)
    made[0] = 0
    parts, top = [], 0  # top: the largest sum that may be reached
    for i in np.argsort(-sizes, kind="stable"):
        size, n, k = int(sizes[i]), 0, 1
        if not 0 < size <= budget:
            continue
        most = min(int(free[i]), budget // size)
        while n < most and made[budget] < 0:
            k = min(k, most - n)
            step = size * k
            top = min(budget, top + step)
            if step <= budget:
                parts.append((int(i), k))
                fresh = (made[step : top + 1] < 0) & (made[: top + 1 - step] >= 0)
                made[step : top + 1][fresh] = len(parts)
            n += k
            k *= 2
        if made[budget] >= 0:
            break
    at = int(np.flatnonzero(made >= 0)[-1])
    while at > 0:
        i, k = parts[made[at] - 1]
        take[i] += k
        at -= int(sizes[i]) * k
    return take


def mix(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``.

    ``taken`` is the number of words the mix takes from the row, repeats counted:
    a whole multiple of its size, at most ``most`` times (a target is at most that
    many passes). Null texts and texts of blanks have size 0 and take 0; a null
    source is a source, sorted last; rows that repeat (doc_id, text) are separate
    rows; a null doc_id is an ordinary value. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    sized = checkpoint(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(text).alias("size"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), text).alias("_draw"),
    ).withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    deal = max(LEAST_PARTS, -(-sized.count() // PART_ROWS))
    sized = sized.withColumn("_part", F.pmod("_draw", F.lit(deal)).cast("int"))
    parts = sized.groupBy("_key", "source", "size", "_part").agg(F.count("*").alias("n"))
    lengths = parts.groupBy("_key", "source", "size").agg(F.sum("n").alias("n"))
    sources = checkpoint(lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    targets = source_targets(sources, weights, most).withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")

    def plan(key: tuple, lens: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        if not len(lens) or not len(goal):
            return pd.DataFrame({"_key": [], "size": [], "passes": [], "extra": []})
        lens = lens.sort_values("size", kind="stable")
        total, target = int(goal["source_size"].iloc[0]), float(goal["target"].iloc[0])
        passes = min(int(target // total), int(most)) if total else 0
        extra = fit_budget(lens["size"].to_numpy(), lens["n"].to_numpy(), round(target) - passes * total if passes < most else 0)
        return pd.DataFrame({"_key": lens["_key"], "size": lens["size"], "passes": passes, "extra": extra})

    plans = lengths.groupBy("_key").cogroup(targets.groupBy("_key")).applyInPandas(plan, "_key string, size bigint, passes bigint, extra bigint")
    before = F.sum("n").over(Window.partitionBy("_key", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    quotas = (
        parts.select("_key", "size", "_part", "n").join(plans, ["_key", "size"])
        .withColumn("_quota", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.coalesce(before, F.lit(0)))))
        .select("_key", "size", "_part", "passes", "_quota", "n")
    )
    rank = F.row_number().over(Window.partitionBy("_key", "size", "_part").orderBy("_draw", "doc_id"))
    taken = (
        sized.withColumn("_rank", rank)
        .join(quotas.drop("n"), ["_key", "size", "_part"])
        .withColumn("taken", F.col("size") * (F.col("passes") + F.when(F.col("_rank") <= F.col("_quota"), 1).otherwise(0)))
    )
    salt = F.coalesce("doc_id", F.lit(0))
    return salted_join(taken, targets, ["_key"], salt).select("doc_id", "source", "size", "source_size", "target", "taken", "_draw")
