"""Effectiveness of skills over benchmark records (A17-A22), with bootstrap intervals and permutation p-values.

Groups are first reduced to counts per distinct score. What resampling would draw from
is then known exactly where it fits: for two scores, such as failed and passed, a
binomial distribution of means and a hypergeometric one of permutations, of any number of
trials; for more, by convolution over the counts of scores, up to ``EXACT_WORK`` steps.
Beyond, resampling draws from counts: a bootstrap resample is a multinomial draw, a
permutation a multivariate hypergeometric one. Both have the distribution of resampling
the rows, at a cost that grows with distinct scores only, and a known Monte Carlo error.
Seeds derive from the group's key.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.numeric import n_where

RESAMPLES, CONFIDENCE, SEED = 10_000, 0.95, 42
#: Steps of an exact convolution at most.
EXACT_WORK = 20_000_000
_FACTORIALS = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))


def log_factorial(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    x = np.maximum(n, 200.0)
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 256, _FACTORIALS[np.minimum(n, 255).astype(int)], series)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_factorial(n) - log_factorial(k) - log_factorial(np.subtract(n, k))


def hypergeometric(total: int, marked: int, drawn: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of marked ones among ``drawn`` of ``total``, and their probabilities; those 40 standard deviations off are left out."""
    mean, share = drawn * marked / total, marked / total
    spread = 40 * math.sqrt(max(mean * (1 - share) * (total - drawn) / max(total - 1, 1), 0)) + 2
    k = np.arange(max(0, drawn + marked - total, math.floor(mean - spread)), min(drawn, marked, math.ceil(mean + spread)) + 1)
    return k, np.exp(log_choose(marked, k) + log_choose(total - marked, drawn - k) - log_choose(total, drawn))


def _drawn_sums(values: np.ndarray, counts: np.ndarray, drawn: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The sums of whole ``values`` that ``drawn`` of the counted ones can have, with their probabilities; None if that takes too long."""
    if len(values) == 2:
        k, p = hypergeometric(int(counts.sum()), int(counts[1]), drawn)
        return k * values[1] + (drawn - k) * values[0], p
    width = drawn * int(values.max()) + 1
    if float(width) * drawn * float(np.minimum(counts, drawn).sum()) > EXACT_WORK:
        return None
    state, left = {0: {0: 1.0}}, int(counts.sum())  # number drawn so far -> sum -> probability
    for value, count in zip(values.tolist(), counts.tolist()):
        after: dict[int, dict[int, float]] = {}
        for n, sums in state.items():
            for k, p in zip(*hypergeometric(left, count, drawn - n)) if left else [(0, 1.0)]:
                into = after.setdefault(n + int(k), {})
                for total, q in sums.items():
                    at = total + int(k) * value
                    into[at] = into.get(at, 0.0) + p * q
        state, left = after, left - count
    sums = state.get(drawn, {})
    return np.array(list(sums), float), np.array(list(sums.values()))


def _whole(values: np.ndarray) -> np.ndarray | None:
    """Values as whole multiples of their common step above the smallest, if they have one in four decimal places."""
    scaled = np.round((values - values.min()) * 10_000)
    if np.abs(scaled / 10_000 + values.min() - values).max() > 1e-12:
        return None
    return (scaled / max(np.gcd.reduce(scaled.astype(np.int64)), 1)).astype(np.int64)


def binomial_interval(n: int, k: int, confidence: float = CONFIDENCE) -> tuple[float, float]:
    """The exact percentile interval of the resampled share of ``k`` ones among ``n``: quantiles of a binomial distribution."""
    share = k / n
    spread = 40 * math.sqrt(n * share * (1 - share)) + 2
    x = np.arange(max(0, math.floor(k - spread)), min(n, math.ceil(k + spread)) + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = log_choose(n, x) + np.where(x > 0, x * np.log(share), 0) + np.where(n - x > 0, (n - x) * np.log1p(-share), 0)
    below = np.cumsum(np.exp(logs))
    at = lambda q: float(x[min(int(np.searchsorted(below, q - 1e-12)), len(x) - 1)]) / n
    tail = (1 - confidence) / 2
    return at(tail), at(1 - tail)


def bootstrap_ci(values: np.ndarray, counts: np.ndarray, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED) -> tuple[float, float, float]:
    """Mean and percentile interval of the mean. No values give zeros, one value itself."""
    values, counts = np.asarray(values, float), np.asarray(counts, np.int64)
    n = int(counts.sum())
    if n == 0:
        return 0.0, 0.0, 0.0
    mean = float(values @ counts) / n
    if n == 1 or len(values) == 1:
        return mean, mean, mean
    means = np.sort(np.random.default_rng(seed).multinomial(n, counts / n, resamples) @ values / n)
    tail = (1.0 - confidence) / 2.0
    low, high = math.floor(tail * resamples), math.ceil((1.0 - tail) * resamples) - 1
    at = lambda i: float(means[min(max(i, 0), resamples - 1)])
    return mean, at(low), at(high)


def permutation_test(values: np.ndarray, a: np.ndarray, b: np.ndarray, permutations: int = RESAMPLES, seed: int = SEED) -> tuple[float, float, float]:
    """Difference of means, two-sided p of counts ``a`` and ``b`` over ``values``, and the standard error of p (0: exact). An empty side gives (0, 1, 0)."""
    values, a, b = np.asarray(values, float), np.asarray(a, np.int64), np.asarray(b, np.int64)
    held = a + b > 0
    values, a, b = values[held], a[held], b[held]
    na, nb = int(a.sum()), int(b.sum())
    if not na or not nb or len(values) == 1:
        return 0.0, 1.0, 0.0
    total = values @ (a + b)
    seen = values @ a / na - values @ b / nb
    whole = _whole(values)
    exact = _drawn_sums(whole, a + b, na) if whole is not None else None
    if exact is not None:
        sums, p = exact
        step = (values.max() - values.min()) / whole.max()
        drawn = sums * step + na * values.min()
        diff = np.abs(drawn / na - (total - drawn) / nb)
        return float(seen), min(1.0, float(p[diff >= abs(seen) - 1e-12].sum())), 0.0
    method = "marginals" if na + nb > 1_000_000 or len(values) < na + nb else "count"
    drawn = np.random.default_rng(seed).multivariate_hypergeometric(a + b, na, permutations, method=method) @ values
    diff = np.abs(drawn / na - (total - drawn) / nb)
    p = float((np.sum(diff >= abs(seen) - 1e-12) + 1) / (permutations + 1))
    return float(seen), p, math.sqrt(p * (1 - p) / permutations)


def _seed(*key) -> int:
    return zlib.crc32("\x1f".join(map(str, key)).encode()) ^ SEED


#: One row per (group, side, score): side is baseline or treatment.
COUNTS = ["group", "side", "score", "n", "n_passed"]


def rates(counts: DataFrame) -> DataFrame:
    """A17, the relational part: n's, pass rates and delta in percentage points of each group; an empty side has rate 0 and delta 0."""
    side = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0))
    out = counts.groupBy("group").agg(side("baseline", "n").alias("n_baseline"), side("treatment", "n").alias("n_treatment"), side("baseline", "n_passed").alias("_b"), side("treatment", "n_passed").alias("_t"))
    rate = lambda p, n: F.coalesce(F.col(p).cast("double") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0))
    out = out.withColumn("baseline_rate", rate("_b", "n_baseline")).withColumn("treatment_rate", rate("_t", "n_treatment"))
    both = (F.col("n_baseline") > 0) & (F.col("n_treatment") > 0)
    delta = F.when(both, (F.col("treatment_rate") - F.col("baseline_rate")) * 100.0).otherwise(0.0)
    return out.select("group", "n_baseline", "n_treatment", "baseline_rate", "treatment_rate", delta.alias("delta_pp"))


def with_tests(counts: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """``rates`` with p_value of the scores, its standard error (0 where the test is exact) and the interval of the treatment's pass rate (null without both sides, p then 1)."""

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="score", columns="side", values="n", aggfunc="sum", fill_value=0)
        a, b = (wide[s].to_numpy(np.int64) if s in wide else np.zeros(len(wide), np.int64) for s in ("treatment", "baseline"))
        if not a.sum() or not b.sum():
            return pd.DataFrame({"_group": [key[0]], "p_value": [1.0], "p_error": [0.0], "treatment_ci_lower": [None], "treatment_ci_upper": [None]})
        _, p, error = permutation_test(wide.index.to_numpy(), a, b, resamples, _seed(key[0], "p"))
        treated = pdf[pdf["side"] == "treatment"]
        low, high = binomial_interval(int(treated["n"].sum()), int(treated["n_passed"].sum()))
        return pd.DataFrame({"_group": [key[0]], "p_value": [p], "p_error": [error], "treatment_ci_lower": [low], "treatment_ci_upper": [high]})

    tests = counts.groupBy("group").applyInPandas(test, "_group string, p_value double, p_error double, treatment_ci_lower double, treatment_ci_upper double")
    return rates(counts).join(tests, F.col("group").eqNullSafe(F.col("_group"))).drop("_group")


def displayed(results: DataFrame) -> DataFrame:
    """The rounded form: delta_pp to 2 places, the rest to 4."""
    for c in results.columns:
        if c == "delta_pp":
            results = results.withColumn(c, F.round(c, 2))
        elif c.endswith("_rate") or c == "p_value" or "_ci_" in c:
            results = results.withColumn(c, F.round(c, 4))
    return results


def _count(rows: DataFrame, *keys: Column | str) -> DataFrame:
    return rows.groupBy(*keys, "score").agg(F.count("*").alias("n"), n_where(F.col("passed")).alias("n_passed"))


def matched_counts(records: DataFrame, key: str, skip_empty: bool = False) -> DataFrame:
    """Treatment counts of each value of ``key``, and baseline counts of the tasks seen in it, of any model.

    Baselines are reduced to counts per task before the join on distinct
    (group, task) pairs, so no baseline row is rescanned per group.
    """
    curated = records.where("condition = 'curated'").withColumn("group", F.col(key).cast("string"))
    if skip_empty:
        curated = curated.where(F.coalesce("group", F.lit("")) != "")
    base = _count(records.where("condition = 'baseline'"), "problem_id")
    pairs = curated.select("group", "problem_id").distinct()
    matched = pairs.join(base, "problem_id").groupBy("group", "score").agg(F.sum("n").alias("n"), F.sum("n_passed").alias("n_passed"))
    sides = _count(curated, "group").withColumn("side", F.lit("treatment")).unionByName(matched.withColumn("side", F.lit("baseline")))
    return sides.select(*COUNTS)


def keyed_counts(records: DataFrame, key: str) -> DataFrame:
    """Counts of both sides of each value of ``key``."""
    rows = records.where("condition in ('baseline', 'curated')").withColumn("group", F.col(key).cast("string"))
    side = F.when(F.col("condition") == "baseline", "baseline").otherwise("treatment").alias("side")
    return _count(rows, "group", side).select(*COUNTS)


def by_skill(records: DataFrame) -> DataFrame:
    return rates(matched_counts(records, "skill_name"))


def by_k(records: DataFrame) -> DataFrame:
    return rates(matched_counts(records, "k_value"))


def by_composition_type(records: DataFrame) -> DataFrame:
    return rates(matched_counts(records, "composition_type", skip_empty=True))


def by_domain(records: DataFrame) -> DataFrame:
    return rates(keyed_counts(records, "domain"))


def by_model(records: DataFrame) -> DataFrame:
    return rates(keyed_counts(records, "model"))


def overall_counts(records: DataFrame) -> DataFrame:
    """Baseline against curated, and against self_generated, as two groups."""
    pairs = F.when(F.col("condition") == "baseline", F.array(F.lit("curated"), F.lit("self_generated"))).otherwise(F.array("condition"))
    rows = records.where("condition in ('baseline', 'curated', 'self_generated')").withColumn("group", F.explode(pairs))
    side = F.when(F.col("condition") == "baseline", "baseline").otherwise("treatment").alias("side")
    return _count(rows, "group", side).select(*COUNTS)


def overall(records: DataFrame) -> DataFrame:
    """One row of total_trials and the deltas; a missing side gives 0."""
    n = lambda c: n_where(F.col("condition") == c)
    rate = lambda c: n_where((F.col("condition") == c) & F.col("passed")).cast("double") / F.nullif(n(c), F.lit(0))
    delta = lambda c: F.coalesce((rate(c) - rate("baseline")) * 100.0, F.lit(0.0))
    return records.agg(F.count("*").alias("total_trials"), delta("curated").alias("curated_delta_pp"), delta("self_generated").alias("self_generated_delta_pp"))
