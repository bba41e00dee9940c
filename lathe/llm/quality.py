"""Quality rules: base rules and robust multivariate outliers.

A document fails the base rules if it has under 20 words or over 30 % of its
words lie in repeated 8-word windows. The others are judged by the Mahalanobis
distance of their transformed statistics from a minimum-covariance-determinant
(MCD) estimate of their (lang, source) group.

The estimate of a group takes three deterministic starts (medians and quartile
ranges; mean and covariance; medians and the covariance of directions), makes two
concentration steps of each and four more of the one whose determinant is smallest,
and keeps the estimate of the smallest determinant of all. A step re-estimates mean and covariance from the 75 %
of the group's documents nearest to the last estimate. All steps cover all
documents: these are aggregated to (group, start, distance bin) moments, and only
the moments reach the small per-group solver. A bin is 1/32 of a unit of log
distance; the bin in which the 75 % end counts in part. Features are whole numbers
(in 256ths), so the moments are exact and do not depend on row order.

The scatter is made consistent for normal samples, and a group's estimate is
blended with its language's, as that is with the one of all documents: each wider
estimate counts like ``PRIOR`` documents, so a group of any size has an estimate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import as_bytes, checkpoint, salted_join

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Features of a document, and their tolerances: standard deviations added to a group's own, as groups
#: may not vary at all in a feature. Nothing is rejected for being up to seven tolerances off in one feature alone.
FEATURES = {
    "log_words": 0.25,
    "log_word_chars": 0.05,
    "symbols": 0.10,
    "dup_lines": 0.10,
    "repeats": 0.10,
    "log_words_per_line": 0.25,
}
P = len(FEATURES)
X = [f"_x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Features are rounded to this part of a unit.
GRID = 256
TOLERANCE = np.square(GRID * np.array(list(FEATURES.values())))
#: Share of a group's documents that an estimate is made from, bins of a unit of log distance, concentration steps of all starts and of the best.
SHARE, BINS, STEPS, MORE_STEPS = 0.75, 32, 2, 4
#: A document is rejected if one in so many of a normal sample were farther off: texts have heavier tails.
ONE_IN = 1e9


def chi2_tail(x: float, degrees: int) -> float:
    """Upper tail of the chi-square distribution with an even number of degrees of freedom."""
    return exp(-x / 2) * sum((x / 2) ** k / factorial(k) for k in range(degrees // 2))


def chi2_quantile(tail: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, degrees) > tail else (low, mid)
    return low


CUT = chi2_quantile(1 / ONE_IN, P)
#: Factor that makes the covariance of the nearest SHARE of a normal sample consistent.
CONSISTENCY = SHARE / (1 - chi2_tail(chi2_quantile(1 - SHARE, P), P + 2))
#: Documents like which the next wider group's estimate counts.
PRIOR = 50
#: Parameters of up to this many groups (about 2 KB each) are broadcast; more are joined by key.
BROADCAST_GROUPS = 5_000


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur at least twice, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(h, twice)).tolist()
    same = Counter(tuple(words[i : i + window]) for i in found)  # hashes only select; words decide
    edge = np.zeros(len(words) + 1, np.int64)
    for i in found:
        if same[tuple(words[i : i + window])] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8"))
    lines, seen, dups = 0, set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dups += line in seen
            seen.add(line)
    return len(words), chars, len(joined) - len(joined.translate(None, SYMBOLS)), dups, repeat_words(words), lines


def counts_of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in arrays:
        rows = [text_counts(t) for t in as_bytes(array)]
        columns = list(zip(*rows)) or [[]] * len(COUNTS)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


def features() -> list[Column]:
    """The statistics, transformed, in whole GRIDths."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    found = [
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))),
        F.asinh(10 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / n),
        F.log(F.greatest(F.col("n_words") / lines, F.lit(1.0))),
    ]
    return [F.round(GRID * f).cast("bigint") for f in found]


def _with_params(rows: DataFrame, params: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``params``, which has one row per ``_g``; ``small``: so few that they can be broadcast."""
    if small:
        return rows.join(F.broadcast(params), "_g", how)
    return salted_join(rows, params, ["_g"], F.xxhash64(*X), how=how)


def _distance() -> Column:
    d = [F.col(x) - F.col("mu")[i] for i, x in enumerate(X)]
    terms = [F.col("prec")[i * P + j] * d[i] * d[j] * (1.0 if i == j else 2.0) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


ESTIMATE = "mu array<double>, cov array<double>, prec array<double>, logdet double"
#: The estimates of a group and its number of documents.
PARAMS = f"_g string, n double, found array<struct<{ESTIMATE.replace(' array', ':array').replace(' double', ':double')}>>"
_DOUBLES = pa.list_(pa.float64())
PARAMS_ARROW = pa.schema([("_g", pa.string()), ("n", pa.float64()), ("found", pa.list_(pa.struct([("mu", _DOUBLES), ("cov", _DOUBLES), ("prec", _DOUBLES), ("logdet", pa.float64())])))])


def moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}_{j}") for i, j in PAIRS]]


def symmetric(values: np.ndarray) -> np.ndarray:
    """The matrix whose upper triangle is given row by row."""
    out = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, values):
        out[i, j] = out[j, i] = v
    return out


def mean_cov(n: float, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = sums / n
    return mean, symmetric(squares / n) - np.outer(mean, mean)


def one_estimate(mean: np.ndarray, cov: np.ndarray) -> dict:
    full = cov + np.diag(TOLERANCE)
    return {"mu": mean.tolist(), "cov": cov.ravel().tolist(), "prec": np.linalg.inv(full).ravel().tolist(), "logdet": float(np.linalg.slogdet(full)[1])}


S_COLUMNS, Q_COLUMNS = [f"s{i}" for i in range(P)], [f"q{i}_{j}" for i, j in PAIRS]


def first_estimates(fit: DataFrame, plain: DataFrame, small: bool) -> DataFrame:
    """Three starts of every group, as PARAMS. ``plain`` has the groups' moments and quartiles."""
    scale = lambda i: F.sqrt(F.pow((F.col("quartiles")[i][2] - F.col("quartiles")[i][0]) / 1.349, 2) + float(TOLERANCE[i]))
    scaled = plain.select("_g", F.array(*[F.col("quartiles")[i][1] for i in range(P)]).alias("mid"), F.array(*[scale(i) for i in range(P)]).alias("scale"))
    z = [(F.col(x) - F.col("mid")[i]) / F.col("scale")[i] for i, x in enumerate(X)]
    length = F.sqrt(F.greatest(sum((c * c for c in z[1:]), z[0] * z[0]), F.lit(1e-18)))
    # directions in 1024ths: exact sums again
    unit = _with_params(fit, scaled, small).select("_g", *[F.round(1024 * c / length).cast("bigint").alias(x) for x, c in zip(X, z)])
    unit = unit.groupBy("_g").agg(*[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"u{i}_{j}") for i, j in PAIRS])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mid, scale, n = np.array(r["mid"]), np.array(r["scale"]), r["n"]
                mean, cov = mean_cov(n, np.array([r[c] for c in S_COLUMNS], np.float64), np.array([r[c] for c in Q_COLUMNS], np.float64))
                signs = symmetric(np.array([r[f"u{i}_{j}"] for i, j in PAIRS]) / (n * 1024.0**2)) * P
                found = [one_estimate(mu, c) for mu, c in ((mid, np.diag(scale**2 - TOLERANCE)), (mean, cov), (mid, np.outer(scale, scale) * signs))]
                out.append({"_g": r["_g"], "n": float(n), "found": found})
            yield pa.RecordBatch.from_pylist(out, PARAMS_ARROW)

    return checkpoint(plain.join(scaled, "_g").join(unit, "_g").mapInArrow(starts, PARAMS))


def concentrated(fit: DataFrame, params: DataFrame, small: bool, first: bool, best: bool) -> DataFrame:
    """One concentration step of every estimate in ``params``: mean and covariance of the nearest SHARE of the group's documents.

    ``first``: the estimates before were starts, whose determinants are no subset's; else
    the smaller determinant of before and after stays. ``best``: of a group's estimates
    the one of the smallest determinant stays.
    """
    each = _with_params(fit, params, small).select("_g", *X, F.posexplode("found").alias("s", "p")).select("_g", "s", *X, "p.mu", "p.prec")
    binned = each.withColumn("_bin", F.floor(BINS * F.log(F.greatest(_distance(), F.lit(1e-9)))).cast("int"))
    binned = binned.groupBy("_g", "s", "_bin").agg(*moments())

    def step(key: tuple, bins: pa.Table, before: pa.Table) -> pa.Table:
        column = lambda c: bins.column(c).to_numpy()
        order = np.lexsort((column("_bin"), column("s")))
        start, n = column("s")[order], column("n")[order].astype(np.float64)
        sums, squares = (np.stack([column(c) for c in names], axis=1)[order].astype(np.float64) for names in (S_COLUMNS, Q_COLUMNS))
        was, found = before.column("found")[0].as_py(), []
        for s, old in enumerate(was):
            mine = start == s
            m = n[mine]
            h = np.ceil(SHARE * m.sum())
            weight = np.clip(h - (np.cumsum(m) - m), 0, m) / m  # 1 in the nearer bins, a part in the last one
            new = one_estimate(*mean_cov(h, weight @ sums[mine], weight @ squares[mine]))
            found.append(new if first or new["logdet"] < old["logdet"] else old)
        if best:
            found = [min(found, key=lambda e: e["logdet"])]
        return pa.Table.from_pylist([{"_g": key[0].as_py(), "n": before.column("n")[0].as_py(), "found": found}], PARAMS_ARROW)

    return checkpoint(binned.groupBy("_g").cogroup(params.groupBy("_g")).applyInArrow(step, PARAMS))


def estimate(fit: DataFrame) -> DataFrame:
    """The MCD estimate of every group: _g, n, mu, cov, prec and logdet from rows of _g and X."""
    quartiles = [F.percentile(F.col(x), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for x in X]
    plain = checkpoint(fit.groupBy("_g").agg(*moments(), F.array(*quartiles).alias("quartiles")))
    small = plain.count() <= BROADCAST_GROUPS
    params = first_estimates(fit, plain, small)
    for k in range(STEPS + MORE_STEPS):
        params = concentrated(fit, params, small, k == 0, k + 1 >= STEPS)
    return params.select("_g", "n", F.col("found")[0].alias("e")).select("_g", "n", "e.*")


def blend(n: float, mu: np.ndarray, cov: np.ndarray, wide_mu: np.ndarray, wide_cov: np.ndarray) -> dict:
    """The estimate from SHARE of n documents, mixed with PRIOR documents of the wider one."""
    w = SHARE * n / (SHARE * n + PRIOR)
    apart = mu - wide_mu
    return one_estimate(w * mu + (1 - w) * wide_mu, w * cov + (1 - w) * wide_cov + w * (1 - w) * np.outer(apart, apart))


def group_estimates(fit: DataFrame) -> DataFrame:
    """(_g, mu, prec) of every group of ``fit`` (_g, _l, X): its own estimate blended with its language's, which is blended with that of all documents."""
    levels = fit.select(F.explode(F.array(F.lit("*"), F.concat(F.lit("l "), "_l"), F.concat(F.lit("g "), "_g"))).alias("_g"), *X)
    raw = estimate(levels).withColumn("cov", F.transform("cov", lambda c: c * CONSISTENCY))
    every = raw.where("_g = '*'").first()  # one row
    if every is None:
        return raw.select("_g", "mu", "prec")
    all_mu, all_cov = np.array(every["mu"]), np.array(every["cov"]).reshape(P, P)

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mu, cov, lang_mu, lang_cov = np.array(r["mu"]), np.array(r["cov"]).reshape(P, P), np.array(r["lang_mu"]), np.array(r["lang_cov"]).reshape(P, P)
                lang = blend(r["lang_n"], lang_mu, lang_cov, all_mu, all_cov)
                found = blend(r["n"], mu, cov, np.array(lang["mu"]), np.array(lang["cov"]).reshape(P, P))
                out.append({"_g": r["_g"], "mu": found["mu"], "prec": found["prec"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_g", pa.string()), ("mu", _DOUBLES), ("prec", _DOUBLES)]))

    names = fit.select(F.concat(F.lit("g "), "_g").alias("_g"), F.concat(F.lit("l "), "_l").alias("_lang")).distinct()
    langs = raw.select(F.col("_g").alias("_lang"), F.col("n").alias("lang_n"), F.col("mu").alias("lang_mu"), F.col("cov").alias("lang_cov"))
    groups = raw.join(names, "_g").join(langs, "_lang").withColumn("_g", F.substr("_g", F.lit(3)))
    return checkpoint(groups.mapInArrow(mix, "_g string, mu array<double>, prec array<double>"))


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, the counts, base_failed, distance and kept for every row of ``docs``.

    A null text has no words and fails the base rules. Null lang and source are
    values of their own. Only documents that pass the base rules are used for
    estimates; documents of groups without any have a null distance, and have
    failed. ``cut`` is the squared distance above which a document is rejected,
    by default a chi-square quantile.
    Repeated rows count each; ties in distance fall in one bin; an empty table gives
    an empty result; other columns are not read.
    """
    key = lambda *cs: F.concat(*[F.coalesce(F.concat(F.lit(f"{c}="), F.col(c).cast("string")), F.lit("-")) for c in cs], F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key("lang", "source").alias("_g"), key("lang").alias("_l"), F.arrow_udf(counts_of, "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")(F.col("text").cast("string")).alias("c")).select("doc_id", "_g", "_l", "c.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = checkpoint(rows.withColumn("base_failed", failed).select("*", *[f.alias(x) for f, x in zip(features(), X)]))
    params = group_estimates(rows.where(~F.col("base_failed")).select("_g", "_l", *X))
    judged = _with_params(rows, params, params.count() <= BROADCAST_GROUPS, "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.col("distance") <= cut)
    return judged.select("doc_id", *COUNTS, "base_failed", "distance", kept.alias("kept"))
