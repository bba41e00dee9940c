"""Queries A17-A22 and ST1, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.operators import effectiveness as X
from lathe.plans.analytics_queries import mean
from lathe.plans.views import TRIALS, view, with_views
from lathe.sources.tables import new_folder
from lathe.streaming.progress import progress_summary, read_progress, read_table, run_to_table, summary_of_trials


def _on(f):
    return lambda spark, sf_dir: f(view(spark, sf_dir, "benchmark_records"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a stream of files, run to its end; equal to the batch summary."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    records = spark.sql(TRIALS.replace("FROM events", "FROM {events}"), events=events)
    table = new_folder(spark, "progress")
    run_to_table(records, table, new_folder(spark, "progress-checkpoint"))
    return summary_of_trials(read_table(spark, table))


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a log of JSON lines that is read, grows by all of them again and some others, and is read on from there."""
    log, table, at = (new_folder(spark, name) for name in ("progress-log", "progress", "progress-checkpoint"))
    rows = view(spark, sf_dir, "trials").withColumnRenamed("passed", "pass")
    first = F.col("repetition") % 3 < 2
    for part in (rows.where(first), rows):
        part.write.mode("append").json(log)
        run_to_table(read_progress(spark, log), table, at)
    return summary_of_trials(read_table(spark, table))


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record twice, as a log that was resumed would hold it."""
    rows = view(spark, sf_dir, "trials")
    return progress_summary(rows.union(rows))


def _tested(counts: DataFrame) -> DataFrame:
    """Tests to 6 places, as far as both engines' logarithms agree."""
    out = X.with_tests(counts)
    return out.withColumns({c: F.round(c, 6) for c in ("p_value", "treatment_ci_lower", "treatment_ci_upper")})


def _passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with 1 for passed and 0 for failed as their score."""
    return view(spark, sf_dir, "benchmark_records").withColumn("score", F.col("passed").cast("double"))


QUERIES = {
    "a17_overall_rates": _on(lambda r: X.rates(X.overall_counts(r))),
    "a18_a19_overall_tests": lambda s, d: _tested(X.overall_counts(_passing(s, d))),
    "a19_score_tests": _on(lambda r: X.with_tests(X.overall_counts(r))),
    "a20_by_skill": _on(X.by_skill),
    "a20_by_skill_tests": lambda s, d: _tested(X.matched_counts(_passing(s, d), "skill_name")),
    "a20_by_k": _on(X.by_k),
    "a20_by_composition_type": _on(X.by_composition_type),
    "a21_by_domain": _on(X.by_domain),
    "a21_by_model": _on(X.by_model),
    "a22_overall": _on(X.overall),
    "st1_progress_batch": _twice,
    "st1_progress_stream": _stream,
    "st1_progress_resumed": _resumed,
}

B = with_views("benchmark_records")
RATES = """SELECT grp AS "group", n_baseline, n_treatment, coalesce(CAST(pb AS DOUBLE) / nullif(n_baseline, 0), 0.0) AS baseline_rate, coalesce(CAST(pt AS DOUBLE) / nullif(n_treatment, 0), 0.0) AS treatment_rate,
CASE WHEN n_baseline > 0 AND n_treatment > 0 THEN (CAST(pt AS DOUBLE) / n_treatment - CAST(pb AS DOUBLE) / n_baseline) * 100.0 ELSE 0.0 END AS delta_pp FROM c"""


def _matched(key: str, where: str = "TRUE") -> str:
    return f"""{B}, t AS (SELECT * FROM (SELECT *, CAST({key} AS VARCHAR) AS grp FROM benchmark_records WHERE condition = 'curated') WHERE {where}), p AS (SELECT DISTINCT grp, problem_id FROM t),
b AS (SELECT p.grp, count(*) AS n, count(*) FILTER (WHERE passed) AS k FROM p JOIN benchmark_records r ON r.problem_id = p.problem_id AND r.condition = 'baseline' GROUP BY p.grp),
s AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE passed) AS k FROM t GROUP BY grp), c AS (SELECT s.grp, coalesce(b.n, 0) AS n_baseline, s.n AS n_treatment, coalesce(b.k, 0) AS pb, s.k AS pt FROM s LEFT JOIN b ON b.grp = s.grp) {RATES}"""


def _keyed(key: str) -> str:
    return f"""{B}, c AS (SELECT CAST({key} AS VARCHAR) AS grp, count(*) FILTER (WHERE condition = 'baseline') AS n_baseline, count(*) FILTER (WHERE condition = 'curated') AS n_treatment, count(*) FILTER (WHERE condition = 'baseline' AND passed) AS pb,
count(*) FILTER (WHERE condition = 'curated' AND passed) AS pt FROM benchmark_records WHERE condition IN ('baseline', 'curated') GROUP BY 1) {RATES}"""


#: The permutations' hypergeometric tail and the resamples' binomial quantiles, over all numbers of passed trials.
TESTS = """, pk AS (SELECT *, unnest(range(greatest(0, pt + pb - n_baseline), least(n_treatment, pt + pb) + 1)) AS k FROM c WHERE n_baseline > 0 AND n_treatment > 0),
pp AS (SELECT grp, sum(exp(lgamma(pt + pb + 1) - lgamma(k + 1) - lgamma(pt + pb - k + 1) + lgamma(n_treatment + n_baseline - pt - pb + 1) - lgamma(n_treatment - k + 1) - lgamma(n_baseline - pt - pb + k + 1)
    - lgamma(n_treatment + n_baseline + 1) + lgamma(n_treatment + 1) + lgamma(n_baseline + 1)))
  FILTER (WHERE abs(k / CAST(n_treatment AS DOUBLE) - (pt + pb - k) / CAST(n_baseline AS DOUBLE)) >= abs(pt / CAST(n_treatment AS DOUBLE) - pb / CAST(n_baseline AS DOUBLE)) - 1e-12) AS p FROM pk GROUP BY grp),
bx AS (SELECT grp, n_treatment, pt, unnest(range(0, n_treatment + 1)) AS x FROM c WHERE n_baseline > 0 AND n_treatment > 0),
bc AS (SELECT grp, n_treatment, x, sum(CASE WHEN pt = 0 THEN CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END WHEN pt = n_treatment THEN CASE WHEN x = n_treatment THEN 1.0 ELSE 0.0 END
  ELSE exp(lgamma(n_treatment + 1) - lgamma(x + 1) - lgamma(n_treatment - x + 1) + x * ln(pt / CAST(n_treatment AS DOUBLE)) + (n_treatment - x) * ln(1 - pt / CAST(n_treatment AS DOUBLE))) END) OVER (PARTITION BY grp ORDER BY x) AS below FROM bx),
ci AS (SELECT grp, min(x) FILTER (WHERE below >= 0.025 - 1e-12) / CAST(any_value(n_treatment) AS DOUBLE) AS lo, min(x) FILTER (WHERE below >= 0.975 - 1e-12) / CAST(any_value(n_treatment) AS DOUBLE) AS hi FROM bc GROUP BY grp),
rated AS (RATES) SELECT rated.*, round(least(1.0, coalesce(pp.p, 1.0)), 6) AS p_value, CAST(0.0 AS DOUBLE) AS p_error, round(ci.lo, 6) AS treatment_ci_lower, round(ci.hi, 6) AS treatment_ci_upper
FROM rated LEFT JOIN pp ON pp.grp = rated."group" LEFT JOIN ci ON ci.grp = rated."group" """


def _with_tests(sql: str) -> str:
    """SQL that ends with RATES, with the tests."""
    return sql.removesuffix(RATES).rstrip() + TESTS.replace("RATES", RATES)


def _rate(c: str) -> str:
    return f"(CAST(count(*) FILTER (WHERE condition = '{c}' AND passed) AS DOUBLE) / nullif(count(*) FILTER (WHERE condition = '{c}'), 0))"


PROGRESS = f"""{with_views("trials")} SELECT model, condition, count(*) AS n_trials, count(*) FILTER (WHERE passed) / CAST(count(*) AS DOUBLE) AS pass_rate, {mean('score')} AS mean_score, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM trials GROUP BY model, condition"""

OVERALL = f"""{B}, g AS (SELECT * FROM (VALUES ('curated'), ('self_generated')) v(grp)), c AS (SELECT grp, count(*) FILTER (WHERE condition = 'baseline') AS n_baseline, count(*) FILTER (WHERE condition = grp) AS n_treatment,
count(*) FILTER (WHERE condition = 'baseline' AND passed) AS pb, count(*) FILTER (WHERE condition = grp AND passed) AS pt FROM g, benchmark_records GROUP BY grp) {RATES}"""

ORACLES = {
    "a17_overall_rates": OVERALL,
    "a18_a19_overall_tests": _with_tests(OVERALL),
    "a20_by_skill_tests": _with_tests(_matched("skill_name")),
    "a20_by_skill": _matched("skill_name"),
    "a20_by_k": _matched("k_value"),
    "a20_by_composition_type": _matched("composition_type", "grp <> ''"),
    "a21_by_domain": _keyed("domain"),
    "a21_by_model": _keyed("model"),
    "a22_overall": f"{B} SELECT count(*) AS total_trials, coalesce(({_rate('curated')} - {_rate('baseline')}) * 100.0, 0.0) AS curated_delta_pp, coalesce(({_rate('self_generated')} - {_rate('baseline')}) * 100.0, 0.0) AS self_generated_delta_pp FROM benchmark_records",
    "st1_progress_batch": PROGRESS,
    "st1_progress_stream": PROGRESS,
    "st1_progress_resumed": PROGRESS,
}
