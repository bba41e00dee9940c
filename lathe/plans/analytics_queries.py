"""Queries A1-A16, N2, N9 and T15, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.skills import inferred_sources, skill_k, skill_label, skill_operator
from lathe.operators import analytics as A
from lathe.plans.views import view, with_views


def _on(name: str, f):
    return lambda spark, sf_dir: f(view(spark, sf_dir, name))


_E, _S = partial(_on, "episodes"), partial(_on, "composed_episodes")


def _as_missing(episodes: DataFrame) -> DataFrame:
    """Episodes with missing scores and the composed-skill name of the condition."""
    condition = F.when(F.col("condition") == "curated", "skill_injected").otherwise(F.col("condition"))
    missing = F.when(F.col("ord") % 5 != 0, F.col("score"))
    passed = F.when(F.col("ord") % 15 != 0, F.col("passed"))
    return episodes.select("ord", condition.alias("condition"), missing.alias("score"), passed.alias("passed"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("skill_name")
    return view(spark, sf_dir, "episodes").select("ord", skill_operator(name).alias("operator"), skill_k(name).cast("bigint").alias("k"), skill_label(name).alias("label"), F.array_join(inferred_sources(name), "+").alias("sources"))


QUERIES = {
    "n2_effective_score": _E(lambda e: A.effective_score(_as_missing(e)).select("ord", "condition", "score")),
    "n9_mode_subset": _E(lambda e: A.mode_subset(e, "guided").select("ord", "mode", "condition")),
    "n9_treatment_modes": _E(A.treatment_modes),
    "t15_skill_names": _names,
    "a1_pass_rates": _E(A.pass_rates),
    "a2_uplift_matrix": _E(A.uplift),
    "a3_model_uplift": _E(A.model_uplift),
    "a4_pass_rate_and_uplift": _E(A.pass_rate_and_uplift),
    "a5_delta_by_mode": _E(A.delta_by_mode),
    "a6_paired_scores": _E(A.paired_scores),
    "a7_win_tie_loss": _E(A.win_tie_loss),
    "a8_token_cost": _E(A.token_cost),
    "a9_skill_delta_by_mode": _E(lambda e: A.skill_delta_by_mode(e, ["model-4"])),
    "a10_condition_pass_rates": _E(A.condition_pass_rates),
    "a11_run_verdicts": _E(A.run_verdicts),
    "a11_verdict_totals": _E(A.verdict_totals),
    "a12_composed_summary": _S(A.composed_summary),
    "a12_composed_by_skill": _S(A.composed_by_skill),
    "a13_score_by_k": _S(lambda s: A.score_by_k(s).withColumn("k", F.col("k").cast("bigint"))),
    "a14_score_by_operator": _S(A.score_by_operator),
    "a14_score_by_k_operator": _S(lambda s: A.score_by_operator(s, with_k=True)),
    "a15_composed_uplift": _S(A.composed_uplift),
    "a16_composed_win_tie_loss": _S(A.composed_win_tie_loss),
}

E, S = with_views("episodes"), with_views("composed_episodes")


def mean(value: str, where: str = "TRUE") -> str:
    return f"(CAST(sum(CAST(CASE WHEN {where} THEN {value} END AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(CASE WHEN {where} THEN {value} END), 0))"


BASE, CURATED, INJECTED = "condition = 'baseline'", "condition = 'curated'", "condition = 'skill_injected'"
UPLIFT = f"SELECT task_uid, model, {mean('score', CURATED)} - {mean('score', BASE)} AS uplift FROM episodes GROUP BY task_uid, model HAVING uplift IS NOT NULL"
RATES = f"""SELECT t.task_uid, m.model, coalesce(r.pass_rate, 0.0) AS pass_rate FROM (SELECT DISTINCT task_uid FROM episodes WHERE {BASE}) t, (SELECT DISTINCT model FROM episodes WHERE {BASE}) m
LEFT JOIN (SELECT task_uid, model, count(*) FILTER (WHERE passed) / CAST(count(*) AS DOUBLE) AS pass_rate FROM episodes WHERE {BASE} GROUP BY task_uid, model) r ON r.task_uid = t.task_uid AND r.model = m.model"""
PAIRS = """SELECT task_uid, model, mode, max_by(score, ord) FILTER (WHERE condition = 'baseline') AS baseline, max_by(score, ord) FILTER (WHERE condition = 'curated') AS curated,
max_by(tokens, ord) FILTER (WHERE condition = 'curated') AS tokens FROM episodes GROUP BY task_uid, model, mode HAVING baseline IS NOT NULL AND curated IS NOT NULL"""
OPERATOR = "CASE WHEN skill_name = '' THEN 'baseline' WHEN regexp_matches(skill_name, '^(seq|par|cond)-') THEN regexp_extract(skill_name, '^(seq|par|cond)-', 1) ELSE 'atomic' END"
BODY = "regexp_replace(skill_name, '^(seq|par|cond)-', '')"
K = f"CASE WHEN skill_name = '' THEN 0 WHEN regexp_matches(skill_name, '^(seq|par|cond)-') THEN CAST(len(regexp_extract_all({BODY}, '-(?:then|and)-')) AS BIGINT) + 1 ELSE 1 END"
SCORED = "r AS (SELECT * REPLACE (coalesce(score, CAST(passed AS DOUBLE), 0.0) AS score) FROM composed_episodes)"
VERDICTS = f"""SELECT model, mode, coalesce({mean('score', BASE)}, 0.0) AS baseline_mean, coalesce({mean('score', CURATED)}, 0.0) AS curated_mean FROM episodes GROUP BY model, mode"""
VERDICT = "CASE WHEN curated_mean - baseline_mean > 0.01 THEN 'PASS' WHEN curated_mean - baseline_mean < -0.01 THEN 'FAIL' ELSE 'NEUTRAL' END"


def _by_operator(key: str) -> str:
    return f"""{S}, {SCORED}, x AS (SELECT {key} AS operator, model, score FROM r WHERE {INJECTED}), c AS (SELECT operator, model, {mean('score')} AS mean_score FROM x GROUP BY operator, model)
SELECT o.operator, m.model, coalesce(c.mean_score, 0.0) AS mean_score FROM (SELECT DISTINCT operator FROM x) o, (SELECT DISTINCT model FROM x) m LEFT JOIN c ON c.operator = o.operator AND c.model = m.model"""


ORACLES = {
    "n2_effective_score": f"""{E}, x AS (SELECT ord, CASE WHEN condition = 'curated' THEN 'skill_injected' ELSE condition END AS condition, CASE WHEN ord % 5 <> 0 THEN score END AS score, CASE WHEN ord % 15 <> 0 THEN passed END AS passed FROM episodes)
SELECT ord, CASE WHEN condition = 'skill_injected' THEN 'curated' ELSE condition END AS condition, coalesce(score, CAST(passed AS DOUBLE)) AS score FROM x WHERE score IS NOT NULL OR passed IS NOT NULL""",
    "n9_mode_subset": f"{E} SELECT ord, mode, condition FROM episodes WHERE {BASE} UNION ALL SELECT ord, mode, condition FROM episodes WHERE mode = 'guided' AND NOT {BASE}",
    "n9_treatment_modes": f"{E} SELECT DISTINCT mode FROM episodes WHERE mode <> 'singlecall' OR NOT EXISTS (SELECT 1 FROM episodes WHERE mode <> 'singlecall')",
    "t15_skill_names": f"""{E} SELECT ord, {OPERATOR} AS operator, CAST({K} AS BIGINT) AS k, CASE WHEN {OPERATOR} = 'atomic' THEN left(skill_name, 35) WHEN skill_name = '' THEN '[baseline k=0] ' ELSE '[' || {OPERATOR} || ' k=' || CAST({K} AS VARCHAR) || '] ' || left({BODY}, 25) END AS label,
CASE WHEN contains({BODY}, '-then-') THEN replace({BODY}, '-then-', '+') WHEN contains({BODY}, '-and-') THEN replace({BODY}, '-and-', '+') ELSE {BODY} END AS sources FROM episodes""",
    "a1_pass_rates": f"{E} {RATES}",
    "a2_uplift_matrix": f"{E} {UPLIFT}",
    "a3_model_uplift": f"{E}, u AS ({UPLIFT}) SELECT model, CAST(sum(CAST(uplift AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mean_uplift, count(*) AS n_tasks FROM u GROUP BY model",
    "a4_pass_rate_and_uplift": f"{E}, p AS ({RATES}), u AS ({UPLIFT}) SELECT p.task_uid, p.model, pass_rate, coalesce(uplift, 0.0) AS uplift FROM p LEFT JOIN u ON u.task_uid = p.task_uid AND u.model = p.model",
    "a5_delta_by_mode": f"""{E}, c AS (SELECT mode, model, coalesce({mean('score', CURATED)}, 0.0) - coalesce({mean('score', BASE)}, 0.0) AS delta FROM episodes GROUP BY mode, model)
SELECT a.mode, b.model, coalesce(c.delta, 0.0) AS delta FROM (SELECT DISTINCT mode FROM episodes) a, (SELECT DISTINCT model FROM episodes) b LEFT JOIN c ON c.mode = a.mode AND c.model = b.model""",
    "a6_paired_scores": f"{E}, p AS ({PAIRS}) SELECT task_uid, model, mode, baseline, curated FROM p",
    "a7_win_tie_loss": f"""{E}, b AS (SELECT task_uid, model, max_by(score, ord) AS b FROM episodes WHERE {BASE} GROUP BY task_uid, model), c AS (SELECT task_uid, model, mode, max_by(score, ord) AS c FROM episodes WHERE {CURATED} GROUP BY task_uid, model, mode),
d AS (SELECT mode, c.model, round(c - b, 10) AS d FROM c JOIN b ON b.task_uid = c.task_uid AND b.model = c.model), n AS (SELECT mode, model, count(*) FILTER (WHERE d > 0.01) AS wins, count(*) FILTER (WHERE abs(d) <= 0.01) AS ties, count(*) FILTER (WHERE d < -0.01) AS losses FROM d GROUP BY mode, model)
SELECT x.mode, y.model, coalesce(wins, 0) AS wins, coalesce(ties, 0) AS ties, coalesce(losses, 0) AS losses FROM (SELECT DISTINCT mode FROM episodes) x, (SELECT DISTINCT model FROM episodes) y LEFT JOIN n ON n.mode = x.mode AND n.model = y.model""",
    "a8_token_cost": f"{E}, p AS ({PAIRS}) SELECT task_uid, model, mode, tokens, curated - baseline AS delta FROM p WHERE tokens > 0",
    "a9_skill_delta_by_mode": f"""{E}, e AS (SELECT * FROM episodes WHERE model <> 'model-4'), b AS (SELECT mode, coalesce({mean('score', BASE)}, 0.0) AS b FROM e GROUP BY mode), c AS (SELECT mode, skill_name, {mean('score')} AS c FROM e WHERE {CURATED} AND skill_name <> '' GROUP BY mode, skill_name)
SELECT b.mode, s.skill_name, coalesce(c.c, 0.0) - b.b AS delta FROM b, (SELECT DISTINCT skill_name FROM c) s LEFT JOIN c ON c.mode = b.mode AND c.skill_name = s.skill_name""",
    "a10_condition_pass_rates": f"""{E}, r AS (SELECT model, coalesce(count(*) FILTER (WHERE {BASE} AND passed) / CAST(nullif(count(*) FILTER (WHERE {BASE}), 0) AS DOUBLE), 0.0) AS baseline_rate, coalesce(count(*) FILTER (WHERE {CURATED} AND passed) / CAST(nullif(count(*) FILTER (WHERE {CURATED}), 0) AS DOUBLE), 0.0) AS curated_rate, CAST(grouping(model) AS INTEGER) AS is_total
FROM episodes GROUP BY ROLLUP (model)) SELECT model, baseline_rate, curated_rate, is_total, curated_rate - baseline_rate AS delta FROM r""",
    "a11_run_verdicts": f"{E}, v AS ({VERDICTS}) SELECT *, {VERDICT} AS verdict FROM v",
    "a11_verdict_totals": f"{E}, v AS ({VERDICTS}) SELECT {VERDICT} AS verdict, count(*) AS n_runs FROM v GROUP BY 1",
    "a12_composed_summary": f"""{S}, x AS (SELECT coalesce(model, 'unknown') AS model, coalesce({mean('score', BASE)}, 0.0) AS baseline_mean_score, coalesce({mean('score', INJECTED)}, 0.0) AS skill_mean_score, count(*) FILTER (WHERE {BASE} AND score IS NOT NULL) AS n_baseline, count(*) FILTER (WHERE {INJECTED} AND score IS NOT NULL) AS n_skill FROM composed_episodes GROUP BY 1)
SELECT *, skill_mean_score - baseline_mean_score AS delta FROM x""",
    "a12_composed_by_skill": f"{S} SELECT skill_name, {mean('score')} AS mean_score, count(*) AS n FROM composed_episodes WHERE {INJECTED} AND score IS NOT NULL GROUP BY skill_name",
    "a13_score_by_k": f"""{S}, {SCORED}, b AS (SELECT model, {mean('score')} AS baseline_mean FROM r WHERE {BASE} GROUP BY model), c AS (SELECT model, CAST({K} AS BIGINT) AS k, {mean('score')} AS mean_score FROM r WHERE {INJECTED} GROUP BY 1, 2)
SELECT c.model, k, mean_score, baseline_mean FROM c LEFT JOIN b ON b.model = c.model""",
    "a14_score_by_operator": _by_operator(OPERATOR),
    "a14_score_by_k_operator": _by_operator(f"'k=' || CAST({K} AS VARCHAR) || ' ' || {OPERATOR}"),
    "a15_composed_uplift": f"""{S}, {SCORED}, b AS (SELECT model, coalesce({mean('score', BASE)}, 0.0) AS b FROM r GROUP BY model), c AS (SELECT skill_name, model, {mean('score')} AS s FROM r WHERE {INJECTED} GROUP BY skill_name, model)
SELECT k.skill_name, b.model, coalesce(c.s, 0.0) - b.b AS uplift FROM (SELECT DISTINCT skill_name FROM c) k, b LEFT JOIN c ON c.skill_name = k.skill_name AND c.model = b.model""",
    "a16_composed_win_tie_loss": f"""{S}, {SCORED}, t AS (SELECT model, task_uid, {mean('score', BASE)} AS b, {mean('score', INJECTED)} AS s FROM r GROUP BY model, task_uid)
SELECT model, count(*) FILTER (WHERE s > b + 0.001) AS wins, count(*) FILTER (WHERE b IS NOT NULL AND s IS NOT NULL AND NOT s > b + 0.001 AND NOT s < b - 0.001) AS ties, count(*) FILTER (WHERE s < b - 0.001) AS losses FROM t GROUP BY model""",
}
