"""Evaluation analytics over episodes (task_uid, model, condition, mode, skill_name, score, passed, tokens, ord).

All means are order-independent and unrounded. Matrices come in long form; use
``pivot_models`` for the wide form of a known list of models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.numeric import exact_mean, mean_or_zero, n_where
from lathe.functions.skills import skill_k, skill_operator


def _is(condition: str) -> Column:
    return F.col("condition") == condition


def _mode() -> Column:
    return F.coalesce("mode", F.lit("singlecall"))


def _grid(df: DataFrame, *keys: str) -> DataFrame:
    """Every combination of the distinct values of two key columns: the dense matrix that is asked for. Spark chooses the join by size."""
    return df.select(keys[0]).distinct().crossJoin(df.select(keys[1]).distinct())


def pivot_models(long: DataFrame, key: str, value: str, models: Sequence[str]) -> DataFrame:
    """Wide matrix with one column per listed model, missing cells 0."""
    return long.groupBy(key).pivot("model", list(models)).agg(F.first(value)).fillna(0.0)


def effective_score(episodes: DataFrame) -> DataFrame:
    """``skill_injected`` becomes ``curated``; score, else 1/0 from passed; rows with neither are dropped."""
    score = F.coalesce("score", F.col("passed").cast("double"))
    condition = F.when(_is("skill_injected"), "curated").otherwise(F.col("condition"))
    return episodes.withColumn("condition", condition).withColumn("score", score).where(F.col("score").isNotNull())


def mode_subset(episodes: DataFrame, mode: str) -> DataFrame:
    """All baselines, and the other rows of ``mode``; a missing mode is singlecall."""
    return episodes.where(_is("baseline") | ((_mode() == mode) & ~F.coalesce(_is("baseline"), F.lit(False))))


def treatment_modes(episodes: DataFrame) -> DataFrame:
    """The modes to report on: every mode but singlecall, unless it is the only one."""
    modes = episodes.select(_mode().alias("mode")).distinct()
    other = modes.agg(n_where(F.col("mode") != "singlecall").alias("_n"))
    return modes.crossJoin(F.broadcast(other)).where((F.col("mode") != "singlecall") | (F.col("_n") == 0)).select("mode")


def pass_rates(episodes: DataFrame, condition: str = "baseline") -> DataFrame:
    """A1: pass rate of each task and model seen under ``condition``, 0 where a pair has no row."""
    rows = episodes.where(_is(condition))
    rates = rows.groupBy("task_uid", "model").agg((n_where(F.col("passed")) / F.count("*")).alias("pass_rate"))
    return _grid(rows, "task_uid", "model").join(rates, ["task_uid", "model"], "left").fillna(0.0, ["pass_rate"])


def uplift(episodes: DataFrame, rounded: bool = False) -> DataFrame:
    """A2: mean curated minus mean baseline score of each (task, model) that has both."""
    base, curated = exact_mean(F.col("score"), _is("baseline")), exact_mean(F.col("score"), _is("curated"))
    out = episodes.groupBy("task_uid", "model").agg((curated - base).alias("uplift")).where("uplift is not null")
    return out.withColumn("uplift_4dp", F.round("uplift", 4)) if rounded else out


def model_uplift(episodes: DataFrame) -> DataFrame:
    """A3: models by mean uplift over their tasks, highest first."""
    return uplift(episodes).groupBy("model").agg((F.sum(F.col("uplift").cast("decimal(28,12)")).cast("double") / F.count("*")).alias("mean_uplift"), F.count("*").alias("n_tasks")).orderBy(F.desc("mean_uplift"), "model")


def pass_rate_and_uplift(episodes: DataFrame) -> DataFrame:
    """A4: baseline pass rate and uplift on the baseline's task x model grid, 0 where missing."""
    return pass_rates(episodes).join(uplift(episodes), ["task_uid", "model"], "left").fillna(0.0, ["uplift"])


def delta_by_mode(episodes: DataFrame) -> DataFrame:
    """A5: mean curated minus mean baseline per (mode, model); an empty side is 0. A curated row must have a mode."""
    rows = episodes.withColumn("_own", F.col("mode").isNotNull()).withColumn("mode", _mode())
    base, curated = mean_or_zero(F.col("score"), _is("baseline")), mean_or_zero(F.col("score"), _is("curated") & F.col("_own"))
    cells = rows.groupBy("mode", "model").agg((curated - base).alias("delta"))
    return _grid(rows, "mode", "model").join(cells, ["mode", "model"], "left").fillna(0.0, ["delta"])


def _last(value: str, condition: str) -> Column:
    """Value of the last row (by ord) of a condition."""
    return F.max_by(F.when(_is(condition), F.coalesce(F.col(value), F.lit(0))), F.when(_is(condition), F.col("ord")))


def paired_scores(episodes: DataFrame) -> DataFrame:
    """The last baseline and curated score of each (task, model, mode) that has both."""
    rows = episodes.withColumn("mode", _mode()).groupBy("task_uid", "model", "mode")
    return rows.agg(_last("score", "baseline").alias("baseline"), _last("score", "curated").alias("curated")).where("baseline is not null and curated is not null")


def win_tie_loss(episodes: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Wins, ties and losses per (mode, model) of the last curated against the last baseline score of a task.

    Baselines come from every mode. A delta beyond ``threshold`` decides; deltas
    are compared to ten decimals, so that 0.01 itself is a tie.
    """
    base = episodes.where(_is("baseline")).groupBy("task_uid", "model").agg(_last("score", "baseline").alias("_b"))
    rows = episodes.withColumn("mode", _mode())
    curated = rows.where(_is("curated")).groupBy("task_uid", "model", "mode").agg(_last("score", "curated").alias("_c"))
    delta = F.round(F.col("_c") - F.col("_b"), 10)
    cells = curated.join(base, ["task_uid", "model"]).groupBy("mode", "model").agg(n_where(delta > threshold).alias("wins"), n_where(F.abs(delta) <= threshold).alias("ties"), n_where(delta < -threshold).alias("losses"))
    return _grid(rows, "mode", "model").join(cells, ["mode", "model"], "left").fillna(0, ["wins", "ties", "losses"])


def token_cost(episodes: DataFrame) -> DataFrame:
    """Tokens of the last curated row against the score delta, per (task, model, mode) with tokens above 0."""
    rows = episodes.withColumn("mode", _mode()).groupBy("task_uid", "model", "mode")
    pairs = rows.agg(_last("score", "baseline").alias("_b"), _last("score", "curated").alias("_c"), _last("tokens", "curated").alias("tokens"))
    return pairs.where("_b is not null and _c is not null and tokens > 0").select("task_uid", "model", "mode", "tokens", (F.col("_c") - F.col("_b")).alias("delta"))


def skill_delta_by_mode(episodes: DataFrame, excluded_models: Sequence[str] = ("claude-opus-4-6", "glm-5-turbo")) -> DataFrame:
    """Per mode and skill, mean curated score of the skill minus the mode's mean baseline score; an empty side is 0."""
    rows = episodes.where(~F.col("model").isin(list(excluded_models))).withColumn("_own", F.col("mode").isNotNull()).withColumn("mode", _mode())
    base = rows.groupBy("mode").agg(mean_or_zero(F.col("score"), _is("baseline")).alias("_b"))
    curated = rows.where(_is("curated") & (F.col("skill_name") != ""))
    skills = curated.select("skill_name").distinct()
    cells = curated.where("_own").groupBy("mode", "skill_name").agg(exact_mean(F.col("score")).alias("_c"))
    grid = skills.crossJoin(base)
    return grid.join(cells, ["mode", "skill_name"], "left").select("mode", "skill_name", (F.coalesce("_c", F.lit(0.0)) - F.col("_b")).alias("delta"))


def condition_pass_rates(episodes: DataFrame) -> DataFrame:
    """A10: baseline and curated pass rate and their delta, per model and overall (model null)."""
    rate = lambda c: F.coalesce(n_where(_is(c) & F.col("passed")) / F.nullif(n_where(_is(c)), F.lit(0)), F.lit(0.0))
    out = episodes.rollup("model").agg(rate("baseline").alias("baseline_rate"), rate("curated").alias("curated_rate"), F.grouping("model").cast("int").alias("is_total"))
    return out.withColumn("delta", F.col("curated_rate") - F.col("baseline_rate"))


def run_verdicts(episodes: DataFrame, threshold: float = 0.01) -> DataFrame:
    """PASS, FAIL or NEUTRAL per (model, mode) by the sign of the mean score delta beyond ``threshold``."""
    base, curated = mean_or_zero(F.col("score"), _is("baseline")), mean_or_zero(F.col("score"), _is("curated"))
    out = episodes.withColumn("mode", _mode()).groupBy("model", "mode").agg(base.alias("baseline_mean"), curated.alias("curated_mean"))
    delta = F.col("curated_mean") - F.col("baseline_mean")
    return out.withColumn("verdict", F.when(delta > threshold, "PASS").when(delta < -threshold, "FAIL").otherwise("NEUTRAL"))


def verdict_totals(episodes: DataFrame) -> DataFrame:
    return run_verdicts(episodes).groupBy("verdict").agg(F.count("*").alias("n_runs"))


# composed-skill: the treated condition is skill_injected.


def composed_summary(episodes: DataFrame) -> DataFrame:
    """Per model, means over rows that have a score, their delta and counts."""
    model = F.coalesce("model", F.lit("unknown")).alias("model")
    score = F.col("score")
    n = lambda c: n_where(_is(c) & score.isNotNull())
    out = episodes.groupBy(model).agg(mean_or_zero(score, _is("baseline")).alias("baseline_mean_score"), mean_or_zero(score, _is("skill_injected")).alias("skill_mean_score"), n("baseline").alias("n_baseline"), n("skill_injected").alias("n_skill"))
    return out.withColumn("delta", F.col("skill_mean_score") - F.col("baseline_mean_score"))


def composed_by_skill(episodes: DataFrame) -> DataFrame:
    """Mean score and number of scored rows of each skill."""
    return episodes.where(_is("skill_injected") & F.col("score").isNotNull()).groupBy("skill_name").agg(exact_mean(F.col("score")).alias("mean_score"), F.count("*").alias("n"))


def _scored(episodes: DataFrame) -> DataFrame:
    """A missing score is 1 or 0 by passed."""
    return episodes.withColumn("score", F.coalesce("score", F.col("passed").cast("double"), F.lit(0.0)))


def score_by_k(episodes: DataFrame) -> DataFrame:
    """Mean skill score per (model, k), with the model's mean baseline score (null without one)."""
    rows = _scored(episodes)
    base = rows.where(_is("baseline")).groupBy("model").agg(exact_mean(F.col("score")).alias("baseline_mean"))
    cells = rows.where(_is("skill_injected")).groupBy("model", skill_k(F.col("skill_name")).alias("k")).agg(exact_mean(F.col("score")).alias("mean_score"))
    return cells.join(base, "model", "left")


def score_by_operator(episodes: DataFrame, with_k: bool = False) -> DataFrame:
    """Mean skill score per operator (and k) and model, 0 for a missing cell."""
    operator, k = skill_operator(F.col("skill_name")), skill_k(F.col("skill_name")).cast("string")
    row = F.concat(F.lit("k="), k, F.lit(" "), operator) if with_k else operator
    rows = _scored(episodes).where(_is("skill_injected")).withColumn("operator", row)
    cells = rows.groupBy("operator", "model").agg(exact_mean(F.col("score")).alias("mean_score"))
    return _grid(rows, "operator", "model").join(cells, ["operator", "model"], "left").fillna(0.0, ["mean_score"])


def composed_uplift(episodes: DataFrame) -> DataFrame:
    """Per skill and model, mean skill score (0 if none) minus the model's mean baseline score (0 if none)."""
    rows = _scored(episodes)
    base = rows.groupBy("model").agg(mean_or_zero(F.col("score"), _is("baseline")).alias("_b"))
    treated = rows.where(_is("skill_injected"))
    cells = treated.groupBy("skill_name", "model").agg(exact_mean(F.col("score")).alias("_s"))
    grid = treated.select("skill_name").distinct().crossJoin(base)
    return grid.join(cells, ["skill_name", "model"], "left").select("skill_name", "model", (F.coalesce("_s", F.lit(0.0)) - F.col("_b")).alias("uplift"))


def composed_win_tie_loss(episodes: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Wins, ties and losses per model of a task's mean skill score against its mean baseline score."""
    score = F.col("score")
    tasks = _scored(episodes).groupBy("model", "task_uid").agg(exact_mean(score, _is("baseline")).alias("_b"), exact_mean(score, _is("skill_injected")).alias("_s"))
    both = F.col("_b").isNotNull() & F.col("_s").isNotNull()
    win, loss = both & (F.col("_s") > F.col("_b") + threshold), both & (F.col("_s") < F.col("_b") - threshold)
    return tasks.groupBy("model").agg(n_where(win).alias("wins"), n_where(both & ~win & ~loss).alias("ties"), n_where(loss).alias("losses"))
