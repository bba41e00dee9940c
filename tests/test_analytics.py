import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.operators import analytics as A
from lathe.operators import effectiveness as X

EPISODE = "ord long, task_uid string, model string, condition string, mode string, skill_name string, score double, passed boolean, tokens long"


def episodes(spark, *rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EPISODE)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_uplift_needs_both_sides(spark):
    e = episodes(spark, ("t1", "m", "baseline", "singlecall", "", 0.2, False, 1), ("t2", "m", "baseline", "singlecall", "", 0.5, False, 1), ("t2", "m", "curated", "singlecall", "s", 0.75, True, 1))
    assert rows_of(A.uplift(e, rounded=True), "task_uid", "uplift", "uplift_4dp") == [("t2", 0.25, 0.25)]


def test_effective_score(spark):
    e = episodes(spark, ("t", "m", "skill_injected", None, "s", None, True, 1), ("t", "m", "baseline", None, "", None, None, 1), ("t", "m", "baseline", None, "", 0.0, True, 1))
    assert rows_of(A.effective_score(e), "condition", "score") == [("baseline", 0.0), ("curated", 1.0)]


def test_modes(spark):
    e = episodes(spark, ("a", "m", "baseline", None, "", 0.0, False, 1), ("b", "m", "curated", "guided", "s", 0.0, False, 1), ("c", "m", "curated", "stepwise", "s", 0.0, False, 1))
    assert rows_of(A.mode_subset(e, "guided"), "task_uid") == [("a",), ("b",)]
    assert rows_of(A.treatment_modes(e), "mode") == [("guided",), ("stepwise",)]
    assert rows_of(A.treatment_modes(e.where("task_uid = 'a'")), "mode") == [("singlecall",)]


def test_ties_are_strict_and_last_row_wins(spark):
    e = episodes(spark, ("t", "m", "baseline", "singlecall", "", 0.9, True, 1), ("t", "m", "baseline", "guided", "", 0.10, False, 1), ("t", "m", "curated", "guided", "s", 0.11, False, 7))
    assert rows_of(A.win_tie_loss(e).where("mode = 'guided'"), "wins", "ties", "losses") == [(0, 1, 0)]
    assert rows_of(A.paired_scores(e), "mode", "baseline", "curated") == [("guided", 0.10, 0.11)]
    assert A.token_cost(e).first().tokens == 7


def test_pass_rate_grid_is_dense(spark):
    e = episodes(spark, ("t1", "a", "baseline", None, "", 0.0, True, 1), ("t2", "b", "baseline", None, "", 0.0, False, 1))
    assert rows_of(A.pass_rates(e), "task_uid", "model", "pass_rate") == [("t1", "a", 1.0), ("t1", "b", 0.0), ("t2", "a", 0.0), ("t2", "b", 0.0)]
    assert rows_of(A.pivot_models(A.pass_rates(e), "task_uid", "pass_rate", ["a", "b"]), "task_uid", "a", "b") == [("t1", 1.0, 0.0), ("t2", 0.0, 0.0)]


def test_empty_tables(spark):
    e = episodes(spark).limit(0)
    for f in (A.uplift, A.pass_rates, A.model_uplift, A.delta_by_mode, A.win_tie_loss, A.run_verdicts, A.composed_summary, A.score_by_operator, A.composed_uplift):
        assert f(e).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_partitions_do_not_matter(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(f"t{rng.integers(9)}", f"m{rng.integers(3)}", ["baseline", "curated"][rng.integers(2)], "guided", "s", float(rng.integers(101)) / 100, True, 1) for _ in range(400)]
    e = episodes(spark, *rows)
    assert rows_of(A.uplift(e.orderBy(F.rand(parts)).repartition(parts)), "task_uid", "model", "uplift") == rows_of(A.uplift(e.coalesce(1)), "task_uid", "model", "uplift")


def test_bootstrap():
    assert X.bootstrap_ci([], []) == (0.0, 0.0, 0.0)
    assert X.bootstrap_ci([0.5], [1]) == (0.5, 0.5, 0.5)
    assert X.bootstrap_ci([1.0], [3]) == (1.0, 1.0, 1.0)
    mean, low, high = X.bootstrap_ci([0.0, 1.0], [400, 600])
    assert mean == 0.6 and abs(low - (0.6 - 1.96 * np.sqrt(0.24 / 1000))) < 0.005 and abs(high - (0.6 + 1.96 * np.sqrt(0.24 / 1000))) < 0.005


def all_splits(values, a, b):
    """p over all ways to deal the rows again."""
    from itertools import combinations

    left, right = ([v for v, n in zip(values, side) for _ in range(n)] for side in (a, b))
    pool = np.array(left + right)
    seen = abs(np.mean(left) - np.mean(right))
    total = pool.sum()
    sums = [pool[list(c)].sum() for c in combinations(range(len(pool)), len(left))]
    return np.mean([abs(x / len(left) - (total - x) / len(right)) >= seen - 1e-12 for x in sums])


def test_permutation(monkeypatch):
    assert X.permutation_test([1.0], [0], [3]) == (0.0, 1.0, 0.0)
    assert X.permutation_test([1.0], [3], [3]) == (0.0, 1.0, 0.0)
    assert X.permutation_test([0.0, 1.0], [0, 40], [40, 0])[1:] == (pytest.approx(2 / math.comb(80, 40)), 0.0)
    rng = np.random.default_rng(3)
    for values in ([0.0, 1.0], [0.25, 0.5], [0.0, 0.1, 0.35], [-1.0, 0.0, 0.5, 2.0]):
        for _ in range(6):
            a, b = rng.integers(0, 4, len(values)), rng.integers(0, 4, len(values))
            if a.sum() and b.sum():
                _, p, error = X.permutation_test(values, a, b)
                assert p == pytest.approx(all_splits(values, a, b)) and error == 0.0
    values, a, b = [0.0, 0.1, 0.35, 1.0], [15, 10, 5, 20], [20, 12, 8, 10]
    _, exact, none = X.permutation_test(values, a, b)
    monkeypatch.setattr(X, "EXACT_WORK", 0)
    _, p, error = X.permutation_test(values, a, b)
    assert none == 0.0 and 0 < error < 0.01 and abs(p - exact) < 4 * error
    _, p, error = X.permutation_test([0.0, 1 / 3, math.pi], [3, 3, 3], [1, 3, 5])  # no common step
    assert error > 0


def test_large_groups_are_exact():
    _, p, error = X.permutation_test([0.0, 1.0], [600_000_000, 400_000_000], [600_020_000, 399_980_000])
    z = 20_000 / math.sqrt(2 * 1e9 * 0.4 * 0.6)
    assert error == 0.0 and p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.01)
    assert X.hypergeometric(10**9, 10**8, 10**7)[1].sum() == pytest.approx(1.0, abs=1e-5)


def test_exact_intervals():
    for n, k in ((1, 0), (1, 1), (7, 0), (7, 7), (40, 3), (1000, 600)):
        x = np.arange(n + 1)
        below = np.cumsum([math.comb(n, i) * (k / n) ** i * (1 - k / n) ** (n - i) for i in range(n + 1)]) if n < 500 else None
        low, high = X.binomial_interval(n, k)
        if below is not None:
            assert (low, high) == (x[below >= 0.025 - 1e-12][0] / n, x[below >= 0.975 - 1e-12][0] / n)
        else:
            _, sampled_low, sampled_high = X.bootstrap_ci([0.0, 1.0], [n - k, k])
            assert abs(low - sampled_low) < 0.003 and abs(high - sampled_high) < 0.003


RECORD = "problem_id string, condition string, skill_name string, domain string, passed boolean, score double"


def test_matched_baseline_is_of_any_model_and_group_tasks(spark):
    r = spark.createDataFrame([("p1", "baseline", "", "d", True, 1.0), ("p1", "baseline", "", "d", False, 0.0), ("p2", "baseline", "", "d", True, 1.0), ("p1", "curated", "s", "d", True, 1.0), ("p9", "curated", "u", "e", True, 1.0)], RECORD)
    out = {x.group: x for x in X.by_skill(r).collect()}
    assert (out["s"].n_baseline, out["s"].baseline_rate, out["s"].delta_pp) == (2, 0.5, 50.0)
    assert (out["u"].n_baseline, out["u"].treatment_rate, out["u"].delta_pp) == (0, 1.0, 0.0)
    out = {x.group: x for x in X.by_domain(r).collect()}
    assert (out["e"].n_baseline, out["e"].delta_pp) == (0, 0.0)


def test_tests_are_reproducible(spark):
    r = spark.createDataFrame([(f"p{i % 7}", ["baseline", "curated"][i % 2], "s", "d", i % 3 == 0, (i % 5) / 5) for i in range(200)], RECORD)
    first, again = (X.displayed(X.with_tests(X.matched_counts(r.repartition(n), "skill_name"), 500)).collect() for n in (1, 7))
    assert first == again and 0 < first[0].p_value <= 1 and first[0].treatment_ci_lower <= first[0].treatment_rate <= first[0].treatment_ci_upper


def test_overall_without_treatment(spark):
    r = spark.createDataFrame([("p", "baseline", "", "d", True, 1.0)], RECORD)
    assert tuple(X.overall(r).first()) == (1, 0.0, 0.0)
