"""Matched-set inference against closed forms and enumeration."""

import itertools
import math

import numpy as np
import pytest

from casetide.functions import specfun
from casetide.operators import matched, multiplicity, panels, selection


def pairs(spark, positive, negative, scale=1.0, extra=()):
    rows = []
    for i in range(positive):
        rows += [(i, 1, scale, i % 5, i % 7), (i, 0, 0.0, i % 5, i % 7)]
    for i in range(positive, positive + negative):
        rows += [(i, 1, 0.0, i % 5, i % 7), (i, 0, scale, i % 5, i % 7)]
    return spark.createDataFrame(rows + list(extra), "event_id long, is_case int, x double, night long, place long")


def test_pairs_have_the_closed_form(spark):
    fit = matched.clogit(pairs(spark, 20, 10), ["x"])
    out = matched.odds_ratio(fit)
    assert fit.status == "OK"
    assert out["or"] == pytest.approx(2.0, rel=1e-6)
    assert out["se"] == pytest.approx(math.sqrt(1 / 20 + 1 / 10), rel=1e-6)


@pytest.mark.parametrize("scale", [0.001, 1e7])
def test_units_do_not_matter(spark, scale):
    out = matched.odds_ratio(matched.clogit(pairs(spark, 20, 10, scale), ["x"]), scale)
    assert out["or"] == pytest.approx(2.0, rel=1e-6)


def test_incomplete_sets_do_not_count(spark):
    extra = [(1000 + i, c, x, 0, 0) for i in range(50) for c, x in ((1, 1.0), (0, None))]
    rows = pairs(spark, 20, 10, extra=extra)
    fit = matched.clogit(rows, ["x"])
    assert (fit.n_strata, fit.n_exposed_cases, fit.n_exposed_controls) == (30, 20, 10)


def test_separation_and_too_few(spark):
    assert matched.clogit(pairs(spark, 30, 0), ["x"]).status == "SEPARATION"
    assert matched.clogit(pairs(spark, 3, 2), ["x"]).status == "TOO_FEW_STRATA"
    assert matched.odds_ratio(matched.clogit(pairs(spark, 30, 0), ["x"]))["p"] is None


def test_two_way_clusters_use_t(spark):
    fit = matched.clogit(pairs(spark, 20, 10), ["x"], clusters=["night", "place"])
    assert fit.n_clusters == 5
    out = matched.odds_ratio(fit)
    assert out["p"] == pytest.approx(2 * specfun.t_sf(abs(out["beta"] / out["se"]), 4))


def test_exact_all_exposed(spark):
    r = matched.exact_odds_ratio(pairs(spark, 100, 0), "x")
    assert r["p"] == pytest.approx(2 * 0.5**100, rel=1e-9) and r["hi"] == math.inf


def test_exact_matches_enumeration(spark):
    sizes, exposed, case = [2, 3, 4], [1, 2, 1], [1, 1, 0]
    rows = []
    for s, (n, e, c) in enumerate(zip(sizes, exposed, case, strict=True)):
        flags = [c] + [1] * (e - c) + [0] * (n - 1 - (e - c))
        rows += [(s, int(i == 0), float(f)) for i, f in enumerate(flags)]
    r = matched.exact_odds_ratio(spark.createDataFrame(rows, "event_id long, is_case int, x double"), "x")
    chance = [e / n for n, e in zip(sizes, exposed, strict=True)]
    mass = {}
    for combo in itertools.product([0, 1], repeat=3):
        p = np.prod([q if c else 1 - q for c, q in zip(combo, chance, strict=True)])
        mass[sum(combo)] = mass.get(sum(combo), 0) + p
    t = sum(case)
    assert r["p"] == pytest.approx(min(1, 2 * min(sum(v for k, v in mass.items() if k >= t), sum(v for k, v in mass.items() if k <= t))))


def test_exact_needs_binary(spark):
    with pytest.raises(ValueError):
        matched.exact_odds_ratio(pairs(spark, 20, 10, 2.0), "x")


def test_rule_refuses_dependent_cases(spark):
    rows = pairs(spark, 22, 4)
    assert matched.matched_test(rows, "x", clusters=["night"])["status"] == "UNADJUSTED_EXACT_CLUSTER_DEPENDENCE"
    assert matched.matched_test(rows, "x")["status"] == "OK_EXACT"
    assert matched.matched_test(pairs(spark, 8, 4), "x")["status"] == "NOT_TESTABLE"


def test_adjusted_values(spark):
    rows = spark.createDataFrame([(1, 0.04), (2, 0.04), (3, 0.001), (4, float("nan"))], "k long, p double").selectExpr("*", "1 AS f")
    out = {r.k: r for r in multiplicity.adjusted(rows, "p", ["f"], "k").collect()}
    assert [out[i].p_holm for i in (1, 2, 3)] == pytest.approx([0.08, 0.08, 0.003]) and out[4].p_holm is None
    assert [out[i].q_bh for i in (1, 2, 3)] == pytest.approx([0.04, 0.04, 0.003]) and out[4].q_bh is None


def test_distributions():
    assert specfun.t_ppf(0.975, 10) == pytest.approx(2.2281388520, rel=1e-8)
    assert specfun.norm_ppf(0.975) == pytest.approx(1.959963985, rel=1e-8)
    assert specfun.binom_cdf(3, 10, 0.3) == pytest.approx(0.6496107184, rel=1e-9)
    lo, hi = specfun.clopper_pearson(3, 10)
    assert (lo, hi) == pytest.approx((0.0667395, 0.6524529), rel=1e-5)
    assert matched.poisson_rate_ratio(10, 5, 100.0, 100.0)["rr"] == 2.0
    assert matched.poisson_rate_ratio(0, 0, 1.0, 1.0) is None


def test_poisson_recovers_a_rate_ratio():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, 4000).astype(float)
    n = rng.poisson(np.exp(0.3 + 0.5 * x)).astype(float)
    beta, cov, mean = panels.poisson(x[:, None], n)
    assert beta[1] == pytest.approx(0.5, abs=0.08)
    assert mean.sum() == pytest.approx(n.sum(), rel=1e-6)
    robust = panels.clustered_covariance(x[:, None], n, mean, cov, np.arange(4000) // 10)
    assert 0.5 < robust[1, 1] / cov[1, 1] < 2


def test_did_has_a_standard_error(spark):
    rng = np.random.default_rng(1)
    rows = [(u, y, int(u % 2 == 0 and y >= 3), int(rng.poisson(12 * (1.5 if u % 2 == 0 and y >= 3 else 1)))) for u in range(24) for y in range(7)]
    panel = spark.createDataFrame(rows, "u long, y long, d int, n long").selectExpr("*", "1.0D AS e")
    r = panels.difference_in_differences(panel, "u", "y", "n", "d", "e")
    assert r["rate_ratio"] == pytest.approx(1.5, rel=0.25) and 0.01 < r["se"] < 0.5


SPEC = {"candidate_id": "C1", "family": "A", "variable": "x", "hypothesis": "h", "subset": "ALL", "control_strategy": "CS1", "direction": "+", "scale": 1.0}


@pytest.mark.parametrize("scale", [None, 0, float("nan"), True, -1])
def test_bad_scales_are_refused(scale):
    with pytest.raises(ValueError):
        selection.check_spec([SPEC | {"scale": scale}])


def test_freeze_is_final(tmp_path):
    path = str(tmp_path / "frozen.json")
    selection.freeze([SPEC], path)
    assert selection.load_frozen(path) == [SPEC]
    with pytest.raises(FileExistsError):
        selection.freeze([SPEC], path)
    with open(path, "a") as f:
        f.write(" ")
    with pytest.raises(ValueError):
        selection.load_frozen(path)
    with pytest.raises(ValueError):
        selection.check_spec([SPEC, SPEC])
