"""ANOVA, Kruskal-Wallis, chi-square tests and their p-values."""

import numpy as np
import pytest

from panelkit.functions.pvalues import chi2_sf, f_sf
from panelkit.operators import stats as S


def test_tail_functions_known_values():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert f_sf(4.0, 1, 1e6) == pytest.approx(chi2_sf(4.0, 1), rel=1e-4)
    assert f_sf(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5, rel=1e-9)


def _shift(spark):
    rng = np.random.default_rng(0)
    rows = [("R1", float(v), "a") for v in rng.normal(1, .1, 40)] + [("R2", float(v), "b") for v in rng.normal(8, .2, 40)]
    return spark.createDataFrame(rows, "Region string, n double, cat string")


def test_anova_and_kruskal_detect_shift(spark):
    d = _shift(spark)
    a = S.with_f_p(S.anova(d, "Region", "n")).first()
    k = S.with_chi2_p(S.kruskal(d, "Region", "n"), "h_stat", "df").first()
    assert a.f_stat > 0 and a.p_value < 1e-3 and k.p_value < 1e-3
    # no ties: H = 12/(N(N+1)) sum R^2/n - 3(N+1) with R = 820, 2420
    assert k.h_stat == pytest.approx(12 / (80 * 81) * (820 ** 2 / 40 + 2420 ** 2 / 40) - 3 * 81)


def test_gof_rejects_skew(spark):
    rows = [("Mild",)] * 50 + [("Severe",)] * 50 + [("Severe",)] * 50
    r = S.with_chi2_p(S.chi2_gof(spark.createDataFrame(rows, "c string"), "c")).first()
    assert r.df == 1 and r.p_value < 0.05


def test_independence_yates(spark):
    bal = [("a", "x")] * 30 + [("a", "y")] * 30 + [("b", "x")] * 30 + [("b", "y")] * 30
    r = S.with_chi2_p(S.chi2_independence(spark.createDataFrame(bal, "u string, v string"), "u", "v")).first()
    assert r.df == 1 and r.chi2 == 0.0 and r.p_value > 0.05
    assoc = [("a", "x")] * 60 + [("b", "y")] * 60
    r = S.with_chi2_p(S.chi2_independence(spark.createDataFrame(assoc, "u string, v string"), "u", "v")).first()
    # Yates: (|60 - 30| - 0.5)^2 / 30 * 4
    assert r.chi2 == pytest.approx(4 * 29.5 ** 2 / 30) and r.p_value < 1e-10


def test_independence_general_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, 300)
    b = rng.integers(0, 4, 300)
    df = spark.createDataFrame([(f"a{x}", f"b{y}") for x, y in zip(a, b)], "u string, v string")
    obs = np.zeros((3, 4))
    for x, y in zip(a, b):
        obs[x, y] += 1
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    r = S.chi2_independence(df, "u", "v").first()
    assert r.chi2 == pytest.approx(((obs - exp) ** 2 / exp).sum()) and r.df == 6
