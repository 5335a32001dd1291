"""Gap fill, lag-1 frame, iterated forecast and the walk-forward ridge
backtest against a brute-force NumPy version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import features as FT
from panelkit.operators import forecast as FC
from panelkit.operators.panel import fill_gaps_zero


def test_gap_filled_with_zero(spark):
    df = spark.createDataFrame([("s", 2000, 100.0), ("s", 2002, 300.0)], "s string, y long, v double")
    got = {r.y: r.v for r in fill_gaps_zero(df, "s", "y", "v").collect()}
    assert got == {2000: 100.0, 2001: 0.0, 2002: 300.0}


def test_lag1_frame(spark):
    df = spark.createDataFrame([("s", 2000, 10.0), ("s", 2001, 20.0), ("s", 2002, 40.0)], "s string, y long, v double")
    rows = FT.supervised_lag1(df, "s", "y", "v").orderBy("y").collect()
    assert [(r.y, r.lag1, r.y) for r in rows] == [(2001, 10.0, 2001), (2002, 20.0, 2002)]
    assert [r[3] for r in rows] == [20.0, 40.0]


def test_ols_matches_numpy_and_h1_equals_direct(spark):
    rng = np.random.default_rng(3)
    t = np.arange(2000, 2020, dtype=float)
    y = 50 + 3 * (t - 2000) + rng.normal(0, 2, t.size)
    rows = [("s", float(tt), float(l), float(v)) for tt, l, v in zip(t[1:], y[:-1], y[1:])]
    df = spark.createDataFrame(rows, "s string, t double, lag1 double, y double")
    o = FC.ols2(df, "s", "y", "lag1", "t").first()
    X = np.column_stack([np.ones(len(rows)), y[:-1], t[1:]])
    b = np.linalg.lstsq(X, y[1:], rcond=None)[0]
    assert [o.b0, o.b1, o.b2] == pytest.approx(list(b), rel=1e-6)
    x = spark.createDataFrame([(o.b0, o.b1, o.b2, float(y[-1]), 2019.0)], "b0 double, b1 double, b2 double, l double, t double")
    one = x.select(FC.iterate_linear("b0", "b1", "b2", "l", "t", 1).alias("p")).first().p
    assert one == pytest.approx(o.b0 + o.b1 * y[-1] + o.b2 * 2020.0)
    three = x.select(FC.iterate_linear("b0", "b1", "b2", "l", "t", 3).alias("p")).first().p
    lag = y[-1]
    for k in range(1, 4):
        lag = o.b0 + o.b1 * lag + o.b2 * (2019 + k)
    assert three == pytest.approx(lag)


def _ridge_bruteforce(X, y, alphas):
    """Refit for every left-out row (no closed form) to check the LOO choice."""
    best = None
    for a in alphas:
        errs = []
        for i in range(len(y)):
            m = np.ones(len(y), bool)
            m[i] = False
            # the scaler is fitted once on all training rows, as in the pipeline
            mu, sd = X.mean(0), X.std(0)
            Z = (X - mu) / sd
            zm, ym = Z[m].mean(0), y[m].mean()
            Zc, yc = Z[m] - zm, y[m] - ym
            w = np.linalg.solve(Zc.T @ Zc + a * np.eye(2), Zc.T @ yc)
            errs.append((y[i] - (ym + (Z[i] - zm) @ w)) ** 2)
        e = np.mean(errs)
        if best is None or e < best[0]:
            best = (e, a)
    return best[1]


def test_ridge_loo_choice_matches_bruteforce(spark):
    rng = np.random.default_rng(5)
    t = np.arange(30, dtype=float)
    lag = 100 + 5 * t + rng.normal(0, 20, t.size)
    y = 0.5 * lag + 3 * t + rng.normal(0, 10, t.size)
    df = spark.createDataFrame([("s", 99, float(a), float(b), float(c)) for a, b, c in zip(lag, t, y)],
                               "series string, anchor long, lag1 double, t double, y double")
    fit = FC.ridge_loo_fits(df, ["series", "anchor"]).first()
    X = np.column_stack([lag, t])
    alpha = _ridge_bruteforce(X, y, FC.ALPHAS)
    assert fit.alpha == pytest.approx(alpha)
    mu, sd = X.mean(0), X.std(0)
    Z = (X - mu) / sd
    Zc, yc = Z - Z.mean(0), y - y.mean()
    w = np.linalg.solve(Zc.T @ Zc + alpha * np.eye(2), Zc.T @ yc) / sd
    assert [fit.b1, fit.b2] == pytest.approx(list(w), rel=1e-8)
    assert fit.b0 == pytest.approx(y.mean() - w @ mu, rel=1e-8)


def test_backtest_runs_and_counts_anchors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in ("a", "b"):
        v = 100.0
        for p in range(40):
            v = 0.8 * v + 20 + rng.normal(0, 3)
            rows.append((s, p, float(v)))
    df = spark.createDataFrame(rows, "s string, p long, v double")
    sup = FT.supervised_lag1(df, "s", "p", "v")
    b = {(r.series, r.horizon): r for r in FC.ridge_backtest(sup, "s", "p", (1, 5)).collect()}
    # supervised rows start at p=1; first anchor = 1 + 2 + 5 = 8; last usable anchor = 39 - h
    assert b[("a", 1)].anchors_used == 39 - 8 + 1 - 1
    assert b[("a", 5)].anchors_used == 39 - 8 + 1 - 5
    assert 0 < b[("a", 1)].rmse < 20
