"""Ridge with penalty search against NumPy: coefficients, leave-one-out, folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators.ridge import PANEL_ALPHAS, fit_ridge_cv, predicted


def data(n=90, seed=0):
    r = np.random.default_rng(seed)
    num = r.normal([5, -300, 0.01], [2, 80, 0.001], (n, 3))
    level = r.integers(0, 3, n)
    x = np.concatenate([num, np.eye(3)[level]], axis=1)  # a full set of dummies, collinear with the intercept
    y = num @ [2, 0.05, 900] + level + r.normal(0, 3, n)
    return x, y, r.integers(0, 4, n)


SCALE = [True, True, True, False, False, False]


def brute(x, y, alphas):
    """Scaled by the rows, then a refit without each row on that scale for each penalty."""
    mean, dev = x.mean(axis=0), np.where(SCALE, x.std(axis=0), 1.0)
    z = (x - mean * SCALE) / dev

    def solve(z, y, alpha):
        full = np.concatenate([np.ones((len(z), 1)), z], axis=1)
        return np.linalg.solve(full.T @ full + alpha * np.diag([0] + [1] * z.shape[1]), full.T @ y)

    keep = ~np.eye(len(y), dtype=bool)
    errors = np.array([np.mean([(y[i] - np.r_[1, z[i]] @ solve(z[keep[i]], y[keep[i]], a)) ** 2 for i in range(len(y))]) for a in alphas])
    b = solve(z, y, alphas[errors.argmin()])
    return b[0] - (b[1:] / dev) @ (mean * SCALE), b[1:] / dev, alphas[errors.argmin()], errors


def frame(spark, x, y, fold):
    rows = [(list(map(float, a)), float(b), int(f)) for a, b, f in zip(x, y, fold)]
    extra = [(None, 1.0, 0), ([1.0] * 6, None, 0), ([float("nan")] * 6, 1.0, 1)]
    return spark.createDataFrame(rows + extra, "x array<double>, y double, fold int")


def test_fit_equals_numpy(spark):
    x, y, fold = data()
    assert len(PANEL_ALPHAS) == 25
    fit, = fit_ridge_cv(frame(spark, x, y, fold), "x", "y", SCALE)
    intercept, coefficients, alpha, errors = brute(x, y, PANEL_ALPHAS)
    assert fit.alpha == alpha and fit.n == len(y)
    assert fit.coefficients == pytest.approx(coefficients, rel=1e-8, abs=1e-8) and fit.intercept == pytest.approx(intercept, rel=1e-8)
    assert fit.errors == pytest.approx(errors, rel=1e-8)


def test_each_fold_equals_a_fit_on_the_other_rows(spark):
    x, y, fold = data(70, 3)
    df = frame(spark, x, y, fold).repartition(5)
    fits = fit_ridge_cv(df, "x", "y", SCALE, fold="fold", k=4)
    for f, fit in enumerate(fits):
        intercept, coefficients, alpha, errors = brute(x[fold != f], y[fold != f], PANEL_ALPHAS)
        assert fit.alpha == alpha and fit.errors == pytest.approx(errors, rel=1e-7)
        assert fit.coefficients == pytest.approx(coefficients, rel=1e-7, abs=1e-8)
    got = df.where(F.forall("x", lambda v: ~F.isnan(v))).select("x", "fold", predicted(fits, "x", "fold").alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(fits[r.fold].intercept + np.dot(r.x, fits[r.fold].coefficients))


def test_without_rows_and_with_one_row(spark):
    df = frame(spark, *data(5))
    assert np.isnan(fit_ridge_cv(df.limit(0), "x", "y", SCALE)[0].intercept)
    alone = fit_ridge_cv(df.where("y IS NOT NULL").limit(1), "x", "y", SCALE)[0]
    assert alone.n == 1 and np.isnan(alone.coefficients).all()
