"""Model wrappers: every pipeline fits and predicts, the dominant driver is
ranked first, forests predict non-negative counts (the reference's T-fit,
T-clf and T-rank intents)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import models as MD


def test_driver_ranked_first(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), "R1" if i % 2 else "R2", float(5 * a + 0.3 * b + rng.normal(0, .5)))
            for i, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))]
    df = spark.createDataFrame(rows, "sev1 double, sev2 double, region string, y double")
    s = MD.standardize(df, ["sev1", "sev2"])
    _, x, names = MD.design(s, ["sev1", "sev2"], ["region"])
    m = MD.linear(x, "y")
    top = MD.coefficient_table(spark, names, m.coefficients.toArray()).first()
    assert top.feature == "sev1"
    # OLS equals least squares by NumPy
    X = np.column_stack([np.ones(200)] + [np.array(r) for r in zip(*[(r.sev1, r.sev2, 1.0 if r.region == "R2" else 0.0)
                                                                      for r in s.collect()])])
    y = np.array([r.y for r in df.collect()])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    assert list(m.coefficients.toArray()) == pytest.approx(list(b[1:]), rel=1e-6)


def test_dummy_coding_drops_base_and_unknown(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, v double")
    model, x, names = MD.design(df, ["v"], ["g"], drop_first=True)
    assert names == ["v", "g=b", "g=c"]
    new = spark.createDataFrame([("zzz", 1.0)], "g string, v double")
    assert list(model.transform(new).first().features.toArray()) == [1.0, 0.0, 0.0]


def _clf_frame(spark, n=120, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = rng.normal(0, 1, 2)
        rows.append((i, 2000 + i % 20, float(a), float(b), float(a + 0.5 * b > 0.3)))
    df = spark.createDataFrame(rows, "id long, year long, a double, b double, y double")
    _, x, _ = MD.design(df, ["a", "b"])
    return MD.balanced_weights(x, "y")


def test_classifiers_fit_and_predict(spark):
    x = _clf_frame(spark)
    train, test = x.filter("year < 2016"), x.filter("year >= 2016")
    n_test = test.count()
    for fit in (MD.logistic, MD.tree, MD.forest_classifier):
        m = fit(train, "y")
        p = MD.positive_probability(m.transform(test))
        assert p.count() == n_test
        assert p.agg(F.min("proba"), F.max("proba")).first()[0] >= 0
    assert MD.majority(train, "y").first().majority in (0.0, 1.0)


def test_forest_regressor_non_negative_and_finite(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(abs(3 * a + rng.normal()))) for a in rng.normal(0, 1, 80)]
    df = spark.createDataFrame(rows, "a double, y double")
    _, x, _ = MD.design(df, ["a"])
    p = MD.forest_regressor(x, "y", trees=20).transform(x)
    lo, hi = p.agg(F.min("prediction"), F.max("prediction")).first()
    assert lo >= 0 and np.isfinite(hi)


def test_kmeans_and_elbow(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(c, .1, (20, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "a double, b double")
    _, x, _ = MD.design(df, ["a", "b"])
    m = MD.kmeans_best(x, 3, restarts=3)
    assert m.transform(x).select("cluster").distinct().count() == 3
    e = {r.k: r.inertia for r in MD.elbow(spark, x, range(2, 5), restarts=2).collect()}
    assert e[2] > e[3] >= e[4]
