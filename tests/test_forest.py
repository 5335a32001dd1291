"""Forests on many rows: the tree that MLlib grows, whole subtrees or split over tasks,
draws, scores, and no pass of MLlib over the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from panelkit.operators import forest as FO
from panelkit.operators import models as MD
from panelkit.plans import QUERIES, load_all, q_models

load_all()


def _rows(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 30, n), rng.integers(0, 9, n), rng.integers(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a - 15) / 4 - (b > 4) * (2 * c - 1)))).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y))], "id long, a double, b double, c double, y double").repartition(4)
    _, x, _ = MD.design(df, ["a", "b", "c"])
    return MD.balanced_weights(x.select("id", "features", "y"), "y")


def _each(frame):
    return {r.id: (r.p, r.prediction) for r in MD.positive_probability(frame, out="p").select("id", "p", "prediction").collect()}


@pytest.mark.parametrize("local", [FO.LOCAL_DRAWS, 700, 60])
def test_the_tree_is_the_one_that_mllib_grows(spark, monkeypatch, local):
    monkeypatch.setattr(MD, "FOREST_SMALL", 0)
    monkeypatch.setattr(FO, "LOCAL_DRAWS", local)  # the upper nodes are split by all tasks together
    monkeypatch.setattr(FO, "draws", lambda n, *_: np.ones(n, np.uint8))
    monkeypatch.setattr(FO, "BLOCK", 300)
    x = _rows(spark)
    told = DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=9, minInstancesPerNode=3).fit(x)
    got = MD.forest_classifier(x, "y", trees=1, depth=9)
    assert isinstance(got, FO.Forest) and got.totalNumNodes == told.numNodes > 50
    mine, its = _each(got.transform(x)), _each(told.transform(x))
    assert mine.keys() == its.keys() and len(its) == 4000
    assert max(abs(mine[i][0] - its[i][0]) for i in its) < 1e-9 and all(mine[i][1] == its[i][1] for i in its)
    assert got.featureImportances.toArray() == pytest.approx(told.featureImportances.toArray(), abs=1e-9)


def test_forest_is_like_that_of_mllib(spark, monkeypatch):
    monkeypatch.setattr(MD, "FOREST_SMALL", 0)
    x = _rows(spark)
    told = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=60, maxDepth=8, minInstancesPerNode=3, seed=1).fit(x)
    got = MD.forest_classifier(x, "y", trees=60, depth=8)
    assert got.getNumTrees == 60 and got.getMaxDepth() == 8 and got.totalNumNodes == pytest.approx(told.totalNumNodes, rel=0.05)
    mine, its = _each(got.transform(x)), _each(told.transform(x))
    p, q = np.array([[mine[i][0], its[i][0]] for i in its]).T
    assert np.corrcoef(p, q)[0, 1] > 0.99 and abs(p.mean() - q.mean()) < 0.01
    assert got.featureImportances.toArray() == pytest.approx(told.featureImportances.toArray(), abs=0.05)


def test_split_over_tasks_or_whole_the_draws_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(MD, "FOREST_SMALL", 0)
    x = _rows(spark, 1500)
    x.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/forest-rows")
    x = spark.read.parquet(path)
    counts = []
    for local in (FO.LOCAL_DRAWS, 400):
        monkeypatch.setattr(FO, "LOCAL_DRAWS", local)
        got = MD.forest_classifier(x, "y", trees=5, depth=6)
        for feature, _, kids, stats in got.trees:
            at = np.flatnonzero(feature >= 0)
            assert (stats[at] == stats[kids[at]].sum(1)).all() and stats[feature < 0].sum(1).min() >= 3  # no row is lost, no leaf too small
        counts.append([t[3][0].tolist() for t in got.trees])
    assert counts[0] == counts[1]


def test_draws_are_poisson_and_repeatable():
    c = FO.draws(400_000, 42, 7, 1)
    assert (c == FO.draws(400_000, 42, 7, 1)).all() and (c != FO.draws(400_000, 42, 8, 1)).any()
    share = np.bincount(c, minlength=5)[:5] / len(c)
    assert share == pytest.approx(np.exp(-1) / np.array([1, 1, 2, 6, 24]), abs=0.003)


def test_bin_borders():
    assert FO.borders(np.array([1.0, 2.0, 4.0]), np.ones(3), 32).tolist() == [1.5, 3.0]
    many = FO._shorter(np.arange(100_000.0), np.ones(100_000))
    at = FO.borders(*many, 32)
    assert len(at) == 31 and np.abs(at - np.arange(1, 32) * 3125).max() < 100


def test_many_rows_take_no_pass_of_mllib(spark, monkeypatch):
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: pytest.fail("MLlib looks at every row for every tree on every level"))
    x = _rows(spark, 300).crossJoin(spark.range(70)).drop("w")
    x = MD.balanced_weights(x.select("features", "y"), "y")
    m = MD.forest_classifier(x, "y", trees=4, depth=5)
    assert m.getNumTrees == 4 and all(t[3][0].sum() == pytest.approx(21_000, rel=0.05) for t in m.trees)
    assert MD.spread(x).count() == m.transform(x).filter(F.col("prediction").isNotNull()).count() == 21_000


SF = "/root/testdata/sf0.001"


@pytest.fixture
def grown(monkeypatch):
    """The queries' forests, small ones, all by ``operators.forest``."""
    forest = MD.forest_classifier
    monkeypatch.setattr(MD, "FOREST_SMALL", 0)
    monkeypatch.setattr(MD, "forest_classifier", lambda d, y: forest(d, y, trees=4, depth=4))
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: pytest.fail("MLlib looks at every row for every tree on every level"))


def test_classifier_metrics_of_grown_forests(spark, grown):
    out = {r.model: r for r in QUERIES["classifier_metrics"](spark, SF).collect()}
    assert set(out) == {"majority", "logistic", "tree", "forest", "forest_tuned", "forest_calibrated"}
    assert all(0 < out[m].auc < 1 for m in out if m != "majority") and out["forest"].auc == out["forest_tuned"].auc


def _test_rows(spark):
    return q_models.p1_features(spark, SF).filter(F.col("year") > q_models.P1_TRAIN_LAST_YEAR).count()


def test_two_level_risk_of_grown_forests(spark, grown):
    out = {(r.level, r.model): r for r in QUERIES["two_level_risk"](spark, SF).collect()}
    assert set(out) == {(level, m) for level in ("entity", "group") for m in ("majority", "logistic", "tree", "forest")}
    assert {out[k].n for k in out if k[0] == "entity"} == {_test_rows(spark)} and all(0 < out[level, "forest"].auc < 1 for level in ("entity", "group"))


def test_feature_importance_of_grown_forests(spark, grown):
    out = QUERIES["feature_importance"](spark, SF).collect()
    assert {r.feature for r in out} >= set(q_models.P1_FEATURES) and sum(r.importance for r in out) == pytest.approx(1.0)
    assert [r.importance for r in out] == sorted((r.importance for r in out), reverse=True)


def test_median_risk_forest_of_grown_forests(spark, grown):
    out = {r["class"]: r for r in QUERIES["median_risk_forest"](spark, SF).collect()}
    assert set(out) == {"0", "1", "accuracy", "macro avg", "weighted avg"} and out["accuracy"].support == _test_rows(spark)


def test_group_risk_rank_of_grown_forests(spark, grown):
    out = QUERIES["group_risk_rank"](spark, SF).collect()
    regions = {r.region for r in q_models.p1_features(spark, SF).select("region").distinct().collect()}
    assert {r.region for r in out} == regions and sorted(r["rank"] for r in out) == list(range(1, len(regions) + 1))
    assert [r.region for r in sorted(out, key=lambda r: r["rank"])] == [r.region for r in sorted(out, key=lambda r: (-r.mean_proba_high, r.region))]
