"""A forest's cost: the rows on all cores, and no walk from the root at each level."""

import threading
import time

from pyspark.ml.classification import RandomForestClassifier

from panelkit.operators import models as MD
from panelkit.plans import q_models

SF = "/root/testdata/sf0.001"


def _rows(spark, n, files):
    _, x, _ = MD.design(spark.range(n, numPartitions=files).selectExpr("id * 1.0 AS a", "id % 7 * 1.0 AS b", "CAST(id % 2 AS double) AS y"), ["a", "b"])
    return MD.balanced_weights(x, "y")


def test_rows_are_dealt_over_all_cores_and_stay_whole(spark):
    cores = spark.sparkContext.defaultParallelism
    dealt = MD.spread(_rows(spark, 50 * cores, 1))
    sizes = dealt.rdd.glom().map(len).collect()
    assert len(sizes) == cores and sum(sizes) == 50 * cores and min(sizes) >= 25


def test_forest_partitions_are_bounded_by_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(MD, "FOREST_ROWS", 10)
    assert MD.spread(spark.range(25 * cores)).rdd.getNumPartitions() == -(-25 * cores // 10)


def test_forest_keeps_nodes_and_published_size(spark):
    m = MD.forest_classifier(_rows(spark, 300, 1), "y", trees=7, depth=3)
    assert m.getCacheNodeIds() and m.getNumTrees == 7 and m.getMaxDepth() == 3
    told = RandomForestClassifier(numTrees=7, maxDepth=3, minInstancesPerNode=3, labelCol="y", weightCol="w", seed=42).fit(
        MD.spread(_rows(spark, 300, 1).select("y", "features", "w")))
    assert m.toDebugString.split("\n", 1)[1] == told.toDebugString.split("\n", 1)[1]  # kept nodes change no tree


def test_features_are_written_once(spark):
    f = q_models.p1_features(spark, SF)
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def _recorded(monkeypatch):
    """Small forests; the row counts of the frames that are dealt over the cores."""
    dealt, spread, forest = [], MD.spread, MD.forest_classifier
    monkeypatch.setattr(MD, "spread", lambda df: dealt.append(df.count()) or spread(df))
    monkeypatch.setattr(MD, "forest_classifier", lambda d, y: forest(d, y, trees=3, depth=3))
    return dealt


def _train_and_test(spark):
    f = q_models.p1_features(spark, SF)
    train = f.filter(f.year <= q_models.P1_TRAIN_LAST_YEAR).count()
    return train, f.count() - train


def test_group_risk_rank_scores_all_test_rows_on_all_cores(spark, monkeypatch):
    dealt = _recorded(monkeypatch)
    out = q_models.group_risk_rank(spark, SF).collect()
    assert dealt == list(_train_and_test(spark))
    regions = {r.region for r in q_models.p1_features(spark, SF).select("region").distinct().collect()}
    assert {r.region for r in out} == regions and sorted(r["rank"] for r in out) == list(range(1, len(regions) + 1))


def test_median_risk_forest_scores_all_test_rows_on_all_cores(spark, monkeypatch):
    dealt = _recorded(monkeypatch)
    out = {r["class"]: r for r in q_models.median_risk_forest(spark, SF).collect()}
    assert dealt == list(_train_and_test(spark)) and out["accuracy"].support == dealt[1]


def test_levels_of_risk_are_fitted_at_the_same_time(spark, monkeypatch):
    _recorded(monkeypatch)
    both, fit = threading.Barrier(2), q_models._level_predictions

    def met(*args):
        both.wait(60)
        return fit(*args)

    monkeypatch.setattr(q_models, "_level_predictions", met)
    out = q_models.two_level_risk(spark, SF).collect()
    n = {(r.level, r.model): r.n for r in out}
    assert len(n) == 8 and {v for (level, _), v in n.items() if level == "entity"} == {_train_and_test(spark)[1]}


def test_calibration_holds_one_forest_at_a_time(spark):
    x = _rows(spark, 90, 2).drop("w").selectExpr("*", "CAST(a % 3 AS int) AS __fold")
    now, most = [], []

    def fit(d):
        now.append(1)
        most.append(len(now))
        time.sleep(0.5)
        m = MD.tree(MD.balanced_weights(d, "y"), "y", depth=2)
        now.pop()
        return m

    assert len(MD.isotonic_calibrate(x, "y", fit, 3)) == 3 and most == [1, 1, 1]
