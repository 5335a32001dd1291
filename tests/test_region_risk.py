"""Group roll-up, score, group grid, past-only means, train quantile, F1
threshold (the reference's classification tests, on Spark)."""

import pytest
from pyspark.sql import functions as F

from panelkit.functions.numeric import weighted_score
from panelkit.operators import features as FT
from panelkit.operators import windows as W
from panelkit.operators.evaluate import best_f1_threshold, roc_auc
from panelkit.operators.panel import balance_panel, event_panel


def test_group_period_sums(spark):
    df = spark.createDataFrame([("A", "R1", 2000, 3.0), ("B", "R1", 2000, 5.0), ("B", "R1", 2000, 7.0)],
                               "c string, r string, y long, n double")
    g = event_panel(df, "r", "y", count_col=None, sums={"total": "n"}, distincts={"entities": "c"}).collect()
    assert len(g) == 1 and g[0].total == 15.0 and g[0].entities == 2


def test_score(spark):
    df = spark.createDataFrame([(10.0, 4.0), (0.0, 0.0)], "a double, f double")
    assert [r[0] for r in df.select(weighted_score("a", "f")).collect()] == [12.0, 0.0]


def test_group_grid(spark):
    df = spark.createDataFrame([("R1", 2000, 5.0, 1.0), ("R1", 2002, 7.0, 3.0)], "r string, y long, t double, m double")
    b = {r.y: r for r in balance_panel(df, "r", "y", zero_cols=["t"], carry_cols=["m"]).collect()}
    assert b[2001].t == 0.0 and b[2001].m == 1.0


def test_past_only_mean(spark):
    df = spark.createDataFrame([("R", 2010 + i, 10.0 * (i + 1)) for i in range(5)], "r string, y long, t double")
    x = df.select("y", W.lag_fill("t", 1, "r", "y").alias("lag1"), W.past_mean("t", "r", "y", 3, 1).alias("roll3"))
    r = {z.y: z for z in x.collect()}[2012]
    assert r.lag1 == 20.0 and r.roll3 == 15.0


def test_train_quantile_threshold(spark):
    df = spark.createDataFrame([(1.0, 2000), (2.0, 2001), (3.0, 2002), (100.0, 2003)], "s double, y long")
    lab = {r.y: r for r in FT.label_train_quantile(df, "s", "y", 2001, 0.75).collect()}
    assert lab[2000].threshold == pytest.approx(1.75)
    assert lab[2003].label == 1 and lab[2000].label == 0


def test_best_f1_threshold(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [.1, .2, .55, .7, .9])), "y int, s double")
    r = best_f1_threshold(df, "y", "s").first()
    assert r.threshold == pytest.approx(0.55) and r.f1 == pytest.approx(1.0)


def test_best_f1_one_class(spark):
    df = spark.createDataFrame([(1, .3), (1, .4)], "y int, s double")
    assert best_f1_threshold(df, "y", "s").first().threshold == 0.5


def test_auc_matches_pairs(spark):
    ys = [0, 1, 0, 1, 1, 0, 1]
    ss = [.1, .4, .35, .8, .4, .4, .9]
    df = spark.createDataFrame(list(zip(ys, ss)), "y int, s double")
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert roc_auc(df, "y", "s").first().auc == pytest.approx(exp)
