"""Operators that no query shows alone: row filters, sinks, polynomial and boosted fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import clean as C
from panelkit.operators import features as FT
from panelkit.operators import models as MD
from panelkit.sources import sinks as SK


def test_complete_cases_and_empty_strings(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, " \t", 2.0), (4, "b", None)], "k int, t string, v double")
    assert [r.k for r in C.complete_cases(df, ["t", "v"]).orderBy("k").collect()] == [1, 3]
    assert [r.k for r in C.drop_empty(df, "t").orderBy("k").collect()] == [1, 4]


def test_excluded_names_as_list_and_as_table(spark):
    df = spark.createDataFrame([(1, " World "), (2, "Peru"), (3, None), (4, "world")], "k int, name string")
    names = spark.createDataFrame([("World",), ("Asia ",)], "n string")
    for exclude in (["World", "Asia"], names):
        assert sorted(r.k for r in C.entity_rows(df, name_col="name", exclude_names=exclude).collect()) == [2, 3, 4]
    assert C.entity_rows(df, name_col="name").count() == 4


def test_json_sink(spark, tmp_path):
    SK.write_json(spark.createDataFrame([(1, "é")], "k int, t string"), str(tmp_path / "j"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "j")).collect()] == [(1, "é")]


def frame(spark, f, n=400, seed=3):
    r = np.random.default_rng(seed)
    x = r.uniform(-2, 2, (n, 2))
    rows = [(i, float(a), float(b), float(f(a, b) + r.normal(0, 0.1))) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "i long, a double, b double, y double")
    return MD.design(df, ["a", "b"])[1], np.array([z[1:] for z in rows])


def test_poly2_equals_least_squares_on_squares_and_product(spark):
    x, data = frame(spark, lambda a, b: 1 + 2 * a - b + 0.5 * a * a + 3 * a * b)
    a, b, y = data.T
    design = np.column_stack([np.ones(len(y)), a, a * a, b, a * b, b * b])
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = [r.prediction for r in MD.poly2(x, "y").transform(x).orderBy("i").collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_boosting_stops_early_and_beats_least_squares_on_a_step(spark):
    x, _ = frame(spark, lambda a, b: 5.0 * (a > 0) + 2.0 * (b > 1))
    x = x.withColumn("held", F.pmod(FT.scramble(F.col("i") * 31 + 7), F.lit(10)) == 0).withColumn("test", F.col("i") % 4 == 0)
    train, test = x.filter("NOT test"), x.filter("test")
    model = MD.gbt(train, "y", max_iter=120, depth=4, step=0.1, validation_col="held")
    assert model.getNumTrees < 120  # a few rounds are enough here
    rmse = {name: m.transform(test).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
            for name, m in (("gbt", model), ("ols", MD.linear(train, "y")))}
    assert rmse["gbt"] < 0.6 * rmse["ols"]
