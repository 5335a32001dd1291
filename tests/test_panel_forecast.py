"""Panel grid, lag/lead alignment, covariate lags, leak guard, log target,
group folds (the reference's panel-forecast tests, on Spark)."""

import math

import pytest
from pyspark.sql import functions as F

from panelkit.functions.numeric import expm1_inverse, log1p_target
from panelkit.operators import features as FT
from panelkit.operators.evaluate import group_folds
from panelkit.operators.panel import balance_panel

SCHEMA = "Country string, Year long, Region string, n double, sev double, gdp double, lvl double, flag double"


def test_grid_fill_gives_zero(spark):
    df = spark.createDataFrame([("A", 2000, "R", 10.0, 1.0, 5.0, 1.0, 0.0),
                                ("A", 2002, "R", 30.0, 3.0, 7.0, 2.0, 1.0)], SCHEMA)
    b = balance_panel(df, "Country", "Year", zero_cols=["n"], carry_cols=["sev", "gdp"], attr={"Region": "Region"})
    rows = {r.Year: r for r in b.collect()}
    assert sorted(rows) == [2000, 2001, 2002]
    assert rows[2001].n == 0.0 and rows[2001].observed == 0
    assert rows[2001].gdp == 5.0  # carried forward
    assert rows[2001].Region == "R"


def test_zero_mode_does_not_carry(spark):
    df = spark.createDataFrame([("A", 2000, "R", 10.0, 1.0, 5.0, 1.0, 0.0),
                                ("A", 2002, "R", 30.0, 3.0, 7.0, 2.0, 1.0)], SCHEMA)
    b = balance_panel(df, "Country", "Year", zero_cols=["n"], carry_cols=["sev"], mode="zero")
    assert {r.Year: r.sev for r in b.collect()}[2001] == 0.0


def _five_years(spark):
    rows = [("C", 2010 + i, "R", float(i + 1), 0.0, 100.0 * (i + 1), float(i + 1), float(i % 2)) for i in range(5)]
    return spark.createDataFrame(rows, SCHEMA)


def test_lag_and_lead_alignment(spark):
    f = FT.add_panel_features(_five_years(spark), "Country", "Year", "n")
    r = {x.Year: x for x in f.collect()}[2012]
    assert r.n_lag1 == 2.0 and r.n_lag2 == 1.0 and r.y_plus1 == 4.0
    assert r.n_roll3 == pytest.approx(1.5)
    first = {x.Year: x for x in f.collect()}[2010]
    assert first.n_lag1 == 0.0 and first.n_roll3 == 0.0


def test_covariate_lags(spark):
    f = FT.add_panel_features(_five_years(spark), "Country", "Year", "n",
                              covariates={"gdp_lag1": "gdp", "lvl_lag1": "lvl", "flag_lag1": "flag"})
    r = {x.Year: x for x in f.collect()}[2012]
    assert (r.gdp_lag1, r.lvl_lag1, r.flag_lag1) == (200.0, 2.0, 1.0)


def test_leak_guard():
    FT.check_leak_free(["n_events_lag1", "price_lag1"], target="n_events")
    with pytest.raises(ValueError):
        FT.check_leak_free(["n_events_lag1", "amount"], target="n_events")
    with pytest.raises(ValueError):
        FT.check_leak_free(["n_events"], target="n_events")


def test_log_target_round_trip(spark):
    vals = [0.0, 1.0, 99.0, 1000.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    back = [r[0] for r in df.select(expm1_inverse(log1p_target("v"))).collect()]
    for a, b in zip(vals, back):
        assert math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


def test_group_folds_whole_groups(spark):
    rows = [(c, 2000 + y, 1.0) for c in "ABCDE" for y in range(6)]
    df = spark.createDataFrame(rows, "c string, y long, v double")
    folds = {r.c: r.fold for r in group_folds(df, "c", 5).collect()}
    assert sorted(folds.values()) == [0, 1, 2, 3, 4]
