"""pandas-vs-Spark semantic traps (T1-T20) on toy frames."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.functions.numeric import flag, ordinal_bucket
from panelkit.functions.text import coerce_long, sentinel_to_null, strip_ws
from panelkit.operators import quality as Q
from panelkit.operators import windows as W
from panelkit.operators.panel import event_panel, first_non_null, mode_two_level
from panelkit.operators.stats import average_rank, exact_quantiles


def test_coerce_and_strip(spark):
    df = spark.createDataFrame([("2000.0",), ("x12",), ("\t 1999 \n",), (None,)], "v string")
    out = df.select(coerce_long(strip_ws("v")).alias("y"), strip_ws("v").alias("s")).collect()
    assert [r.y for r in out] == [2000, None, 1999, None]
    assert out[2].s == "1999"


def test_sentinel(spark):
    df = spark.createDataFrame([("Unknown",), (" UNKNOWN ",), ("",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(sentinel_to_null("v")).collect()]
    assert got == [None, None, None, "x", None]


def test_mode_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", None), ("b", None)], "k string, v string")
    p = {r.k: r.m for r in event_panel(df.withColumn("p", F.lit(1)), "k", "p", modes={"m": "v"}).collect()}
    assert p == {"a": "b", "b": None}
    two = {r.k: r.m for r in mode_two_level(df, ["k"], "v", "m").collect()}
    assert two == {"a": "b"}


def test_sum_of_all_null_is_zero(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, p int, v double")
    r = event_panel(df, "k", "p", sums={"s": "v"}).first()
    assert r.s == 0.0 and r.n_events == 1


def test_first_non_null_in_order(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 7.0)], "k string, o int, v double")
    assert first_non_null(df, ["k"], "v", "o").first().v == 5.0


def test_last_non_null_per_column(spark):
    df = spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 2, None, "y"), ("a", 3, 3.0, None)],
                               "k string, t int, v double, c string")
    r = W.latest_non_null(df, "k", "t", ["v", "c"]).first()
    assert (r.t, r.v, r.c) == (3, 3.0, "y")


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert exact_quantiles(df, "v", {"q": 0.75}).first().q == pytest.approx(1.75)
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for p in (0.1, 0.25, 0.5, 0.9):
        assert exact_quantiles(df, "v", {"q": p}).first().q == pytest.approx(pd.Series(vals).quantile(p))


def test_average_rank_matches_pandas(spark):
    vals = [5.0, 1.0, 5.0, 3.0, 3.0, 3.0, 9.0, 0.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r.v: r.avg_rank for r in average_rank(df, "v", (), buckets=3).collect()}
    exp = dict(zip(vals, pd.Series(vals).rank()))
    assert got == exp


def test_interpolate_matches_pandas(spark):
    vals = [None, 2.0, None, None, 8.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "k string, t int, v double")
    got = [r.v for r in W.interpolate_df(df, ["v"], "k", "t").orderBy("t").collect()]
    exp = pd.Series(vals, dtype=float).interpolate(method="linear", limit_direction="both").tolist()
    assert got == pytest.approx(exp)


def test_rolling_counts_rows_not_periods(spark):
    df = spark.createDataFrame([("a", 1990, 1.0), ("a", 1994, 2.0), ("a", 1995, 3.0)], "k string, t int, v double")
    r = df.select("t", W.trailing_mean("v", "k", "t", 3, 3).alias("m"), W.growth("v", "k", "t").alias("g")) \
          .orderBy("t").collect()
    assert r[2].m == pytest.approx(2.0)
    assert r[1].g == pytest.approx(1.0)  # 1994 compared with 1990, the previous existing row


def test_null_comparison_flag(spark):
    df = spark.createDataFrame([(None,), (2.0,)], "v double")
    assert [r[0] for r in df.select(flag(F.col("v") > 1)).collect()] == [0, 1]


def test_distinct_counts_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "v string")
    assert Q.profile_distinct(df, ["v"]).first().n_distinct == 2


def test_ordinal_bucket():
    from panelkit.functions.numeric import LEVEL_BOUNDS
    assert LEVEL_BOUNDS[0] == 10 and len(LEVEL_BOUNDS) == 9


def test_ordinal_bucket_values(spark):
    vals = [0.0, -1.0, 10.0, 10.5, 5000.0, 5000.1, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r[0] for r in df.select(ordinal_bucket("v")).collect()] == [0, 1, 1, 2, 9, 10, None]


def test_ansi_safe_corr_on_constant(spark):
    from panelkit.operators.stats import pearson_pairs
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert pearson_pairs(df, ["a", "b"]).first().r is None


def test_prefix_sums_match_sequential(spark):
    import numpy as np
    from panelkit.operators.prefix import prefix_sums
    rng = np.random.default_rng(9)
    rows = [(p, float(k), i, float(d)) for p in ("a", "b") for i, (k, d) in
            enumerate(zip(rng.choice([0.5, 1.0, 2.0, 40.0, 1e4], 60), rng.normal(0, 1, 60)))]
    df = spark.createDataFrame(rows, "p string, k double, i long, d double")
    for log_scale in (False, True):
        got = {(r.p, r.i): r.d_cum for r in prefix_sums(df, "p", "k", ["i"], ["d"], buckets=3,
                                                         log_scale=log_scale).collect()}
        for p in ("a", "b"):
            seq = sorted((k, i, d) for q, k, i, d in rows if q == p)
            acc = 0.0
            for k, i, d in seq:
                acc += d
                assert got[(p, i)] == pytest.approx(acc)


def test_row_numbers_total_order(spark):
    from panelkit.operators.prefix import row_numbers
    rows = [(f"g{i:03d}", (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, size long")
    got = {r.g: r.rn for r in row_numbers(df, [F.col("size").desc(), F.col("g").asc()], parts=7).collect()}
    exp = {g: i + 1 for i, (g, _) in enumerate(sorted(rows, key=lambda t: (-t[1], t[0])))}
    assert got == exp
