"""Forecasting on many series at once.

* Two-regressor least squares per series from covariance aggregates (one
  grouped aggregate, no driver loop); ridge on standardised regressors by
  the same 2 x 2 closed form.
* Iterated one-step forecasts in closed form per row with the ``aggregate``
  higher-order function.
* Walk-forward backtest: every row is an anchor whose training window is the
  rows before it. Moments of the windows are running aggregates per series, the
  leave-one-out errors of all penalties are arrays of one row, so no table of
  (row, anchor, penalty) exists. A series is one window partition, which the
  number of its periods bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ols2(df: DataFrame, by, y: str, x1: str, x2: str) -> DataFrame:
    """Least squares y ~ 1 + x1 + x2 per key: (b0, b1, b2, n)."""
    by = [by] if isinstance(by, str) else list(by)
    d = df.filter(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    a = d.groupBy(*by).agg(
        F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"),
        F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
        F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.try_divide(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det)
    b2 = F.try_divide(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det)
    a = a.withColumns({"b1": b1, "b2": b2})
    return a.select(*by, (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"),
                    "b1", "b2", "n")


def ridge2(df: DataFrame, by, y: str, x1: str, x2: str, alpha: float) -> DataFrame:
    """Ridge y ~ 1 + z1 + z2 with z = (x - mean) / population std and an
    unpenalised intercept (a standard scaler followed by ridge), returned as
    coefficients on the raw scale: (b0, b1, b2, n)."""
    by = [by] if isinstance(by, str) else list(by)
    d = df.filter(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    a = d.groupBy(*by).agg(
        F.var_pop(x1).alias("v1"), F.var_pop(x2).alias("v2"), F.covar_pop(x1, x2).alias("c12"),
        F.covar_pop(x1, y).alias("c1y"), F.covar_pop(x2, y).alias("c2y"),
        F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    sd1, sd2 = F.sqrt("v1"), F.sqrt("v2")
    # Z'Z and Z'y of the standardised, centred design (sums, not means)
    g11 = n + F.lit(alpha)
    g22 = n + F.lit(alpha)
    g12 = n * F.try_divide(F.col("c12"), sd1 * sd2)
    r1 = n * F.try_divide(F.col("c1y"), sd1)
    r2 = n * F.try_divide(F.col("c2y"), sd2)
    det = g11 * g22 - g12 * g12
    w1 = F.try_divide(g22 * r1 - g12 * r2, det)
    w2 = F.try_divide(g11 * r2 - g12 * r1, det)
    a = a.withColumns({"b1": F.try_divide(w1, sd1), "b2": F.try_divide(w2, sd2)})
    return a.select(*by, (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"),
                    "b1", "b2", "n")


def iterate_linear(b0, b1, b2, lag0, t0, h) -> Column:
    """H steps of ``lag <- b0 + b1 * lag + b2 * (t0 + k)``, k = 1..h."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.aggregate(F.sequence(F.lit(1), c(h) if not isinstance(h, int) else F.lit(h)),
                       c(lag0).cast("double"),
                       lambda acc, k: c(b0) + c(b1) * acc + c(b2) * (c(t0) + k))


def with_anchors(sup: DataFrame, series: str, period: str, first_anchor_offset: int = 5,
                 min_train_offset: int = 2) -> DataFrame:
    """Every supervised row, repeated once for every anchor it trains:
    anchors run from (series start + min_train_offset + first_anchor_offset)
    to the series end; a row at period t trains anchors > t. Done with
    ``explode(sequence())`` per row, never a join of rows against anchors."""
    b = sup.groupBy(series).agg(F.min(period).alias("__first"), F.max(period).alias("__last"))
    x = sup.join(b, series)
    x = x.withColumn("__min_train", F.col("__first") + min_train_offset)
    x = x.filter(F.col(period) >= F.col("__min_train"))
    lo = F.greatest(F.col(period) + 1, F.col("__min_train") + first_anchor_offset)
    return x.withColumn("anchor", F.explode(F.sequence(lo, F.col("__last")))).filter(F.col("anchor") >= lo)


def naive_backtest(sup: DataFrame, series: str, period: str, y: str, horizons=(1, 5, 10),
                   first_anchor_offset: int = 5, min_train_offset: int = 2) -> DataFrame:
    """Persistence forecast (value at the anchor) scored at anchor + h (J6
    self-join on period = anchor + h); RMSE and anchors used per horizon."""
    b = sup.groupBy(series).agg(F.min(period).alias("__first"))
    a = sup.join(b, series).filter(F.col(period) >= F.col("__first") + min_train_offset + first_anchor_offset)
    a = a.select(series, F.col(period).alias("anchor"), F.col(y).alias("y0"),
                 F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    fut = sup.select(series, F.col(period).alias("__t"), F.col(y).alias("y_true"))
    j = a.join(fut, (a[series] == fut[series]) & (F.col("__t") == F.col("anchor") + F.col("horizon"))).drop(fut[series])
    return j.groupBy(series, "horizon").agg(F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y0"), 2))).alias("rmse"),
                                            F.count(F.lit(1)).alias("anchors_used"))


# Ridge penalties tried by leave-one-out (30, log-spaced 1e-3..1e6).
ALPHAS = np.logspace(-3, 6, 30)


def ridge_loo_fits(tr: DataFrame, keys, y: str = "y", x1: str = "lag1", x2: str = "t",
                   alphas=ALPHAS) -> DataFrame:
    """Per key: ridge on standardised (x1, x2) with an unpenalised intercept,
    the penalty chosen by leave-one-out squared error, coefficients on the
    raw scale: (keys..., b0, b1, b2, alpha, n).

    All JVM-side: covariance aggregates give the 2 x 2 Gram matrix; each
    training row is repeated once per penalty (``explode`` of the fixed
    list) to get its leave-one-out residual e_i / (1 - h_i); the penalty
    with the smallest mean error (smallest penalty on ties) is kept. Keys
    with fewer than 5 rows get no fit."""
    keys = list(keys)
    st = tr.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
        F.stddev_pop(x1).alias("sd1"), F.stddev_pop(x2).alias("sd2"), F.covar_pop(x1, x2).alias("c12"),
        F.covar_pop(x1, y).alias("c1y"), F.covar_pop(x2, y).alias("c2y")).filter(F.col("n") >= 5)
    st = st.withColumns({"sd1": F.when(F.col("sd1") > 0, F.col("sd1")).otherwise(1.0),
                         "sd2": F.when(F.col("sd2") > 0, F.col("sd2")).otherwise(1.0)})
    n = F.col("n").cast("double")
    # Gram matrix and cross products of the standardised, centred design
    st = st.withColumns({
        "g12": n * F.col("c12") / (F.col("sd1") * F.col("sd2")),
        "r1": n * F.col("c1y") / F.col("sd1"), "r2": n * F.col("c2y") / F.col("sd2")})
    rows = tr.join(st, keys)
    rows = rows.withColumns({"z1": (F.col(x1) - F.col("m1")) / F.col("sd1"),
                             "z2": (F.col(x2) - F.col("m2")) / F.col("sd2"),
                             "yc": F.col(y) - F.col("my")})
    # sum z1^2 and sum z2^2 are n (or 0 for a constant column): recompute exactly
    g = rows.groupBy(*keys).agg(F.sum(F.col("z1") * F.col("z1")).alias("g11"),
                                F.sum(F.col("z2") * F.col("z2")).alias("g22"))
    rows = rows.join(g, keys).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    al = F.col("alpha")
    det = (F.col("g11") + al) * (F.col("g22") + al) - F.col("g12") * F.col("g12")
    i11, i22, i12 = (F.col("g22") + al) / det, (F.col("g11") + al) / det, -F.col("g12") / det
    w1 = i11 * F.col("r1") + i12 * F.col("r2")
    w2 = i12 * F.col("r1") + i22 * F.col("r2")
    z1, z2 = F.col("z1"), F.col("z2")
    resid = F.col("yc") - w1 * z1 - w2 * z2
    h = 1.0 / n + i11 * z1 * z1 + 2 * i12 * z1 * z2 + i22 * z2 * z2
    e = rows.withColumns({"w1": w1, "w2": w2, "loo": F.pow(resid / (1 - h), 2)})
    per = e.groupBy(*keys, "alpha").agg(F.avg("loo").alias("err"), F.first("w1").alias("w1"),
                                        F.first("w2").alias("w2"))
    best = per.groupBy(*keys).agg(F.min_by(F.struct("alpha", "w1", "w2"), F.struct("err", "alpha")).alias("b"))
    out = best.join(st.select(*keys, "n", "m1", "m2", "my", "sd1", "sd2"), keys)
    b1, b2 = F.col("b.w1") / F.col("sd1"), F.col("b.w2") / F.col("sd2")
    return out.select(*keys, (F.col("my") - b1 * F.col("m1") - b2 * F.col("m2")).alias("b0"),
                      b1.alias("b1"), b2.alias("b2"), F.col("b.alpha").alias("alpha"), "n")


def expanding_ridge(sup: DataFrame, series: str, period: str, first_anchor_offset: int = 5,
                    min_train_offset: int = 2, alphas=ALPHAS, keep=()) -> DataFrame:
    """The fit of ``ridge_loo_fits`` for every anchor of every series, on the rows
    from the series' start + ``min_train_offset`` to before the anchor: (series,
    t, y, b0, b1, b2, alpha, n) and the columns ``keep`` for the rows that are
    anchors with at least five training rows. ``sup`` has one row per (series, period) with lag1 and y."""
    own = Window.partitionBy("series")
    before = own.orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    s = sup.select(F.col(series).cast("string").alias("series"), F.col(period).cast("bigint").alias("t"),
                   F.col("lag1").cast("double").alias("lag1"), F.col("y").cast("double").alias("y"), *keep)
    s = s.withColumn("__from", F.min("t").over(own) + min_train_offset)
    used = F.col("t") >= F.col("__from")
    s = s.withColumns({"__1": F.when(used, F.col("lag1")), "__2": F.when(used, F.col("t").cast("double")), "__y": F.when(used, F.col("y"))})
    s = s.withColumns({
        "n": F.count("__y").over(before), "m1": F.avg("__1").over(before), "m2": F.avg("__2").over(before), "my": F.avg("__y").over(before),
        "sd1": F.stddev_pop("__1").over(before), "sd2": F.stddev_pop("__2").over(before), "c12": F.covar_pop("__1", "__2").over(before),
        "c1y": F.covar_pop("__1", "__y").over(before), "c2y": F.covar_pop("__2", "__y").over(before),
        "rows": F.collect_list(F.when(used, F.struct(F.col("__1").alias("a"), F.col("__2").alias("b"), F.col("__y").alias("c")))).over(before)})
    s = s.where((F.col("t") >= F.col("__from") + first_anchor_offset) & (F.col("n") >= 5))
    n = F.col("n").cast("double")
    # a constant regressor has no spread: its standardised values are 0
    s = s.withColumns({"g11": F.when(F.col("sd1") > 0, n).otherwise(0.0), "g22": F.when(F.col("sd2") > 0, n).otherwise(0.0),
                       "sd1": F.when(F.col("sd1") > 0, F.col("sd1")).otherwise(1.0), "sd2": F.when(F.col("sd2") > 0, F.col("sd2")).otherwise(1.0)})
    s = s.withColumns({"g12": n * F.col("c12") / (F.col("sd1") * F.col("sd2")), "r1": n * F.col("c1y") / F.col("sd1"), "r2": n * F.col("c2y") / F.col("sd2"),
                       "rows": F.transform("rows", lambda r: F.struct(((r["a"] - F.col("m1")) / F.col("sd1")).alias("z1"),
                                                                      ((r["b"] - F.col("m2")) / F.col("sd2")).alias("z2"), (r["c"] - F.col("my")).alias("v")))})

    def inverse(a):
        det = (F.col("g11") + a) * (F.col("g22") + a) - F.col("g12") * F.col("g12")
        return F.struct(a.alias("alpha"), ((F.col("g22") + a) / det).alias("i11"), ((F.col("g11") + a) / det).alias("i22"), (-F.col("g12") / det).alias("i12"))

    def weights(f):
        return F.struct(f["alpha"].alias("alpha"), f["i11"].alias("i11"), f["i22"].alias("i22"), f["i12"].alias("i12"),
                        (f["i11"] * F.col("r1") + f["i12"] * F.col("r2")).alias("w1"), (f["i12"] * F.col("r1") + f["i22"] * F.col("r2")).alias("w2"))

    def tried(f):
        def left_out(r):
            h = 1.0 / n + f["i11"] * r["z1"] * r["z1"] + 2 * f["i12"] * r["z1"] * r["z2"] + f["i22"] * r["z2"] * r["z2"]
            e = (r["v"] - f["w1"] * r["z1"] - f["w2"] * r["z2"]) / (1 - h)
            return e * e
        err = F.aggregate("rows", F.lit(0.0), lambda acc, r: acc + left_out(r)) / n
        return F.struct(err.alias("err"), f["alpha"].alias("alpha"), f["w1"].alias("w1"), f["w2"].alias("w2"))

    s = s.withColumn("fits", F.transform(F.array(*[F.lit(float(a)) for a in alphas]), inverse))
    s = s.withColumn("fits", F.transform("fits", weights))
    s = s.withColumn("best", F.array_min(F.transform("fits", tried)))  # least error, then least penalty
    s = s.withColumns({"b1": F.col("best.w1") / F.col("sd1"), "b2": F.col("best.w2") / F.col("sd2")})
    return s.select("series", "t", "y", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"),
                    "b1", "b2", F.col("best.alpha").alias("alpha"), "n", *keep)


def ridge_backtest(sup: DataFrame, series: str, period: str, horizons=(1, 5, 10),
                   first_anchor_offset: int = 5, min_train_offset: int = 2) -> DataFrame:
    """Walk-forward backtest of the lag-1 + period ridge, iterated to
    each horizon from the actual value at the anchor; RMSE per (series, h)."""
    later = Window.partitionBy(F.col(series)).orderBy(F.col(period).cast("bigint"))
    ahead = {f"y_after_{h}": F.max(F.col("y").cast("double")).over(later.rangeBetween(h, h)) for h in horizons}
    fits = expanding_ridge(sup.withColumns(ahead), series, period, first_anchor_offset, min_train_offset, keep=list(ahead))
    truth = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y_true")) for h, c in zip(horizons, ahead)])
    x = fits.select("series", "t", "y", "b0", "b1", "b2", F.inline(truth)).where("y_true IS NOT NULL")
    x = x.withColumn("pred", iterate_linear("b0", "b1", "b2", "y", "t", F.col("horizon").cast("int")))
    return x.groupBy("series", "horizon").agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("y_true"), 2))).alias("rmse"),
                                              F.count(F.lit(1)).alias("anchors_used"))
