"""Descriptive operators: totals, means, shares, top-k, frequency, summary,
driver tables, pivots, crosstab, histogram, trend and entity profiles.

Global quantities (a grand total, min/max for bins) are one-row aggregates
attached with a broadcast - never ``sum(...) over ()``, which would move
every row into a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from .joins import with_scalars


def totals_by(df: DataFrame, by, value: str, out: str = "total") -> DataFrame:
    """Sum per key, largest first (key as tie-break)."""
    by = [by] if isinstance(by, str) else list(by)
    return (df.groupBy(*by).agg(F.coalesce(F.sum(value), F.lit(0)).alias(out))
              .orderBy(F.col(out).desc(), *by))


def means_by(df: DataFrame, by, value: str, out: str = "mean") -> DataFrame:
    """Mean per key, largest first."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.avg(value).alias(out)).orderBy(F.col(out).desc(), *by)


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """Distributed top-k (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group, order, k: int, out: str = "rank") -> DataFrame:
    """Exact top-k rows per group without sending a whole group to one task:
    first the top k inside each (group, input partition) - every global
    top-k row is among them - then the top k of those survivors (at most
    k x partitions rows per group). ``order`` must be a total order."""
    group = [group] if isinstance(group, str) else list(group)
    x = df.withColumn("__pid", F.spark_partition_id())
    local = Window.partitionBy(*group, "__pid").orderBy(*order)
    x = x.withColumn("__r", F.row_number().over(local)).filter(F.col("__r") <= k).drop("__r", "__pid")
    glob = Window.partitionBy(*group).orderBy(*order)
    return x.withColumn(out, F.row_number().over(glob)).filter(F.col(out) <= k)


def share_of_total(df: DataFrame, by, value: str, places: int = 1) -> DataFrame:
    """Per-key total and its percent share of the grand total."""
    by = [by] if isinstance(by, str) else list(by)
    g = df.groupBy(*by).agg(F.sum(value).alias("total"))
    tot = g.agg(F.sum("total").alias("__grand"))  # the same aggregate again, so its exchange is reused
    return (with_scalars(g, tot)
            .withColumn("share_pct", F.round(F.try_divide(F.col("total") * 100.0, F.col("__grand")), places))
            .drop("__grand"))


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Value counts."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def summary_stats(df: DataFrame, cols, places: int = 6) -> DataFrame:
    """Mean, median, sample std, min, max per column (long form); the
    median is exact and distributed."""
    from .quality import _stack
    from .stats import column_quantiles
    m = {"mean": F.avg, "std": F.stddev_samp,
         "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    a = _stack(df.agg(*[fn(c).alias(f"{c}__{k}") for c in cols for k, fn in m.items()]), cols, list(m))
    a = a.join(column_quantiles(df, cols, {"median": 0.5}), "column", "left")
    return a.select("column", *[rnd(k, places).alias(k) for k in ["mean", "median", "std", "min", "max"]])


def driver_table(df: DataFrame, group: str, y: str, level: str, places: int = 6) -> DataFrame:
    """Per group n, mean and median of ``y``, mean ``level`` and the
    group's share of rows (percent). Medians are exact and distributed."""
    from .stats import exact_quantiles
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"),
                              F.avg(level).alias("mean_level"))
    med = exact_quantiles(df.filter(F.col(group).isNotNull()).withColumn("__y", F.col(y).cast("double")),
                          "__y", {"median_y": 0.5}, by=[group])
    tot = df.agg(F.count(F.lit(1)).alias("__n"))
    return (with_scalars(g.join(med, group, "left"), tot)
            .select(group, "n", rnd("mean_y", places).alias("mean_y"), rnd("median_y", places).alias("median_y"),
                    rnd("mean_level", places).alias("mean_level"),
                    rnd(F.col("n") * 100.0 / F.col("__n"), places).alias("share_pct")))


def listed_only(col: str, values):
    """The column, or an error at run time where it has a value (or null) that
    the list does not name."""
    said = F.concat(F.lit(f"{col} has a value that the column list lacks: "), F.coalesce(F.col(col).cast("string"), F.lit("null")))
    return F.when(F.col(col).isin(list(values)), F.col(col)).otherwise(F.raise_error(said))


def pivot_wide(df: DataFrame, row: str, col: str, value: str, values=None, fill=0.0) -> DataFrame:
    """Row x col matrix of sums; pass ``values`` (the column list)
    to avoid the extra distinct job: a row of another column value then fails
    the job, since the matrix would lose it. Missing cells are ``fill``."""
    if values is not None:
        df = df.withColumn(col, listed_only(col, values))
    p = df.groupBy(row).pivot(col, values).agg(F.sum(value))
    return p.fillna(fill) if fill is not None else p


def pivot_long(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """A13 (default form): (row, col, value) triplets - scales with any
    number of columns."""
    return df.groupBy(row, col).agg(F.sum(value).alias(value))


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts in long form."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max; the max falls in the last
    bin (not bin n+1). Returns (bin, lo, hi, n) for every bin, empty ones with
    n = 0; no rows when there is no value."""
    v = df.select(F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    mm = v.agg(F.min("__v").alias("__mn"), F.max("__v").alias("__mx"))
    x = with_scalars(v, mm)
    width = (F.col("__mx") - F.col("__mn")) / bins
    idx = F.least(F.lit(bins - 1),
                  F.floor((F.col("__v") - F.col("__mn")) * F.try_divide(F.lit(float(bins)),
                                                                        F.col("__mx") - F.col("__mn"))))
    x = x.withColumn("bin", F.coalesce(idx, F.lit(0)).cast("int"))
    counts = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = mm.filter(F.col("__mn").isNotNull()).select(
        "__mn", "__mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (every.join(counts, "bin", "left")
                 .select("bin", (F.col("__mn") + F.col("bin") * width).alias("lo"),
                         (F.col("__mn") + (F.col("bin") + 1) * width).alias("hi"),
                         F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def trend(df: DataFrame, y: str, x: str, by=None) -> DataFrame:
    """OLS slope and intercept of ``y`` on ``x`` (per key)."""
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                               F.regr_count(y, x).alias("n_points"))


def entity_profile(df: DataFrame, entity: str, period: str, count: str, severity: str,
                   min_points: int = 3) -> DataFrame:
    """Per entity mean count, mean severity and the count's slope over
    the period (0 with fewer than ``min_points`` points)."""
    return df.groupBy(entity).agg(
        F.avg(count).alias("mean_count"), F.avg(severity).alias("mean_severity"),
        F.when(F.count(count) < min_points, F.lit(0.0))
         .otherwise(F.coalesce(F.regr_slope(count, period), F.lit(0.0))).alias("count_slope"))
