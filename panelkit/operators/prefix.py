"""Ordered prefix sums and row numbers without a single-partition window.

Rows are range-partitioned in the order (see ``operators.order``), so that
borders follow the data; each range is summed by its own window, and what stands
before it is a prefix over as many rows as there are ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import placed, running


def prefix_sums(df: DataFrame, part, order: str, tiebreak, cols, buckets: int | None = None,
                log_scale: bool = False, suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``cols`` ordered by (order, *tiebreak)
    within ``part``; adds ``{col}{suffix}`` columns. ``buckets``: number of
    ranges (default: the shuffle setting). ``log_scale`` has no effect: ranges
    follow the data on any scale."""
    part = [part] if isinstance(part, str) else list(part)
    tiebreak = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    keys = [order, *tiebreak]
    r = running(placed(df, [*part, *keys], buckets), part, keys, cols, peers=False)
    return (r.withColumns({f"{c}{suffix}": F.col(f"{c}_before") + F.col(c) for c in cols})
             .drop(*[f"{c}_before" for c in cols], *[f"{c}_total" for c in cols]))


def row_numbers(df: DataFrame, order, out: str = "rn", parts: int | None = None) -> DataFrame:
    """1..n in a total ``order`` without an unpartitioned window: range-
    partition on the order (partition ids follow it), write the rows with
    their partition id once (so every branch sees the same assignment),
    count rows per partition, offset = running count of the earlier
    partitions (at most ``parts`` rows), then a row number inside each
    partition."""
    x = placed(df, order, parts)
    cnt = x.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    off = cnt.select("__pid", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    w = Window.partitionBy("__pid").orderBy(*order)
    return (x.join(F.broadcast(off), "__pid")
             .withColumn(out, F.col("__off") + F.row_number().over(w)).drop("__pid", "__off"))
