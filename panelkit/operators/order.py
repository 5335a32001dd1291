"""Distributed order statistics: running weights of distinct values, for rank
tests, curves and exact quantiles over groups of any size and any skew.

Rows are reduced to (value, weight) counts first, so a value that most rows share
is one row. These are range-partitioned on the value: the borders follow the data,
however it is spread, and their number the shuffle setting. Each range knows its
total; what stands before a range is a running sum over at most as many rows as
there are ranges, and inside a range a window adds up. The ranges are written once
(``cut_lineage``), so that totals and rows see the same borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def placed(df: DataFrame, order, parts: int | None = None) -> DataFrame:
    """The rows in ranges of ``order`` (names or sort columns), written, with the
    number of their range as ``__pid``; equal keys are in one range."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return cut_lineage(ranged.withColumn("__pid", F.spark_partition_id()))


def running(ranges: DataFrame, by, order, cols, peers: bool) -> DataFrame:
    """Add running sums of ``cols`` within ``by`` over the rows of ``placed``, as
    ``{c}_before``: over the rows before in ``order`` (with ``peers``: with a
    smaller key; what rows of an equal key hold together is ``{c}_ties``), and
    the sum over the whole key as ``{c}_total``. Null keys are keys."""
    x = ranges.withColumn("__k", F.struct(*[F.col(f"`{c}`") for c in by])) if by else ranges
    key = ["__k"] if by else []
    here = [*key, "__pid"]
    totals = x.groupBy(*here).agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    # at most one row for each range in a key of these windows
    whole = Window.partitionBy(*key)
    earlier = whole.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*here, *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__off_{c}") for c in cols],
                            *[F.sum(f"__t_{c}").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{c}_total") for c in cols])
    x = x.join(offsets, here)
    inside = Window.partitionBy(*here).orderBy(*order)
    if peers:
        same = Window.partitionBy(*here, *order)
        upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        x = x.withColumns({f"{c}_ties": F.sum(c).over(same) for c in cols} | {f"__in_{c}": F.sum(c).over(upto) for c in cols})
        before = {c: F.col(f"__in_{c}") - F.col(f"{c}_ties") for c in cols}
    else:
        x = x.withColumns({f"__in_{c}": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in cols})
        before = {c: F.col(f"__in_{c}") - F.col(c) for c in cols}
    x = x.withColumns({f"{c}_before": F.col(f"__off_{c}") + before[c] for c in cols})
    return x.drop("__k", "__pid", *[f"__off_{c}" for c in cols], *[f"__in_{c}" for c in cols])


def order_table(df: DataFrame, value: str, by=(), also=(), weights: dict | None = None, parts: int | None = None) -> DataFrame:
    """One row per distinct (``by``, non-null ``value``, ``also``) with the sums of
    ``weights`` (default: ``n``, the number of rows) and for each of them
    ``_before`` (smaller values of the key), ``_ties`` (equal values) and
    ``_total`` (the whole key). An empty table gives an empty result."""
    weights = weights or {"n": F.lit(1).cast("long")}
    counts = (df.where(F.col(f"`{value}`").isNotNull()).groupBy(*by, value, *also)
              .agg(*[F.sum(w).alias(k) for k, w in weights.items()]))
    return running(placed(counts, [*by, value], parts), by, [value], list(weights), peers=True)


def quantiles_of(table: DataFrame, value: str, wanted: dict, by=()) -> DataFrame:
    """Quantiles with linear interpolation from an order table whose rows are
    distinct values, ``wanted = {column: (p, weight)}``; one row per key, null
    where the weight is 0 throughout."""
    aggs, outs, met = [], [], F.lit(False)
    for out, (p, n) in wanted.items():
        place = (F.col(f"{n}_total") - 1) * F.lit(float(p))
        here = lambda at, n=n: (F.col(f"{n}_before") <= at) & (at < F.col(f"{n}_before") + F.col(n))
        lower, upper = here(F.floor(place)), here(F.ceil(place))
        met = met | lower | upper
        aggs += [F.max(F.when(lower, F.col(value))).alias(f"__l_{out}"), F.max(F.when(upper, F.col(value))).alias(f"__u_{out}"),
                 F.max(place - F.floor(place)).alias(f"__f_{out}")]
        outs.append((F.col(f"__l_{out}") + (F.col(f"__u_{out}") - F.col(f"__l_{out}")) * F.col(f"__f_{out}")).alias(out))
    return table.where(met).groupBy(*by).agg(*aggs).select(*by, *outs)


def quantile_of(table: DataFrame, value: str, probs: dict, by=()) -> DataFrame:
    """``quantiles_of`` with the weight ``n``; ``probs = {column: p}``."""
    return quantiles_of(table, value, {out: (p, "n") for out, p in probs.items()}, by)
