"""Window operators over (entity, period).

All windows are partitioned by the entity, so a panel row count per entity
is bounded by the number of periods (the panel's primary key guarantees
it) and the sort happens per entity, in parallel. Several outputs that
share a spec are computed in one ``withColumns`` so Spark plans one Window
node (one sort)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(entity, period: str):
    part = [] if entity is None else ([entity] if isinstance(entity, str) else list(entity))
    return Window.partitionBy(*part).orderBy(period)


def lag_fill(c: str, k: int, entity, period: str, default=0.0) -> Column:
    """Lag ``k`` with ``default`` both off the edge and for a NULL
    inside the series."""
    v = F.lag(c, k).over(_w(entity, period))
    return F.coalesce(v, F.lit(default)) if default is not None else v


def lead(c: str, h: int, entity, period: str) -> Column:
    """Value ``h`` rows ahead (NULL off the end)."""
    return F.lead(c, h).over(_w(entity, period))


def past_mean(c: str, entity, period: str, n: int = 3, min_obs: int = 1, default=0.0) -> Column:
    """Mean of the previous ``n`` rows (current row excluded), NULL
    (or ``default``) when fewer than ``min_obs`` are present."""
    w = _w(entity, period).rowsBetween(-n, -1)
    m = F.when(F.count(c).over(w) >= min_obs, F.avg(c).over(w))
    return F.coalesce(m, F.lit(default)) if default is not None else m


def trailing_mean(c: str, entity, period: str, n: int = 3, min_obs: int | None = None) -> Column:
    """Mean of the last ``n`` rows including the current one; NULL
    while fewer than ``min_obs`` values are in the frame (rows, not periods:
    gaps in the period are stepped over, as pandas ``rolling(n)`` does)."""
    w = _w(entity, period).rowsBetween(-(n - 1), 0)
    need = n if min_obs is None else min_obs
    return F.when(F.count(c).over(w) >= need, F.avg(c).over(w))


def growth(c: str, entity, period: str) -> Column:
    """Change against the previous existing row, (x - prev) / prev;
    NULL when prev is 0 or missing."""
    p = F.lag(c, 1).over(_w(entity, period))
    return F.try_divide(F.col(c) - p, p)


def interpolate(c: str, entity, period: str, by: str = "position") -> Column:
    """Linear interpolation within the entity, both directions (edges
    take the nearest known value).

    ``by='position'`` steps by row position like pandas ``interpolate()``
    (the period values are ignored); ``by='period'`` uses the period value
    as the x axis."""
    w = _w(entity, period)
    x = F.row_number().over(w).cast("double") if by == "position" else F.col(period).cast("double")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    known_x = F.when(F.col(c).isNotNull(), x)
    v0 = F.last(c, True).over(back)
    x0 = F.last(known_x, True).over(back)
    v1 = F.first(c, True).over(fwd)
    x1 = F.first(known_x, True).over(fwd)
    lin = v0 + (v1 - v0) * F.try_divide(x - x0, x1 - x0)
    return F.coalesce(F.col(c), F.when(v0.isNotNull() & v1.isNotNull(), lin), v0, v1)


def with_position(df: DataFrame, entity, period: str, out: str = "__pos") -> DataFrame:
    return df.withColumn(out, F.row_number().over(_w(entity, period)))


def interpolate_df(df: DataFrame, cols, entity, period: str, by: str = "position") -> DataFrame:
    """W10 on several columns. Positions are materialised first so the
    window functions read a plain column."""
    if by == "position":
        d = with_position(df, entity, period)
        out = d.withColumns({c: _interp_on(c, entity, period, "__pos") for c in cols})
        return out.drop("__pos")
    return df.withColumns({c: interpolate(c, entity, period, by="period") for c in cols})


def _interp_on(c: str, entity, period: str, xcol: str) -> Column:
    w = _w(entity, period)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    x = F.col(xcol).cast("double")
    known_x = F.when(F.col(c).isNotNull(), x)
    v0, x0 = F.last(c, True).over(back), F.last(known_x, True).over(back)
    v1, x1 = F.first(c, True).over(fwd), F.first(known_x, True).over(fwd)
    lin = v0 + (v1 - v0) * F.try_divide(x - x0, x1 - x0)
    return F.coalesce(F.col(c), F.when(v0.isNotNull() & v1.isNotNull(), lin), v0, v1)


def latest_non_null(df: DataFrame, entity, period: str, cols, since=None) -> DataFrame:
    """Per entity, the last non-null value of *each column*
    separately (pandas ``groupby().last()``), plus the last period.
    ``since`` keeps only periods >= since first."""
    d = df if since is None else df.filter(F.col(period) >= since)
    part = [entity] if isinstance(entity, str) else list(entity)
    aggs = [F.max(period).alias(period)]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(period))).alias(c) for c in cols]
    return d.groupBy(*part).agg(*aggs)


def dedup_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first in a total order (``order`` must end
    with a unique column so the pick is deterministic)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def dense_position(df: DataFrame, order, out: str = "rank") -> DataFrame:
    """1..n after a sort, over range partitions (no window over all rows)."""
    from .prefix import row_numbers
    return row_numbers(df, order, out).withColumn(out, F.col(out).cast("int"))
