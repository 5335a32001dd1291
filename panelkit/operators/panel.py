"""Panel build: event -> (entity, period) aggregate, re-aggregation, the left
join chain, and the balanced grid.

Scale notes
-----------
* ``event_panel`` is one hash aggregate with map-side partials: a hot
  entity (a third of all events) is combined inside every map task before
  the shuffle, so the final task for it merges one partial per map task.
  ``mode`` keeps a value -> count map per group; for a high-cardinality
  category use ``mode_two_level`` (count per (key, value) first).
* Every source is pre-aggregated to one row per key before the left joins,
  so the join never fans out.
* The balanced grid is entities x periods by definition of the operator; it
  is generated per entity with ``explode(sequence(lo, hi))`` where lo/hi are
  scalar subqueries, so there is no cross join and the grid is partitioned
  by entity like the windows that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sum0(c: str) -> F.Column:
    # pandas: the sum over an all-missing group is 0
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def event_panel(df: DataFrame, entity, period: str, count_col: str = "n_events",
                sums: dict | None = None, modes: dict | None = None,
                maxes: dict | None = None, means: dict | None = None,
                distincts: dict | None = None, constants: dict | None = None) -> DataFrame:
    """One row per (entity, period): event count, sums, means, maxima,
    distinct counts and deterministic modes (smallest value on ties, nulls
    ignored, NULL for an empty group). ``constants`` are columns that the entity
    alone decides (its region): they need no value buffer, being grouped by.
    Rows with a NULL key are dropped."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    keys = keys + [period]
    aggs = [F.count(F.lit(1)).alias(count_col)] if count_col else []
    aggs += [_sum0(c).alias(o) for o, c in (sums or {}).items()]
    aggs += [F.avg(c).alias(o) for o, c in (means or {}).items()]
    aggs += [F.max(c).alias(o) for o, c in (maxes or {}).items()]
    aggs += [F.count_distinct(c).alias(o) for o, c in (distincts or {}).items()]
    aggs += [F.mode(c, True).alias(o) for o, c in (modes or {}).items()]
    fixed = [F.col(c).alias(o) for o, c in (constants or {}).items()]
    return df.dropna(subset=keys).groupBy(*keys, *fixed).agg(*aggs)


def mode_two_level(df: DataFrame, keys, value: str, out_col: str) -> DataFrame:
    """Mode for a high-cardinality value: count per (keys, value) with
    partial aggregation, then per key the value with the largest count,
    smallest value on ties (``min_by`` over a (-count, value) struct)."""
    keys = list(keys)
    c = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
           .agg(F.count(F.lit(1)).alias("__n")))
    return c.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias(out_col))


def first_non_null(df: DataFrame, keys, value: str, order_col: str, out_col: str | None = None) -> DataFrame:
    """A4: first non-null value per key in ``order_col`` order (pandas
    ``agg('first')`` with row order made explicit)."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys)
              .agg(F.min_by(F.col(value), F.col(order_col)).alias(out_col or value)))


def left_join_chain(base: DataFrame, keys, sides) -> DataFrame:
    """``base`` left-joined to each side on ``keys``. Each side must be
    unique on ``keys`` (pre-aggregated); this is what keeps the join from
    fanning out."""
    out = base
    for s in sides:
        out = out.join(s, list(keys), "left")
    return out


def period_bounds(df: DataFrame, period: str):
    """Global min / max period as scalar-subquery columns (lazy)."""
    return (df.agg(F.min(period)).scalar(), df.agg(F.max(period)).scalar())


def grid(entities: DataFrame, entity: str, period: str, lo, hi) -> DataFrame:
    """J4 grid: every entity x every period in [lo, hi]."""
    return entities.select("*", F.explode(F.sequence(lo, hi)).alias(period))


def ffill_bfill(c: str, entity, period: str, default=0.0) -> F.Column:
    """Forward fill, then backward fill within the entity, then a constant."""
    part = [entity] if isinstance(entity, str) else list(entity)
    w_back = Window.partitionBy(*part).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    w_fwd = Window.partitionBy(*part).orderBy(period).rowsBetween(0, Window.unboundedFollowing)
    out = F.coalesce(F.last(c, True).over(w_back), F.first(c, True).over(w_fwd))
    return F.coalesce(out, F.lit(default)) if default is not None else out


def balance_panel(df: DataFrame, entity: str, period: str, zero_cols=(), carry_cols=(),
                  attr: dict | None = None, mode: str = "carry", lo=None, hi=None) -> DataFrame:
    """M1/M2: balanced panel.

    * every entity of ``df`` x every period between the global min and max
      (or ``lo``/``hi``);
    * ``zero_cols`` are 0 where the cell is missing;
    * ``carry_cols``: mode ``carry`` forward-fills then back-fills within the
      entity, then 0 (parity with the reference); mode ``zero`` puts 0 in new
      cells (no carried severity in zero-count periods);
    * ``attr``: ``{out_col: source_col}`` entity attributes set to the
      entity's modal value ('Unknown' when none)."""
    if lo is None or hi is None:
        lo2, hi2 = period_bounds(df, period)
        lo = lo2 if lo is None else lo
        hi = hi2 if hi is None else hi
    attr = attr or {}
    ent = df.groupBy(entity).agg(*[F.mode(src, True).alias(o) for o, src in attr.items()]) \
        if attr else df.select(entity).distinct()
    g = grid(ent, entity, period, lo, hi)
    keep = [entity, period] + [c for c in list(zero_cols) + list(carry_cols)]
    out = g.join(df.select(*keep).withColumn("__obs", F.lit(1)), [entity, period], "left")
    cols = {c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in zero_cols}
    if mode == "carry":
        cols.update({c: ffill_bfill(c, entity, period).cast("double") for c in carry_cols})
    elif mode == "zero":
        cols.update({c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in carry_cols})
    else:
        raise ValueError("mode must be 'carry' or 'zero'")
    cols.update({o: F.coalesce(F.col(o), F.lit("Unknown")) for o in attr})
    cols["observed"] = F.coalesce(F.col("__obs"), F.lit(0)).cast("long")
    return out.withColumns(cols).drop("__obs")


def fill_gaps_zero(df: DataFrame, series: str, period: str, value: str) -> DataFrame:
    """Per series, every period between the series' own first and last
    period; missing values are 0."""
    b = df.groupBy(series).agg(F.min(period).alias("__lo"), F.max(period).alias("__hi"))
    g = b.select(series, F.explode(F.sequence("__lo", "__hi")).alias(period))
    return (g.join(df.select(series, period, value), [series, period], "left")
             .withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast("double")))
