"""Join helpers.

A side is hinted for broadcast only when its size is bounded by construction
(a literal table such as a rule or pattern list, a one-row aggregate).  Every
other join is left to the planner, which decides by bytes: from the scan's
statistics, or with AQE from what it measured of the shuffled side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a side whose size is fixed by construction (literal tables,
    one-row aggregates, tables bounded by the number of partitions)."""
    return F.broadcast(df)


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, lazily (no
    driver round trip; the one-row side is broadcast)."""
    return df.crossJoin(F.broadcast(scalars))
