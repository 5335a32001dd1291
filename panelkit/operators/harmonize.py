"""Name harmonisation (J2) and small-dimension lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key, strip_ws


def dedup_mapping(mapping: DataFrame, key: str = "map_key", order_col: str | None = None) -> DataFrame:
    """One row per normalised key, the first by ``order_col`` (file position
    when the caller has one, else the canonical name) - never an arbitrary
    ``dropDuplicates``."""
    o = F.col(order_col) if order_col else F.col("canonical_name")
    w = Window.partitionBy(key).orderBy(o.asc_nulls_last())
    return (mapping.withColumn("__rn", F.row_number().over(w))
                   .filter("__rn = 1").drop("__rn"))


def apply_mapping(df: DataFrame, mapping: DataFrame, name_col: str,
                  out_col: str = "name_std", flag_col: str = "mapping_applied",
                  order_col: str | None = None) -> DataFrame:
    """Left join on the normalised name; output the canonical name (or the
    stripped original when unmapped) and a 0/1 flag.

    The mapping is deduplicated first; the planner broadcasts it only where
    its measured bytes allow."""
    m = dedup_mapping(mapping.select("map_key", "canonical_name", *([order_col] if order_col else [])),
                      order_col=order_col).select("map_key", "canonical_name")
    out = (df.withColumn(name_col, strip_ws(name_col))
             .withColumn("__key", norm_key(name_col))
             .join(m, F.col("__key") == F.col("map_key"), "left"))
    return (out.withColumn(out_col, F.coalesce(F.col("canonical_name"), F.col(name_col)))
               .withColumn(flag_col, F.col("canonical_name").isNotNull().cast("long"))
               .drop("__key", "map_key", "canonical_name"))


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, out_col: str | None = None,
           default: str | None = "Unknown") -> DataFrame:
    """Key -> value from a small aggregate (entity -> modal group, group
    -> tier); a missing key gets ``default``."""
    d = dim.select(F.col(key).alias("__lk"), F.col(value).alias("__lv"))
    out = df.join(d, F.col(key) == F.col("__lk"), "left").drop("__lk")
    v = F.coalesce(F.col("__lv"), F.lit(default)) if default is not None else F.col("__lv")
    return out.withColumn(out_col or value, v).drop("__lv") if (out_col or value) != "__lv" else out


def modal_value(df: DataFrame, key: str, value: str, out_col: str | None = None) -> DataFrame:
    """Most frequent non-null ``value`` per ``key`` (smallest on ties)."""
    return (df.filter(F.col(key).isNotNull())
              .groupBy(key).agg(F.mode(value, True).alias(out_col or value)))
