"""Cleaning: renames, projections, null-key drops, sentinels, fills, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import flag, inf_to_null
from ..functions.text import coerce_double, coerce_long, is_entity_code, sentinel_to_null, strip_ws


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename by map (missing names are ignored, as in pandas)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def conform(df: DataFrame, columns) -> DataFrame:
    """Exact column list and order."""
    return df.select(*columns)


def drop_null_keys(df: DataFrame, keys) -> DataFrame:
    """Rows with a NULL in any key column are dropped before grouping
    (pandas drops null group keys; Spark would keep a NULL group)."""
    return df.dropna(how="any", subset=list(keys))


def complete_cases(df: DataFrame, columns) -> DataFrame:
    """Keep rows where every used column is present."""
    return df.dropna(how="any", subset=list(columns))


def drop_empty(df: DataFrame, column: str) -> DataFrame:
    """P5: drop empty strings (after stripping)."""
    return df.filter(strip_ws(column) != "")


def entity_rows(df: DataFrame, code_col: str | None = None, name_col: str | None = None,
                exclude_names=None) -> DataFrame:
    """Keep rows of real entities, dropping aggregates.

    With a code column: the code must be three upper-case letters and not an
    aggregate code.  Without one: names in ``exclude_names`` are dropped
    (a list literal; pass a DataFrame to use a left-anti join instead)."""
    if code_col is not None:
        return df.filter(is_entity_code(code_col))
    if exclude_names is None:
        return df
    if isinstance(exclude_names, DataFrame):
        ex = exclude_names.select(strip_ws(exclude_names.columns[0]).alias("__ex"))
        return df.join(ex, strip_ws(name_col) == F.col("__ex"), "left_anti")
    return df.filter(~F.coalesce(strip_ws(name_col).isin(*list(exclude_names)), F.lit(False)))


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    """NULL -> constant per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def sentinel_to_na(df: DataFrame, columns, fill: str | None = "N/A",
                   sentinels=("unknown", "")) -> DataFrame:
    """P10: 'unknown' (any case) or empty -> NULL -> ``fill`` (if given)."""
    out = {}
    for c in columns:
        v = sentinel_to_null(c, sentinels)
        out[c] = F.coalesce(v, F.lit(fill)) if fill is not None else v
    return df.withColumns(out)


def presence_flags(df: DataFrame, mapping: dict) -> DataFrame:
    """``{flag_name: source_col}`` -> 0/1 presence flags."""
    return df.withColumns({f: F.col(c).isNotNull().cast("long") for f, c in mapping.items()})


def threshold_flag(c, op: str, threshold) -> F.Column:
    """0/1 flag of ``c op threshold``; NULL comparisons count as 0."""
    x = F.col(c) if isinstance(c, str) else c
    t = threshold if isinstance(threshold, F.Column) else F.lit(threshold)
    cond = {">": x > t, ">=": x >= t, "<": x < t, "<=": x <= t, "==": x == t}[op]
    return flag(cond)


def nonfinite_to_null(df: DataFrame, columns) -> DataFrame:
    """Inf / NaN -> NULL."""
    return df.withColumns({c: inf_to_null(c) for c in columns})


def filter_with_report(df: DataFrame, keep, entity: str):
    """Apply a filter and describe what it removed, in one aggregate.

    Returns (kept rows, one-row report with rows_before, rows_removed,
    entities_touched). Both are lazy."""
    keep = F.coalesce(keep, F.lit(False))
    report = df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~keep).alias("rows_removed"),
        F.count_distinct(F.when(~keep, F.col(entity))).alias("entities_touched"),
    )
    return df.filter(keep), report


def clean_events(df: DataFrame, text_cols, numeric_cols, key_text: str, key_num: str,
                 category_cols, fill_numeric: float = 0.0, na_text: str = "N/A") -> DataFrame:
    """The event cleaner: strip text, coerce numbers, drop rows without
    entity or period, integer period, NULL measures -> 0, sentinel
    categories -> 'N/A'."""
    out = {c: strip_ws(c) for c in text_cols}
    out.update({c: coerce_double(c) for c in numeric_cols})
    out[key_num] = coerce_double(key_num)
    df = df.withColumns(out)
    df = drop_null_keys(df, [key_text, key_num])
    df = df.withColumn(key_num, F.col(key_num).try_cast("bigint"))
    df = fill_constant(df, {c: fill_numeric for c in numeric_cols})
    return sentinel_to_na(df, category_cols, fill=na_text)


__all__ = ["rename", "conform", "drop_null_keys", "complete_cases", "drop_empty",
           "entity_rows", "fill_constant", "sentinel_to_na", "presence_flags",
           "threshold_flag", "nonfinite_to_null", "filter_with_report", "clean_events",
           "coerce_long"]
