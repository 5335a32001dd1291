"""Sinks: Parquet (default), CSV, JSON and an append-only JSON-lines ledger.

Writes are the only actions in a published job; Spark's file commit
protocol makes them survive lost executors (failed tasks are retried and
only committed task output is kept)."""

from __future__ import annotations

import datetime as _dt
import getpass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite",
                fmt: str = "parquet") -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


LEDGER_SCHEMA = T.StructType([
    T.StructField("ts_utc", T.StringType()),
    T.StructField("run_date", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("inputs", T.ArrayType(T.StringType())),
    T.StructField("input_hash", T.StringType()),
    T.StructField("output_hashes", T.MapType(T.StringType(), T.StringType())),
])


def append_ledger(spark: SparkSession, path: str, action: str, inputs, input_hash: str,
                  output_hashes: dict, actor: str | None = None) -> DataFrame:
    """Append one event row to the run ledger, partitioned by run date."""
    now = _dt.datetime.now(_dt.timezone.utc)
    row = (now.isoformat(timespec="seconds"), now.date().isoformat(),
           actor or getpass.getuser(), action, list(inputs), input_hash, dict(output_hashes))
    df = spark.createDataFrame([row], LEDGER_SCHEMA)
    df.write.mode("append").partitionBy("run_date").json(path)
    return df


def hash_of_hashes(df: DataFrame, hash_col: str = "sha256", order_col: str = "path") -> DataFrame:
    """K4: one-row frame: the digest of per-file hashes in the order of their
    paths, as a tree of digests (``publish.merkle_digest``)."""
    from .publish import merkle_digest
    return merkle_digest(df, order_col, hash_col).select(F.col("digest").alias("input_hash"))
