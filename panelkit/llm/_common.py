"""Helpers shared by the training-data operators.

Operators take a DataFrame plus the names of its id and text columns, select
only those under private names (so extra or clashing columns never matter) and
return a DataFrame.  Intermediates that several branches read are written once
to the shared checkpoint folder (``materialise``)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelkit.session import cut_lineage

#: Bytes of text handled by one vectorised step inside a task.
CHUNK_BYTES = 4 << 20
#: Spark's setting to remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (where
    it is not installed or shipped with the job)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back. Nothing
    reads the shuffle files of its plan again, so they go as soon as it is
    written; otherwise they stay until the driver happens to collect garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as ``id`` and the whole text as ``text``; a null text is empty."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character keeps its place and value."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batches: Iterator[pa.RecordBatch], text_field: str = "text",
           max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that each holds at most ``max_bytes`` of text (a
    longer single row stays whole), which bounds the memory of a vectorised
    step whatever the batch size is."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(batch.schema.get_field_index(text_field))
        sizes = np.asarray(pc.binary_length(text).fill_null(0))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, base + max_bytes, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls as one uint8 array,
    and the n + 1 offsets of its rows in it."""
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset: array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def map_texts(base: DataFrame, added: str, make: Callable[[], Callable], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Run vectorised Python over the rows of ``base`` (which has ``text``).

    ``make()`` is called once in each task and gives a function from a record
    batch to ``(rows, columns)``: the columns of the DDL string ``added``, and
    for each of their entries the row of the batch it belongs to (None: one
    entry per row, in order). The columns ``keep`` come along unchanged."""
    fields = T.StructType([base.schema[c] for c in keep] + (list(T.StructType.fromDDL(added)) if added else []))
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in pieces(batches):
            rows, columns = work(batch)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if rows is not None:
                index = pa.array(np.asarray(rows, np.int64))
                kept = [k.take(index) for k in kept]
            arrays = [k.cast(schema.field(i).type) for i, k in enumerate(kept)]
            arrays += [c if isinstance(c, pa.Array) else pa.array(c, schema.field(len(keep) + i).type)
                       for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    on_workers(base.sparkSession)
    return base.mapInArrow(run, fields)


def texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()
