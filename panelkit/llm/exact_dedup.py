"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes (a bounded prefix, a
64-bit hash of the whole and the id, so that splitters stay small and a group
holding a third of all rows is spread over many partitions), an external sort
puts equal texts next to each other, and each row is compared in full with its
neighbour.  Groups that touch a partition border are completed by joining
their partial totals, one small row per partition, on the SHA-256 of the text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import id_and_text, materialise, on_workers

#: Characters of the text used as range-partitioning key beside its hash.
PREFIX_CHARS = 24
#: Finished runs gathered before they are written out.
CLOSED_RUNS = 4096


def _scan(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compare sorted neighbours. Besides one batch only ids are held: those of
    the current key and of at most ``CLOSED_RUNS`` finished runs."""
    id_type = schema.field("id").type

    def rows(runs: list[tuple[int, str, list]], part: int, border: bool) -> Iterator[pa.RecordBatch]:
        if not runs:
            return
        sizes = np.array([len(ids) for _, _, ids in runs])
        spread = pa.array(np.repeat(np.arange(len(runs)), sizes))
        n = int(sizes.sum())
        head = np.zeros(n, bool)
        head[np.cumsum(sizes) - sizes] = True
        yield pa.RecordBatch.from_arrays([
            pa.array([i for _, _, ids in runs for i in ids], id_type),
            pa.array([no for no, _, _ in runs], pa.int64()).take(spread),
            pa.array(np.full(n, part), pa.int32()),
            pa.array(np.full(n, border)),
            pa.array(head),
            pa.array([ids[0] for _, _, ids in runs], id_type).take(spread),
            pa.array(sizes, pa.int64()).take(spread),
            pa.array([digest for _, digest, _ in runs]).take(spread),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first_key = last_key = last_text = None
        current: list[tuple[int, str, list]] = []  # runs of the current key: (number, digest, ids)
        closed: list[tuple[int, str, list]] = []
        number = 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids, (key, hashed, text) = b.column(0).to_pylist(), b.columns[1:4]
            key_of = lambda i: (key[i].as_py(), hashed[i].as_py())
            new_key, new_text = np.ones(n, bool), np.ones(n, bool)
            if n > 1:
                differs = lambda a: np.asarray(pc.not_equal(a.slice(1), a.slice(0, n - 1)))
                new_key[1:] = differs(key) | differs(hashed)
                new_text[1:] = new_key[1:] | differs(text)
            new_key[0] = key_of(0) != last_key
            new_text[0] = new_key[0] or text[0].as_py() != last_text
            first_key = first_key or key_of(0)
            starts = [int(i) for i in np.flatnonzero(new_text)]
            if not new_text[0]:
                current[-1][2].extend(ids[: starts[0] if starts else n])
            for start, stop in zip(starts, [*starts[1:], n]):
                if new_key[start] and current:
                    if last_key == first_key:
                        yield from rows(current, part, True)
                    else:
                        closed += current
                    current = []
                    if len(closed) >= CLOSED_RUNS:
                        yield from rows(closed, part, False)
                        closed = []
                digest = hashlib.sha256(text[start].as_py().encode()).hexdigest()
                current.append((number, digest, ids[start:stop]))
                number += 1
                last_key = key_of(start)
            last_text = text[n - 1].as_py()
        yield from rows(closed, part, False)
        yield from rows(current, part, True)

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] | None = None, keep: str = "min") -> DataFrame:
    """One row per input row: the id, ``keep_id`` (the smallest id of the equal
    texts, or the largest with ``keep="max"``), ``group_size``, ``kept`` and
    ``text_sha256`` (lower-case hex of the normalised text in UTF-8).

    A null text is empty, and empty texts are one group. A null id is never
    the one that stays unless its whole group has null ids. Of repeated rows
    (same id and text) exactly one is kept. Ties cannot occur otherwise. An
    empty table gives an empty result; other columns are ignored."""
    desc = {"min": False, "max": True}[keep]
    id_type = df.schema[id_col].dataType
    on_workers(df.sparkSession)
    base = id_and_text(df, id_col, text_col)
    if normalise:
        base = base.withColumn("text", F.coalesce(normalise(F.col("text")), F.lit("")))
    order = F.col("id").desc_nulls_last() if desc else F.col("id").asc_nulls_last()
    keyed = base.select("id", F.substring("text", 1, PREFIX_CHARS).alias("k"), F.xxhash64("text").alias("h"), "text")
    sorted_ = keyed.repartitionByRange("k", "h", "id").sortWithinPartitions("k", "h", "text", order)

    fields = [("id", id_type), ("run", T.LongType()), ("part", T.IntegerType()), ("border", T.BooleanType()),
              ("head", T.BooleanType()), ("keep_id", id_type), ("group_size", T.LongType()), ("sha", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    # the scan's result depends on where partitions end: it is written before it is read twice
    runs = materialise(sorted_.mapInArrow(_scan(to_arrow_schema(schema)), schema))

    best = F.max if desc else F.min
    # at most a few rows per partition: the partial totals of groups at a border
    partial = runs.where("border AND head")
    total = partial.groupBy("sha").agg(best("keep_id").alias("best_id"), F.sum("group_size").alias("total"))
    whole = partial.select("part", "run", "sha").join(total, "sha").drop("sha")
    border = (runs.where("border").join(whole, ["part", "run"])
              .select("id", F.col("best_id").alias("keep_id"), F.col("total").alias("group_size"), "head", "sha"))
    inner = runs.where("NOT border").select("id", "keep_id", "group_size", "head", "sha")
    return inner.unionByName(border).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("head") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("sha").alias("text_sha256"))
