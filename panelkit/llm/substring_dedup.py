"""Substring dedup by content-defined chunking.

A gear rolling hash over the UTF-8 bytes cuts each text into variable chunks;
the cuts depend on the bytes near them alone, so an insertion shifts only the
chunks around it.  Chunks are matched by digest within and across documents,
and runs of matched chunks that are long enough are repeated passages.  Of each
chunk in them, every occurrence but the first in the document with the smallest
id is to be cut."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import id_and_text, map_texts, materialise, on_workers, text_bytes

#: Bytes of a chunk at least and at most; one byte in ``1 << CUT_BITS`` may end one.
LEAST, MOST, CUT_BITS = 20, 160, 4
#: Bytes that the rolling hash sees; not more than ``LEAST``, so that a cut never
#: depends on another document.
REACH = 16
#: Bytes that a run of repeated chunks spans at least, to be a repeated passage.
RUN = 100
#: Gear table: one 32-bit number per byte value, from a fixed rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 97) for b in range(256)], np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the ``REACH`` bytes that end there."""
    h = GEAR[raw]
    size = 1
    while size < REACH:  # the hash of twice as many bytes from two of half as many
        h[size:] = h[size:] + (h[:-size] << np.uint32(size))
        size *= 2
    return h


def cuts(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of the chunks of all rows of a batch, and the row of each. A cut
    never falls inside a character, and no chunk spans two rows."""
    if not len(raw):
        return [], []
    # a chunk may end after a byte where the top bits of the hash are zero
    after = np.ones(len(raw), bool)
    after[:-1] = (raw[1:] & 0xC0) != 0x80
    may = (np.flatnonzero((gear(raw) >> np.uint32(32 - CUT_BITS) == 0) & after) + 1).tolist()
    ends, rows = [], []
    at = 0
    for row in range(len(offsets) - 1):
        start, stop = int(offsets[row]), int(offsets[row + 1])
        at = bisect_left(may, start, at)
        while start < stop:
            at = bisect_left(may, start + LEAST, at, min(at + MOST + 1, len(may)))
            end = may[at] if at < len(may) else stop
            if end > start + MOST:
                end = start + MOST
                while end < stop and raw[end] & 0xC0 == 0x80:
                    end += 1
            end = min(end, stop)
            ends.append(end)
            rows.append(row)
            start = end
    return ends, rows


def repeats_inside(row: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of chunks whose digest its row holds more than once, in order, and
    which of them are not the row's first."""
    order = np.lexsort((digest, row))  # stable: equal ones stay in order
    same = (row[order][1:] == row[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    later, several = np.zeros(len(row), bool), np.zeros(len(row), bool)
    later[order[1:][same]] = True
    several[order[:-1][same]] = True
    at = np.flatnonzero(later | several)
    return at, later[at]


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``row`` (a number of its own), ``key`` (of
    the text), ``ends`` (byte ends of its chunks, in order), ``digests`` (64-bit)
    and ``inside`` (positions of chunks that it holds more than once, as twice
    the position, plus one where it is not the first)."""
    base = id_and_text(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).withColumn("key", text_key("text"))

    def make():
        def work(batch):
            text = batch.column(batch.schema.get_field_index("text"))
            raw, offsets = text_bytes(text)
            ends, rows = cuts(raw, offsets)
            data = raw.tobytes()
            starts = [0, *ends[:-1]]
            digest = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts, ends)], np.uint64)
            row = np.array(rows, np.int64)
            end = (np.array(ends, np.int64) - offsets[row]).astype(np.int32)
            split = np.searchsorted(row, np.arange(len(text) + 1)).astype(np.int32)
            at, later = repeats_inside(row, digest)
            inside = (2 * (at - split[row[at]]) + later).astype(np.int32)
            parted = np.searchsorted(row[at], np.arange(len(text) + 1)).astype(np.int32)
            lists = lambda by, values, kind: pa.ListArray.from_arrays(pa.array(by, pa.int32()), pa.array(values, kind))
            return None, [lists(split, end, pa.int32()), lists(split, digest.view(np.int64), pa.int64()), lists(parted, inside, pa.int32())]

        return work

    return map_texts(base, "ends array<int>, digests array<bigint>, inside array<int>", make, keep=("id", "row", "key"))


def text_key(text_col: str) -> Column:
    """Tells rows that share an id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def split(pos: np.ndarray, older: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int, bool]]:
    """The repeated passages of one document as (start, end, n_chunks, place of
    the first hit, hits, dropped). Hits are the positions of repeated chunks, in
    order, and whether an earlier occurrence stays. Runs of ``RUN`` bytes are
    parted where that answer changes; a part with an earlier occurrence that is
    shorter than ``RUN`` is kept with its neighbours, so that no kept passage
    has a hole where a short chunk stands elsewhere too."""
    each, at = np.unique(pos, return_index=True)  # a chunk may have several hits
    old = np.logical_or.reduceat(older, at).tolist()
    hit = [*at.tolist(), len(pos)]
    stop = ends[each].tolist()
    start = np.where(each == 0, 0, ends[each - 1]).tolist()
    bounds = [0, *(np.flatnonzero(np.diff(each) != 1) + 1).tolist(), len(each)]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if stop[b - 1] - start[a] < RUN:
            continue
        parts: list[list] = []  # [first, past the last, dropped]
        i = a
        while i < b:
            j = i + 1
            while j < b and old[j] == old[i]:
                j += 1
            dropped = old[i] and stop[j - 1] - start[i] >= RUN
            if parts and not dropped and not parts[-1][2]:
                parts[-1][1] = j
            else:
                parts.append([i, j, dropped])
            i = j
        out += [(start[i], stop[j - 1], j - i, hit[i], hit[j] - hit[i], dropped) for i, j, dropped in parts]
    return out


def repeated_runs(chunked: DataFrame) -> DataFrame:
    """Rows (id, key, start, end, n_chunks, first_id, dropped): the parts of the
    maximal runs of chunks of a document that stand elsewhere too, in it or in
    others, in bytes. ``first_id`` is the smallest id that holds one of the
    part's chunks; ``dropped``: each of its chunks stands in a document of a
    smaller id, or earlier in this one, or in one of this id and a smaller key."""
    each = chunked.select("row", "id", "key", F.posexplode("digests").alias("pos", "digest"))
    hit = lambda older, first_id: F.struct("pos", older.alias("older"), first_id.alias("first_id"))
    # partial aggregation first: a digest that a third of all documents hold is one row per task
    shared = (each.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
              .where("first_id < last_id").select("digest", "first_id"))
    hits = each.join(shared, "digest").select("row", hit(F.col("first_id") < F.col("id"), F.col("first_id")).alias("hit"))
    # ids with several texts: none as a rule, and then no more is read
    twins = materialise(chunked.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("id"))
    if not twins.isEmpty():
        of_twins = each.join(twins, "id")
        firsts = (of_twins.groupBy("id", "digest").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
                  .where("first_key < last_key").select("id", "digest", "first_key"))
        hits = hits.union(of_twins.join(firsts, ["id", "digest"])
                          .select("row", hit(F.col("first_key") < F.col("key"), F.col("id")).alias("hit")))
    marked = hits.groupBy("row").agg(F.collect_list("hit").alias("hits"))  # at most one document's chunks, or twice those
    inner = F.transform("inside", lambda x: F.struct(
        F.shiftright(x, 1).alias("pos"), (x % 2 == 1).alias("older"), F.col("id").alias("first_id")))
    both = chunked.join(marked, "row", "left").where("hits IS NOT NULL OR size(inside) > 0")
    return _parts(both.select("id", "key", "ends", F.array_sort(F.when(F.col("hits").isNull(), inner).otherwise(
        F.concat("hits", inner))).alias("hits")))


def _parts(both: DataFrame) -> DataFrame:
    """The parts of each document from rows (id, key, ends, hits)."""
    out = both.select("id", "key", F.col("hits.first_id").alias("first"), "ends", F.col("hits.pos").alias("pos"), F.col("hits.older").alias("older"))
    fields = T.StructType([*out.schema.fields[:3], *T.StructType.fromDDL(
        "parts array<struct<start:int,end:int,n_chunks:int,at:int,hits:int,dropped:boolean>>")])
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, pos, older = (batch.column(k) for k in (3, 4, 5))
            found = [split(np.asarray(pos[i].values), pos_older(older[i]), np.asarray(ends[i].values)) for i in range(batch.num_rows)]
            kept = [batch.column(k).cast(schema.field(k).type) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, schema.field(3).type)], schema=schema)

    def pos_older(flags: pa.ListScalar) -> np.ndarray:
        return flags.values.to_numpy(zero_copy_only=False).astype(bool)

    on_workers(both.sparkSession)
    part = out.mapInArrow(run, fields).select("id", "key", "first", F.explode("parts").alias("p"))
    return part.select("id", "key", "p.start", "p.end", "p.n_chunks", F.array_min(F.slice("first", F.col("p.at") + 1, F.col("p.hits"))).alias("first_id"), "p.dropped")


def substring_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage of a document: the id, ``start`` and ``end``
    (UTF-8 bytes), ``n_chunks``, ``first_id`` (the smallest id that holds a
    chunk of it) and ``dropped`` (each of its chunks stands in a document of a
    smaller id, or earlier in this one). A passage that is new here in part gives
    a row for each part; what is dropped has at least 100 bytes, what is kept of
    it may be shorter.

    A passage counts from about 100 bytes of whole chunks that stand elsewhere
    too, in the same document or in others. Null and empty texts and null ids
    repeat nothing; rows that repeat whole are one document, and those that share
    an id alone are several, in order of a hash of their texts; an empty table
    gives an empty result; other columns are ignored. Digests have 64 bits, and
    a run needs several to agree."""
    return _repeats(df, id_col, text_col).select(F.col("id").alias(id_col), "start", "end", "n_chunks", "first_id", "dropped")


def _repeats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return repeated_runs(materialise(chunks(df, id_col, text_col).where("id IS NOT NULL")))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with every dropped passage cut out of the text; a null text
    stays null. Rows that repeat whole all stay, cut alike. Other columns stay,
    whatever their names."""
    at, key, cut = _unused(df, "at"), _unused(df, "key"), _unused(df, "cut")
    found = (_repeats(df, id_col, text_col).where("dropped").groupBy(F.col("id").alias(at), F.col("key").alias(key))
             .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cut)))
    raw = F.encode(F.col(f"`{text_col}`"), "UTF-8")
    kept = F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, c: F.struct(
        c["end"].alias("at"), F.concat(acc["out"], F.decode(F.substring(raw, acc["at"] + 1, c["start"] - acc["at"]), "UTF-8")).alias("out")),
        lambda acc: F.concat(acc["out"], F.decode(F.substring(raw, acc["at"] + 1, F.length(raw) - acc["at"]), "UTF-8")))
    joined = df.join(found, (F.col(f"`{id_col}`") == F.col(at)) & (text_key(text_col) == F.col(key)), "left")
    return joined.withColumn(text_col, F.when(F.col(cut).isNull(), F.col(f"`{text_col}`")).otherwise(kept)).drop(at, key, cut)


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of its letters."""
    there = {c.lower() for c in df.columns}
    while f"_{name}" in there:
        name = f"_{name}"
    return f"_{name}"
