"""Hard negatives by exact search in a multiway hyperplane tree (GNAT style).

Vectors hold integers; the score of two is their inner product.  One more
coordinate, ``sqrt(R^2 - |x|^2)`` with R the greatest norm (0 for a query), puts
all rows on a sphere, where a score s is the distance
``sqrt(|a|^2 + R^2 - 2 s)``: a window of scores is an annulus around the query.

A node of the tree has some split points; a row belongs to the child of the
nearest.  For each split point i and child j the node stores the least and the
greatest distance from i to the rows of j, over all rows.  A query that knows its
distance to i eliminates every child whose range, moved by the annulus, cannot
meet it.  The upper levels come from a bounded sample and are sent to the tasks;
each leaf's rows are cut into chunks, each with a node of its own, and what is
left of a chunk is scored exactly.  The search loses no row: recall is 1."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import materialise, on_workers

#: Split points of a node; of the node inside a chunk.
FAN, FAN_CHUNK = 8, 16
#: Rows, smallest hashes of the id first, that the upper levels' split points come from; levels.
SAMPLE, LEVELS = 16_384, 3
#: Rows of a chunk, about; queries scored against a chunk at once.
CHUNK, QUERIES = 2_048, 512
#: Positives of an anchor, negatives of a positive, and the window in percent of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Rounding of a distance, relative to the largest (roots of small differences of large squares).
SLACK = 1e-6


@dataclass
class Node:
    """Split points (with the added coordinate) and, per child, a node or the
    number of a leaf; ranges[0] and ranges[1] are the least and greatest
    distances from split point i to the rows of child j."""

    points: np.ndarray
    children: list = field(default_factory=list)
    ranges: np.ndarray | None = None
    number: int = 0


def lifted(x: np.ndarray, r2: float) -> np.ndarray:
    """Rows with the coordinate that puts them on the sphere."""
    rest = np.sqrt(np.maximum(r2 - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows x points, both with the added coordinate."""
    square = np.einsum("ij,ij->i", rows, rows)[:, None] + np.einsum("ij,ij->i", points, points)[None] - 2 * rows @ points.T
    return np.sqrt(np.maximum(square, 0))


def split_points(rows: np.ndarray, fan: int) -> np.ndarray:
    """Up to ``fan`` different rows, each far from those before it."""
    some = rows[np.linspace(0, len(rows) - 1, min(len(rows), 8 * fan)).astype(int)]
    chosen = [0]
    nearest = distances(some, some[:1])[:, 0]
    while len(chosen) < fan and nearest.max() > 1e-6 * (1 + np.abs(some).max()):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(some, some[chosen[-1]:][:1])[:, 0])
    return some[chosen]


@dataclass
class Tree:
    """The upper levels: root node (None: one leaf), number of leaves, chunks of
    each leaf, dimension and squared greatest norm."""

    root: Node | None
    leaves: int
    dim: int
    r2: float
    nodes: list[Node]
    parts: dict[int, int] = field(default_factory=dict)


def build(sample: np.ndarray, rows: int, dim: int, r2: float) -> Tree:
    """The tree over a sample of a table of ``rows`` rows: nodes are split while
    they stand for more than a chunk."""
    tree = Tree(None, 0, dim, r2, [])
    times = rows / max(len(sample), 1)

    def node(part: np.ndarray, level: int) -> Node | int:
        points = split_points(part, FAN) if level < LEVELS and len(part) * times > CHUNK and len(part) > 2 * FAN else part[:0]
        if len(points) < 2:
            tree.leaves += 1
            return tree.leaves - 1
        made = Node(points, number=len(tree.nodes))
        tree.nodes.append(made)
        near = distances(part, points).argmin(axis=1)
        made.children = [node(part[near == k], level + 1) for k in range(len(points))]
        return made

    top = node(lifted(sample, r2), 0) if len(sample) else 0
    tree.leaves, tree.root = max(tree.leaves, 1), top if isinstance(top, Node) else None
    return tree


def routed(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The leaf of each row, and (node, stack of its least and greatest distances
    from split points (rows) to children (columns)) over these rows."""
    leaf, seen = np.zeros(len(x), np.int64), []
    rows = lifted(x, tree.r2)

    def down(node: Node, at: np.ndarray) -> None:
        d = distances(rows[at], node.points)
        near = d.argmin(axis=1)
        met = np.full((2, len(node.points), len(node.points)), np.nan)
        for j, child in enumerate(node.children):
            mine = near == j
            if mine.any():
                met[0][:, j], met[1][:, j] = d[mine].min(axis=0), d[mine].max(axis=0)
                if isinstance(child, Node):
                    down(child, at[mine])
                else:
                    leaf[at[mine]] = child
        seen.append((node.number, met))

    if tree.root is not None and len(x):
        down(tree.root, np.arange(len(x)))
    return leaf, seen


def annulus(square: np.ndarray, low: np.ndarray, high: np.ndarray, r2: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner and outer radius for scores from ``low`` to ``high`` of queries of
    squared norm ``square``."""
    radius = lambda s: np.sqrt(np.maximum(square + r2 - 2 * s, 0))
    return radius(high), radius(low)


def may_hold(d: np.ndarray, inner: np.ndarray, outer: np.ndarray, ranges: np.ndarray, slack: float) -> np.ndarray:
    """queries x children: whether a child may hold rows of the annulus, by the
    triangle inequality at every split point."""
    alive = np.ones((len(d), ranges.shape[2]), bool)
    for i in range(d.shape[1]):
        least, most, at = ranges[0][i][None], ranges[1][i][None], d[:, i][:, None]
        # an empty child has no range, and every comparison with it is false
        alive &= (at + most >= inner[:, None] - slack) & (at - most <= outer[:, None] + slack) & (least - at <= outer[:, None] + slack)
    return alive


def visited(tree: Tree, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(leaf, queries) that a search for scores from ``low`` to ``high`` has to see."""
    square = np.einsum("ij,ij->i", q, q)
    inner, outer = annulus(square, low, high, tree.r2)
    flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
    slack = SLACK * (1 + np.sqrt(square.max(initial=0) + tree.r2))
    out = []

    def down(node: Node, at: np.ndarray) -> None:
        alive = may_hold(distances(flat[at], node.points), inner[at], outer[at], node.ranges, slack)
        for j, child in enumerate(node.children):
            mine = at[alive[:, j]]
            if len(mine) and isinstance(child, Node):
                down(child, mine)
            elif len(mine):
                out.append((child, mine))

    if tree.root is None:
        return [(0, np.arange(len(q)))]
    down(tree.root, np.arange(len(q)))
    return out


# ---- the index --------------------------------------------------------------

def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows x dim; shorter lists end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None] < sizes[:, None]] = flat
    return out


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return np.array([zlib.crc32(b"%d" % i) % parts for i in ids.tolist()], np.int64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _measured(rows: DataFrame, tree: Tree) -> None:
    """Fill the tree's ranges and chunk numbers from all rows: what comes to the
    driver is a number for each leaf and for each pair of a node's split points."""
    schema = "node int, i int, j int, least double, most double, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(tree.leaves, np.int64)
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            leaf, seen = routed(tree, _matrix(_column(batch, "v"), tree.dim))
            counts += np.bincount(leaf, minlength=tree.leaves)
            for number, met in seen:
                old = best.get(number, met)
                best[number] = np.stack([np.fmin(old[0], met[0]), np.fmax(old[1], met[1])])
        out = [(-1, int(k), 0, None, None, int(counts[k])) for k in np.flatnonzero(counts)]
        for number, met in best.items():
            out += [(number, int(i), int(j), met[0][i, j], met[1][i, j], 0) for i, j in np.argwhere(~np.isnan(met[0]))]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=["node", "i", "j", "least", "most", "n"])

    found = rows.mapInArrow(run, schema).groupBy("node", "i", "j").agg(F.min("least"), F.max("most"), F.sum("n")).collect()
    for node in tree.nodes:
        node.ranges = np.full((2, len(node.points), len(node.points)), np.nan)
    for number, i, j, least, most, n in found:
        if number < 0:
            tree.parts[i] = -(-n // CHUNK)
        else:
            tree.nodes[number].ranges[:, i, j] = least, most


CHUNK_FIELDS = "leaf int, part int, ids binary, labels binary, v binary, starts binary, points binary, ranges binary"


def _chunks(rows: DataFrame, tree: Tree) -> DataFrame:
    """One row per chunk of a leaf: its rows by child of its own node, ids
    ascending in each, with split points and ranges."""
    added = T.StructType([T.StructField("leaf", T.IntegerType()), T.StructField("part", T.IntegerType()), *rows.schema.fields])
    to = to_arrow_schema(added)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, _ = routed(tree, _matrix(_column(batch, "v"), tree.dim))
            ids = _column(batch, "id").to_numpy()
            part = np.zeros(len(leaf), np.int64)
            for k in np.unique(leaf):
                part[leaf == k] = _part(ids[leaf == k], tree.parts.get(int(k), 1))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), *batch.columns], schema=to)

    schema = to_arrow_schema(T.StructType.fromDDL(CHUNK_FIELDS))

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = _matrix(group["v"].chunk(0), tree.dim)
        ids, labels = group["id"].to_numpy(), group["label"].to_numpy()
        rows = lifted(x, tree.r2)
        points = split_points(rows, FAN_CHUNK)
        d = distances(rows, points)
        child = d.argmin(axis=1)
        order = np.lexsort((ids, child))
        starts = np.searchsorted(child[order], np.arange(len(points) + 1))
        ranges = np.full((2, len(points), len(points)), np.nan)
        for j in np.unique(child):
            ranges[0][:, j], ranges[1][:, j] = d[child == j].min(axis=0), d[child == j].max(axis=0)
        small = np.abs(x).max(initial=0) < 2**15
        row = [group["leaf"][0].as_py(), group["part"][0].as_py(), ids[order].astype("<i8").tobytes(), labels[order].astype("<i8").tobytes(),
               x[order].astype("<i2" if small else "<f8").tobytes(), starts.astype("<i8").tobytes(), points.astype("<f8").tobytes(), ranges.astype("<f8").tobytes()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return materialise(rows.mapInArrow(place, added).groupBy("leaf", "part").applyInArrow(pack, CHUNK_FIELDS))


class _Chunk:
    """A chunk ready to be searched."""

    def __init__(self, row: dict, dim: int):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        n = len(self.ids)
        self.x = np.frombuffer(row["v"], "<i2" if len(row["v"]) == 2 * n * dim and dim else "<f8").reshape(n, dim).astype(np.float64)
        self.starts = np.frombuffer(row["starts"], "<i8")
        m = len(self.starts) - 1
        self.points, self.ranges = np.frombuffer(row["points"], "<f8").reshape(m, dim + 1), np.frombuffer(row["ranges"], "<f8").reshape(2, m, m)

    def search(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray,
               same: bool, most: int, r2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, window, row, score) of the first ``most`` rows in each of the
        queries' windows (queries x windows; low > high: none): higher scores,
        then smaller ids, of the query's label (``same``) or of others."""
        square = np.einsum("ij,ij->i", q, q)
        open_ = low <= high
        inner, outer = annulus(square, np.where(open_, low, np.inf).min(axis=1), np.where(open_, high, -np.inf).max(axis=1), r2)
        slack = SLACK * (1 + np.sqrt(square.max(initial=0) + r2))
        flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        alive = may_hold(distances(flat, self.points), inner, outer, self.ranges, slack) & open_.any(axis=1)[:, None]
        score = np.full((len(q), len(self.ids)), -np.inf)
        for j, (a, b) in enumerate(zip(self.starts, self.starts[1:])):
            mine = alive[:, j]
            if b > a and mine.any():
                score[mine, a:b] = q[mine] @ self.x[a:b].T
        fit = ((labels[:, None] == self.labels[None]) == same) & (ids[:, None] != self.ids[None])
        found = []
        for w in range(low.shape[1]):
            inside = fit & (score >= low[:, w][:, None]) & (score <= high[:, w][:, None]) & np.isfinite(score)
            if not inside.any():
                continue
            held = np.where(inside, score, -np.inf)
            if held.shape[1] > most:  # what lies below the last of the first, without ties, is out
                inside &= held >= np.partition(held, held.shape[1] - most, axis=1)[:, -most][:, None]
            at, col = np.nonzero(inside)
            order = np.lexsort((self.ids[col], -held[at, col], at))
            at, col = at[order], col[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            at, col = at[nth < most], col[nth < most]
            found.append((at, np.full(len(at), w), self.ids[col], held[at, col]))
        if not found:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        return tuple(np.concatenate(c) for c in zip(*found))


# ---- the search -----------------------------------------------------------

QUERY = "id long, label long, v array<double>, keys array<bigint>, lows array<double>, highs array<double>"


def _search(chunks: DataFrame, queries: DataFrame, tree: Tree, same: bool, most: int, home: bool = False) -> DataFrame:
    """(id, key, found, score): the first ``most`` rows in each window (key, low,
    high) of each query. With ``home`` only one chunk of the query's own leaf is
    seen, for a bound; else all that may hold rows of the windows."""
    names = [f.name for f in T.StructType.fromDDL(QUERY)]
    queries = queries.select(*names)
    with_place = T.StructType([*T.StructType.fromDDL("leaf int, part int"), *T.StructType.fromDDL(QUERY)])
    to = to_arrow_schema(with_place)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                some = pa.RecordBatch.from_arrays([c.cast(to.field(k + 2).type) for k, c in enumerate(some.columns)], schema=pa.schema(list(to)[2:]))
                q = _matrix(some.column(2), tree.dim)
                if home:
                    leaf, _ = routed(tree, q)
                    part = _part(some.column(0).to_numpy(), 1 << 31)
                    seen = [(int(k), np.flatnonzero(leaf == k), part) for k in np.unique(leaf)]
                else:
                    low = np.array([min(x, default=np.inf) for x in some.column(4).to_pylist()])
                    high = np.array([max(x, default=-np.inf) for x in some.column(5).to_pylist()])
                    seen = [(leaf, rows, None) for leaf, rows in visited(tree, q, low, high)]
                for leaf, rows, part in seen:
                    picked = some.take(pa.array(rows))
                    parts = tree.parts.get(leaf, 0)  # none where the leaf has no rows
                    for k in [part[rows] % parts] if part is not None and parts else range(parts):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf), pa.int32()),
                                                          pa.array(np.broadcast_to(k, len(rows)), pa.int32()), *picked.columns], schema=to)

    on_workers(queries.sparkSession)
    asked = queries.mapInArrow(visits, with_place)
    # a chunk's row, then its queries: one chunk is held at a time, queries stream past it
    stream = (chunks.withColumn("kind", F.lit(0)).withColumnRenamed("v", "x").unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
              .repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind"))
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("found", pa.int64()), ("score", pa.int64())])

    def answers(chunk: _Chunk, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, QUERIES):
            some = batch.slice(at, QUERIES)
            keys, lows, highs = (_column(some, c).to_pylist() for c in ("keys", "lows", "highs"))
            width = max(map(len, keys))
            fill = lambda lists, value: np.array([x + [value] * (width - len(x)) for x in lists], np.float64).reshape(len(lists), width)
            ids = _column(some, "id").to_numpy()
            query, window, found, score = chunk.search(
                _matrix(_column(some, "v"), tree.dim), ids, _column(some, "label").to_numpy(),
                fill(lows, np.inf), fill(highs, -np.inf), same, most, tree.r2)
            if len(query):
                key = np.array([keys[a][b] for a, b in zip(query, window)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(key), pa.array(found), pa.array(score.astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, None
        for batch in batches:
            kinds = _column(batch, "kind").to_numpy()
            place = np.stack([_column(batch, c).to_numpy() for c in ("leaf", "part")], axis=1)
            cuts = np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                here = tuple(place[a])
                if kinds[a] == 0:
                    row = {c: _column(batch, c)[int(a)].as_py() for c in ("ids", "labels", "starts", "points", "ranges")}
                    chunk, held = _Chunk(row | {"v": _column(batch, "x")[int(a)].as_py()}, tree.dim), here
                elif here == held:  # a chunk number may have no rows
                    yield from answers(chunk, batch.slice(a, b - a))

    each = stream.mapInArrow(run, "id long, key long, found long, score long")
    first = Window.partitionBy("id", "key").orderBy(F.col("score").desc(), "found")
    return each.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor (rows where ``anchors`` holds) and each of its first
    ``positives`` other rows of the same label, the first ``negatives`` rows of
    another label whose score is at least ``low`` and at most ``high`` percent of
    the positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Scores are inner products, higher first, ties by smaller id.

    Vectors hold integers. Rows with a null id, label, vector or component take no
    part; a shorter vector ends in zeros. Of rows that share an id, the one with
    the least (label, vector) takes part, so rows that repeat count once. Other
    columns are ignored. An empty table, or one without anchors, gives an empty
    result. A squared norm beyond 2^53 is an error: scores would not be exact."""
    clean = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                      F.col(f"`{vector_col}`").cast("array<double>").alias("v"), anchors.alias("anchor"))
    clean = clean.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", lambda x: x.isNotNull()))
    rows = materialise(clean.groupBy("id").agg(F.min(F.struct("label", "v", F.coalesce("anchor", F.lit(False)).alias("anchor"))).alias("x"))
                       .select("id", "x.label", "x.v", "x.anchor"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, dim, r2 = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    if not r2 <= 2**53:
        raise ValueError("squared norms beyond 2^53: inner products would not be exact")
    vectors = rows.select("id", "label", "v")
    on_workers(df.sparkSession)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = sample if isinstance(sample, pa.Array) else pa.concat_arrays(sample.chunks)
    tree = build(_matrix(sample, dim), n, dim, r2)
    _measured(vectors, tree)
    chunks = _chunks(vectors, tree)

    one = lambda key, a, b: (F.array(F.lit(key).cast("long")).alias("keys"), F.array(a.cast("double")).alias("lows"), F.array(b.cast("double")).alias("highs"))
    asked = rows.where("anchor").select("id", "label", "v")
    every = F.lit(float("inf"))
    near = _search(chunks, asked.select("*", *one(0, -every, every)), tree, True, positives, home=True)
    bound = near.where(F.col("rank") == positives).select("id", F.col("score").alias("bound"))
    asked = materialise(asked.join(bound, "id", "left"))
    positive = materialise(_search(chunks, asked.select("id", "label", "v", *one(0, F.coalesce("bound", -every), every)), tree, True, positives)
                           .select("id", F.col("found").alias("key"), F.col("score").alias("positive_score")))
    down = lambda x: (x - F.pmod(x, F.lit(100))) / 100  # noqa: E731  whole hundreds, so that the quotient is exact
    window = F.struct("key", (-down(-F.col("positive_score") * low)).alias("low"), down(F.col("positive_score") * high).alias("high"))
    # at most ``positives`` windows for an anchor
    windows = positive.select("id", window.alias("w")).where("w.low <= w.high").groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    asked = asked.select("id", "label", "v").join(windows, "id").select(
        "id", "label", "v", F.col("w.key").alias("keys"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    negative = _search(chunks, asked, tree, False, negatives)
    return negative.join(positive, ["id", "key"]).select(
        F.col("id").alias("anchor_id"), F.col("key").alias("positive_id"), "rank", F.col("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of a table (vec_id, embedding, label): components become
    ``floor(256 * x)``, rows whose id is divisible by 7 get the next label of ten,
    anchors are the rows whose id is divisible by 100. Rows with a non-finite
    component take no part either."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform(x, lambda c: F.floor(256 * c)).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


MINED_SQL = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
    p AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5"""
