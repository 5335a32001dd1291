"""Deep random forests on many rows.

MLlib grows all trees level by level and looks at every row for every tree on
every level, drawn or not. Here the features are binned once (a byte each), the
rows of a tree are those drawn for it (as often as drawn), and they stay grouped
by node, so that a level of a subtree is a few vectorised steps. The forest is
MLlib's: draws with replacement, bins, a random subset of the features for each
node, weighted Gini, least rows of a leaf, siblings of one class merged. The model
scores binned rows, all of a batch with one tree after the other.

Nodes too large for one task are split from histograms that every task of rows adds
to; rows meet in one task only below that, ``LOCAL_DRAWS`` of them at most, a batch
of trees at a time. To the driver come bin borders, splits and the finished nodes."""

from __future__ import annotations

import pickle
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import copy_path, cut_lineage, delete, drop_copy, ensure_checkpoint_dir, reading_session

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Rows (as often as drawn) of a subtree that one task grows by itself, at most.
LOCAL_DRAWS = 3_000_000
#: Bytes of drawn rows that trees of one batch exchange, unless that leaves cores without a tree.
BATCH_BYTES = 400 << 20
#: Rows that are binned, scored or counted in one vectorised step.
STEP = 1 << 15
#: Rows of a block of binned rows.
BLOCK = 1 << 17
#: Values that stand for a feature's distribution when bins are chosen.
POINTS = 2048
#: Bytes of binned rows that one task holds.
TASK_BYTES = 32 << 20


# ---------------------------------------------------------------- bins

def _shorter(values, weights):
    """Sorted different values with their weights; many are replaced by POINTS of about equal weight."""
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights=weights, minlength=len(values))
    if len(values) <= POINTS:
        return values, weights
    ends = np.cumsum(weights)
    part = np.minimum((ends - weights / 2) * (POINTS / ends[-1]), POINTS - 1).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    middle = (first + np.append(first[1:], len(part))) // 2
    return values[middle], np.add.reduceat(weights, first)


def _merged(a, b):
    return [_shorter(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])) for x, y in zip(a, b)]


def borders(values, weights, bins):
    """MLlib's candidate splits: between all values if these are few, else where the weight before passes the next of ``bins`` equal shares."""
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    stride, out = weights.sum() / bins, []
    before, target = weights[0], stride
    for i in range(1, len(values)):
        now = before + weights[i]
        if abs(before - target) < abs(now - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
        before = now
    return np.array(out[:bins - 1])


def _matrix(batch):
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _find_borders(df, label, features, class_weights, bins):
    def summary(batches):
        parts = None
        for b in batches:
            if b.num_rows:
                x, w = _matrix(b), class_weights[b.column(b.schema.get_field_index("y")).to_numpy().astype(np.int64)]
                one = [_shorter(c[~np.isnan(c)], w[~np.isnan(c)]) for c in x.T]
                parts = [[p] for p in one] if parts is None else [[*p, q] for p, q in zip(parts, one)]
        if parts:
            told = [_shorter(*map(np.concatenate, zip(*p))) for p in parts]
            yield pa.RecordBatch.from_pydict({"s": pa.array([pickle.dumps(told)], pa.binary())})

    x = df.select(F.col(label).alias("y"), vector_to_array(features).alias("x")).mapInArrow(summary, "s binary")
    told = x.rdd.map(lambda r: pickle.loads(bytes(r.s))).treeReduce(_merged)
    return [borders(v, w, bins) if len(v) else np.zeros(0) for v, w in told]


def width(d):
    """Bytes of a row of ``d`` codes and its draws: rows of such sizes move fastest."""
    return 1 << d.bit_length() if d < 32 else d + 1


def binned(x, at):
    rows = np.empty(x.shape, np.uint8)
    for f, t in enumerate(at):
        rows[:, f] = np.searchsorted(t, x[:, f], side="left")
    return rows


def _pack(df, label, features, at):
    """Blocks of about BLOCK rows: a number, and as bytes the rows' codes, with room
    for draws: a code is twice the bin of a feature, and one more for label 1."""
    def run(batches):
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            y = b.column(b.schema.get_field_index("y")).to_numpy().astype(np.uint8)
            rows = np.zeros((len(y), width(len(at))), np.uint8)
            rows[:, :len(at)] = binned(_matrix(b), at) * 2 + y[:, None]
            held.append(rows.tobytes())
            n += len(y)
            if n >= BLOCK:
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "rows": pa.array([b"".join(held)], pa.binary())})
                number, held, n = number + 1, [], 0
        if n:
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "rows": pa.array([b"".join(held)], pa.binary())})

    return df.select(F.col(label).alias("y"), vector_to_array(features).alias("x")).mapInArrow(run, "block long, rows binary")


# ---------------------------------------------------------------- draws and walks

_CDF = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
_DRAWN = np.searchsorted(_CDF, np.arange(65536) / 65536, side="right").astype(np.uint8)
_BETWEEN = _DRAWN != np.searchsorted(_CDF, np.arange(1, 65537) / 65536, side="left")


def draws(n, seed, tree, block):
    """How often each of a block's rows is drawn for a tree: Poisson(1), the same whenever a task is run again."""
    rng = np.random.default_rng([seed, tree, block])
    u = rng.integers(0, 65536, n, np.uint16)
    c = _DRAWN[u]
    more = np.flatnonzero(_BETWEEN[u])  # the 16 bits do not decide yet
    c[more] = np.searchsorted(_CDF, (u[more] + rng.random(len(more))) / 65536, side="right")
    return c


def _drawn(rows, d, seed, tree, block):
    """The drawn rows, with how often in column ``d``."""
    c = draws(len(rows), seed, tree, block)
    at = np.flatnonzero(c)
    out = rows.take(at, axis=0)
    out[:, d] = c[at]
    return out


def _walk(rows, top):
    """The node of the upper part of a tree that each row ends in."""
    feature, cut, kids, depth = top
    node = np.zeros(len(rows), np.int64)
    flat, start = rows.reshape(-1), np.arange(len(rows)) * rows.shape[1]
    for _ in range(depth):
        f = feature[node]
        right = flat.take(start + np.maximum(f, 0)) > 2 * cut[node] + 1
        node = np.where(f >= 0, kids[node, right.astype(np.int64)], node)
    return node


# ---------------------------------------------------------------- splits

def subsets(rng, nodes, d, k):
    """``k`` different features for each node."""
    return np.argpartition(rng.random((nodes, d)), k - 1, axis=1)[:, :k] if k < d else np.tile(np.arange(d), (nodes, 1))


def _histogram(rows, node, feats, bins, d):
    """Draws by (node, feature of its subset, bin, label)."""
    q, k = feats.shape
    n = rows[:, d].astype(np.float64)
    if q == 1:
        return np.stack([np.bincount(rows[:, f], n, 2 * bins) for f in feats[0]]).reshape(1, k, bins, 2)
    key = (np.arange(q * k) * (2 * bins)).reshape(q, k)[node]
    key += rows.reshape(-1).take((np.arange(len(rows)) * rows.shape[1])[:, None] + feats[node])
    return np.bincount(key.ravel(), np.repeat(n, k), q * k * bins * 2).reshape(q, k, bins, 2)


def best_splits(h, feats, weights, min_leaf):
    """For each node the split that lowers the weighted Gini most: (found, feature,
    last bin of the left side, draws by label on the left, in all)."""
    q, _, bins, _ = h.shape
    left = np.cumsum(h, axis=2)
    total = left[:, 0, -1]
    left = left[:, :, :-1]
    n = left[..., 0] + left[..., 1]
    valid = (n >= min_leaf) & (total.sum(-1)[:, None, None] - n >= min_leaf)

    def purity(a, b):  # weight times (1 - Gini)
        a, b = a * weights[0], b * weights[1]
        return np.divide(a * a + b * b, a + b, out=np.zeros(a.shape), where=a + b > 0)

    a, b = left[..., 0], left[..., 1]
    gain = purity(a, b) + purity(total[:, 0, None, None] - a, total[:, 1, None, None] - b) - purity(total[:, 0], total[:, 1])[:, None, None]
    gain = np.where(valid, gain, -np.inf).reshape(q, -1)
    at, node = gain.argmax(1), np.arange(q)
    slot, cut = np.divmod(at, bins - 1)
    return gain[node, at] > 1e-12 * (total * weights).sum(-1), feats[node, slot], cut, left[node, slot, cut], total


def grow(rows, d, bins, weights, depth, min_leaf, k, rng):
    """A subtree from its drawn rows (codes, draws): arrays (feature or -1, last
    bin of the left side, left child - the right one follows -, draws by label), nodes in the order of levels."""
    wide, stats = rows.shape[1], [np.bincount(rows[:, 0] & 1, rows[:, d], 2)[None]]
    sizes, ids, count, nodes = np.array([len(rows)]), np.array([0]), 1, []
    for level in range(depth):
        feats, starts = subsets(rng, len(sizes), d, k), np.concatenate([[0], np.cumsum(sizes)])
        keep, kid_sizes, kid_ids, found = [], [], [], []
        i = 0
        while i < len(sizes):  # some small nodes, or one large one, at a time
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP, side="right")) - 1)
            r, q = rows[starts[i]: starts[j]], j - i
            node = np.repeat(np.arange(q), sizes[i:j]) if q > 1 else None
            ok, f, cut, left, total = best_splits(_histogram(r, node, feats[i:j], bins, d), feats[i:j], weights, min_leaf)
            kids = np.stack([left, total - left], 1)[ok]
            kid = np.full(q, -1, np.int64)
            kid[ok] = count + 2 * np.arange(len(kids))
            count += 2 * len(kids)
            found.append((f[ok], cut[ok], kid[ok], ids[i:j][ok]))
            stats.append(kids.reshape(-1, 2))
            # children that a further level may split
            on = np.zeros((q, 2), bool)
            on[ok] = (kids.min(2) > 0) & (kids.sum(2) >= 2 * min_leaf)
            if level + 1 < depth and on.any():
                if q == 1:
                    goes = r[:, f[0]] > 2 * cut[0] + 1
                    parts = [r.take(np.flatnonzero(goes == side), axis=0) for side in (0, 1) if on[0, side]]
                    keep += parts
                    kid_sizes += [np.array([len(p)]) for p in parts]
                else:
                    to = node * 2 + (r.reshape(-1).take(np.arange(len(r)) * wide + f[node]) > (2 * cut + 1)[node])
                    place = np.cumsum(on.ravel()) - 1
                    stay = np.flatnonzero(on.ravel()[to])
                    to = place[to[stay]].astype(np.uint16)
                    keep.append(r.take(stay[np.argsort(to, kind="stable")], axis=0))
                    kid_sizes.append(np.bincount(to, minlength=int(on.sum())))
                kid_ids.append((kid[:, None] + [0, 1])[on])
            i = j
        nodes.append([np.concatenate(c) for c in zip(*found)])
        if not keep:
            break
        rows, sizes, ids = np.concatenate(keep), np.concatenate(kid_sizes), np.concatenate(kid_ids)
    return merged_leaves(nodes, np.concatenate(stats), weights)


def merged_leaves(levels, stats, weights):
    """The tree without splits whose two sides are leaves of one class, as MLlib prunes."""
    feature, cut, kid = np.full(len(stats), -1, np.int16), np.zeros(len(stats), np.uint8), np.full(len(stats), -1, np.int32)
    one = predicted(stats, weights)
    for f, c, to, at in levels:
        feature[at], cut[at], kid[at] = f, c, to
    for *_, to, at in reversed(levels):
        same = (feature[to] < 0) & (feature[to + 1] < 0) & (one[to] == one[to + 1])
        feature[at[same]] = -1
    reached = np.zeros(len(stats), bool)
    reached[0] = True
    for *_, to, at in levels:
        live = to[reached[at] & (feature[at] >= 0)]
        reached[live] = reached[live + 1] = True
    number = np.cumsum(reached) - 1
    kid = np.where(feature >= 0, number[np.maximum(kid, 0)], -1).astype(np.int32)
    return feature[reached], cut[reached], kid[reached], stats[reached].astype(np.int64)


def predicted(stats, weights):
    w = stats * weights
    return w[..., 1] > w[..., 0]


# ---------------------------------------------------------------- the forest

def _upper(blocks, d, bins, weights, trees, depth, min_leaf, k, seed, rows):
    """The upper parts of the trees: nodes with more than LOCAL_DRAWS draws, split level by level from histograms over all tasks.

    Per tree [feature, cut, kids, draws by label, level, whether it is the root of a
    subtree that one task grows] of each node; what is neither split nor such a root is a leaf."""
    large = rows > LOCAL_DRAWS and depth > 0
    tops = [[[-1], [0], [[-1, -1]], [None], [0], [not large]] for _ in range(trees)]
    open_ = {t: [0] for t in range(trees)} if large else {}
    while open_:
        asked = {t: (_packed(tops[t]), np.array(nodes), subsets(np.random.default_rng([seed, t, nodes[0], 2]), len(nodes), d, k))
                 for t, nodes in open_.items()}

        def count(batches):
            held = [(b, np.frombuffer(r, np.uint8).reshape(-1, width(d))) for b, r in _blocks(batches)]
            for t, (top, nodes, feats) in asked.items():
                number, total = np.full(len(top[0]), -1), 0
                number[nodes] = np.arange(len(nodes))
                for b, r in held:
                    x = _drawn(r, d, seed, t, b)
                    at = number[_walk(x, top)]
                    if top[3]:
                        on = np.flatnonzero(at >= 0)
                        x, at = x.take(on, axis=0), at[on]
                    for s in range(0, len(x), STEP):
                        total = total + _histogram(x[s: s + STEP], at[s: s + STEP], feats, bins, d)
                if held:
                    h = np.broadcast_to(total, (len(nodes), k, bins, 2)).astype(np.float64)
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "h": pa.array([h.tobytes()], pa.binary())})

        def choose(key, table):
            t = key[0].as_py()
            _, nodes, feats = asked[t]
            total = np.zeros((len(nodes), k, bins, 2))
            for h in table["h"]:
                total += np.frombuffer(h.as_buffer(), np.float64).reshape(total.shape)
            ok, f, cut, left, both = best_splits(total, feats, weights, min_leaf)
            return pa.Table.from_pydict({"tree": pa.array([t] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int32()), "ok": pa.array(ok),
                                              "f": pa.array(f, pa.int32()), "cut": pa.array(cut, pa.int32()),
                                              **{c: pa.array(v, pa.int64()) for c, v in zip(("l0", "l1", "n0", "n1"), [*left.T.astype(np.int64), *both.T.astype(np.int64)])}})

        found = blocks.mapInArrow(count, "tree int, h binary").groupBy("tree").applyInArrow(
            choose, "tree int, node int, ok boolean, f int, cut int, l0 long, l1 long, n0 long, n1 long").collect()
        open_ = {}
        for r in sorted(found, key=lambda r: (r.tree, r.node)):
            feature, cut, kids, stats, level, task = tops[r.tree]
            stats[r.node] = (r.n0, r.n1)
            if not r.ok:
                continue
            feature[r.node], cut[r.node], kids[r.node] = r.f, r.cut, [len(feature), len(feature) + 1]
            for s in ((r.l0, r.l1), (r.n0 - r.l0, r.n1 - r.l1)):
                on = min(s) > 0 and sum(s) >= 2 * min_leaf and level[r.node] + 1 < depth
                if on and sum(s) > LOCAL_DRAWS:
                    open_.setdefault(r.tree, []).append(len(feature))
                for into, v in zip(tops[r.tree], (-1, 0, [-1, -1], s, level[r.node] + 1, on and sum(s) <= LOCAL_DRAWS)):
                    into.append(v)
    return tops


def _packed(top):
    return np.array(top[0]), np.array(top[1]), np.array(top[2]), max(top[4])


def _blocks(batches):
    for b in batches:
        for i, r in zip(b.column(b.schema.get_field_index("block")).to_pylist(), b.column(b.schema.get_field_index("rows"))):
            yield i, r.as_buffer()


def _subtrees(blocks, tops, batch, d, bins, weights, depth, min_leaf, k, seed, cores):
    """(tree, root, nodes, first leaf and class, arrays) of every subtree of a batch of trees."""
    packed, task, levels = {t: _packed(tops[t]) for t in batch}, {t: np.array(tops[t][5]) for t in batch}, {t: tops[t][4] for t in batch}

    def send(batches):
        for b, r in _blocks(batches):
            r = np.frombuffer(r, np.uint8).reshape(-1, width(d))
            for t, top in packed.items():
                x = _drawn(r, d, seed, t, b)
                node = _walk(x, top)
                if top[3]:
                    order = np.argsort(node.astype(np.uint16), kind="stable")
                    order = order[task[t][node[order]]]
                    x, node = x.take(order, axis=0), node[order]
                first = np.flatnonzero(np.diff(node, prepend=-1))
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([t] * len(first), pa.int32()), "root": pa.array(node[first], pa.int32()),
                    "rows": pa.array([x[s:e].tobytes() for s, e in zip(first, [*first[1:], len(x)])], pa.binary())})

    def build(key, table):
        t, root = (v.as_py() for v in key)
        rows = np.concatenate([np.frombuffer(v.as_buffer(), np.uint8) for v in table["rows"]])
        feature, cut, kid, stats = grow(rows.reshape(-1, width(d)), d, bins, weights, depth - levels[t][root], min_leaf, k, np.random.default_rng([seed, t, root, 1]))
        return pa.Table.from_pydict({
            "tree": pa.array([t], pa.int32()), "root": pa.array([root], pa.int32()), "n": pa.array([len(feature)], pa.int32()),
            "leaf": pa.array([bool(feature[0] < 0)]), "one": pa.array([bool(predicted(stats[:1], weights)[0])]),
            **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("feature", "cut", "kid", "stats"), (feature, cut, kid, stats))}})

    keys = max(1, sum(int(t.sum()) for t in task.values()))
    sent = blocks.mapInArrow(send, "tree int, root int, rows binary").repartition(min(keys, 32 * cores), "tree", "root")
    return sent.groupBy("tree", "root").applyInArrow(
        build, "tree int, root int, n int, leaf boolean, one boolean, feature binary, cut binary, kid binary, stats binary")


def _number_nodes(top, subtrees, weights):
    """The numbers of a tree's nodes in the saved forest, parents before children:
    {node of the upper part: number} without the nodes below merged leaves, and those that are a split.
    ``subtrees``: root -> (nodes, whether that is a leaf, its class)."""
    feature, _, kids, stats, _, task = top
    leaf, split = {}, set()
    for v in reversed(range(len(feature))):
        if feature[v] >= 0:
            (a, one_a), (b, one_b) = (leaf[c] for c in kids[v])
            leaf[v] = (a and b and one_a == one_b, one_a)
            if not leaf[v][0]:
                split.add(v)
        else:
            leaf[v] = subtrees[v][1:] if task[v] else (True, bool(predicted(np.array(stats[v]), weights)))
    order = [0]
    for v in order:
        if v in split:
            order += kids[v]
    whole = [v for v in order if task[v]]
    number = {v: i for i, v in enumerate(v for v in order if not task[v])}
    free = len(number)
    for v in whole:
        number[v], free = free, free + subtrees[v][0]
    return number, split


def _whole_trees(tops, grown, weights):
    """(feature, cut, kids, draws by label) of every tree, from its upper part and its subtrees."""
    told = {}
    for r in grown.collect():
        told.setdefault(r.tree, {})[r.root] = r
    for t, (feature, cut, kids, stats, level, task) in enumerate(tops):
        of = told.get(t, {})
        number, split = _number_nodes(tops[t], {v: (r.n, r.leaf, r.one) for v, r in of.items()}, weights)
        n = sum(of[v].n if task[v] else 1 for v in number)
        whole = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.full((n, 2), -1, np.int32), np.zeros((n, 2), np.int64)
        for v, at in number.items():
            if task[v]:
                r = of[v]
                f, c, kid, own = (np.frombuffer(b, k) for b, k in ((r.feature, np.int16), (r.cut, np.uint8), (r.kid, np.int32), (r.stats, np.int64)))
                both = np.where(f[:, None] >= 0, kid[:, None] + np.array([at, at + 1], np.int32), -1)
                for into, x in zip(whole, (f, c, both, own.reshape(-1, 2))):
                    into[at: at + r.n] = x
            else:
                whole[3][at] = stats[v]
                if v in split:
                    whole[0][at], whole[1][at], whole[2][at] = feature[v], cut[v], [number[c] for c in kids[v]]
        yield whole


class Forest:
    """A fitted forest for labels 0 and 1, used like MLlib's model."""

    def __init__(self, est, borders_, weights, trees):
        self.est, self.borders, self.weights, self.trees = est, borders_, weights, trees
        self._sent = None

    @property
    def getNumTrees(self):
        return len(self.trees)

    @property
    def totalNumNodes(self):
        return sum(len(t[0]) for t in self.trees)

    def getMaxDepth(self):
        return self.est.getMaxDepth()

    @property
    def featureImportances(self):
        """As MLlib's: what a feature's splits lower the Gini by, times their weight, equal parts of every tree."""
        total = np.zeros(len(self.borders))
        for feature, _, kids, stats in self.trees:
            at = np.flatnonzero(feature >= 0)
            w = stats * self.weights
            impure = w.sum(1) - (w * w).sum(1) / w.sum(1)
            one = np.bincount(feature[at], impure[at] - impure[kids[at]].sum(1), len(total))
            total += one / one.sum() if one.sum() > 0 else one
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def probability(self, x):
        """Mean over the trees of the weighted share of label 1 in a row's leaf."""
        return scored(binned(x, self.borders), [_leaf_loops(*t, self.weights) for t in self.trees])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with rawPrediction, probability and prediction (1 where that is the likelier)."""
        if self._sent is None:  # once for all frames
            self._sent = df.sparkSession.sparkContext.broadcast((self.borders, [_leaf_loops(*t, self.weights) for t in self.trees]))
        sent, n = self._sent, float(len(self.trees))

        def score(x: pa.Array) -> pa.Array:
            at, trees = sent.value
            return pa.array(scored(binned(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), at), trees))

        one = F.col("__one")
        out = df.withColumn("__one", F.arrow_udf(score, "double")(vector_to_array(self.est.getFeaturesCol())))
        return out.withColumns({"rawPrediction": array_to_vector(F.array((1 - one) * n, one * n)), "probability": array_to_vector(F.array(1 - one, one)),
                                "prediction": F.when(one > 0.5, 1.0).otherwise(0.0)}).drop("__one")


def _leaf_loops(feature, cut, kids, stats, weights):
    """A tree to walk a fixed number of steps: leaves lead to themselves. (feature, cut, kids one after the other, share of label 1, depth)"""
    inner = feature >= 0
    self_ = np.arange(len(feature), dtype=np.int32)[:, None]
    depth, at = 0, np.array([0])
    while len(at := kids[at[inner[at]]].ravel()):
        depth += 1
    w = stats * weights
    return np.where(inner, feature, 0).astype(np.int16), cut, np.where(inner[:, None], kids, self_).ravel(), w[:, 1] / w.sum(1), depth


def scored(rows, trees):
    """Mean share of label 1 in the leaves of binned rows."""
    n, d = rows.shape
    flat, start, total = rows.reshape(-1), np.arange(n) * d, np.zeros(n)
    place, value, border, node = np.empty(n, np.int64), np.empty(n, np.uint8), np.empty(n, np.uint8), np.empty(n, np.int64)
    for feature, cut, kids, share, depth in trees:
        feature, kids = feature.astype(np.int64), kids.astype(np.int64)
        node[:] = 0
        for _ in range(depth):
            feature.take(node, out=place, mode="clip")
            place += start
            flat.take(place, out=value, mode="clip")
            cut.take(node, out=border, mode="clip")
            node *= 2
            node += value > border
            kids.take(node, out=place, mode="clip")
            place, node = node, place
        total += share.take(node)
    return total / len(trees)


def fit(est, df: DataFrame, dealt: DataFrame, class_weights, rows: int) -> Forest:
    """``est``, a RandomForestClassifier for labels 0 and 1 whose weights depend on
    the label alone, fitted on the ``rows`` rows of ``df``; ``dealt`` are the same rows over all cores."""
    spark, weights = df.sparkSession, np.array(class_weights)
    label, features, seed, depth, min_leaf = est.getLabelCol(), est.getFeaturesCol(), est.getSeed(), est.getMaxDepth(), est.getMinInstancesPerNode()
    at = _find_borders(df, label, features, weights, est.getMaxBins())
    d, bins, trees = len(at), max(2, 1 + max(map(len, at))), est.getNumTrees()
    k = max(1, int(np.ceil(np.sqrt(d)))) if trees > 1 else d
    cores = spark.sparkContext.defaultParallelism
    written, path = cut_lineage(_pack(dealt, label, features, at)), f"{ensure_checkpoint_dir(spark).rstrip('/')}/forests/{uuid.uuid4().hex}"
    own = reading_session(spark, min(TASK_BYTES, max(1, rows * width(d) // (2 * cores))))
    try:
        blocks = own.read.parquet(copy_path(written))
        tops = _upper(blocks, d, bins, weights, trees, depth, min_leaf, k, seed, rows)
        size = max(4 * cores, int(BATCH_BYTES // (0.64 * rows * width(d))))
        starts = range(0, trees, size)
        for s in starts:
            _subtrees(blocks, tops, range(s, min(s + size, trees)), d, bins, weights, depth, min_leaf, k, seed, cores).write.parquet(f"{path}/{s}")
        return Forest(est, at, weights, list(_whole_trees(tops, own.read.parquet(*[f"{path}/{s}" for s in starts]), weights)))
    finally:
        drop_copy(written)
        delete(spark, path)
