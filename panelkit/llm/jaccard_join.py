"""N-gram Jaccard join, size-aware heavy-light.

Equal shingle sets are one class; the join runs on classes.  Shingles are
ordered rare first, and sets that link share enough of their first ones: light
(small) sets enumerate all pairs of their first shingles, so that candidates
share two at once; heavy (large) sets scan inverted lists of single shingles.
The boundary is the size at which both together cost least: where a list is only
scanned for its head, that follows from the sizes; elsewhere a few sets are taken
and what either way would write and compare for each of them is counted.
Candidates are verified on their whole sets.  A copy written on the way is deleted
once its last reader has run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.session import drop_copy

from ._common import id_and_text, map_texts, materialise, texts
from .components import connected_components

#: Words per shingle, and the link threshold as a fraction (percent of the union).
N, PERCENT = 5, 80
#: Sets up to this size keep all their shingles for the search.
SMALL = 64
#: Sets whose costs either way are counted to choose the boundary of light sets.
COUNTED = 48
#: Bits of the parity sketch of a set.
SKETCH = 512
#: Ids that are broadcast at most, to pick their texts in place.
BROADCAST_IDS = 1_000_000


# ---- sets ---------------------------------------------------------------

def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct 63-bit hashes of the ``n``-word shingles; with fewer
    words, of the whole sequence; none without words."""
    words = text.encode().lower().split()  # A-Z; white space x20, x09-x0D
    if not words:
        return np.zeros(0, np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    if len(h) < n:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([whole >> 1], np.int64)
    key = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        key = (key ^ h[k: k + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return np.unique(key >> np.uint64(1)).astype(np.int64)


def region(percent: int) -> int:
    """Shingle hashes have 63 bits; document frequencies are counted below this
    one, which leaves more of a set than the search can need of it."""
    return int(min(1.0, 1.6 * (100 - percent) / 100) * 2**63)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with any set it links to."""
    return -(-percent * n // 100)


def _sets(base: DataFrame, n: int, percent: int, whole: bool) -> DataFrame:
    """(id, n, sig, low): set size, 128-bit signature, and the shingles: all of
    them, or those that the search can need, smallest hashes first. With whole
    sets also ``bits``: for each of ``SKETCH`` residues, whether an odd number
    of shingles has it."""

    def make():
        def work(batch):
            sizes, signatures, lows, ends, bits = [], [], [], [0], []
            for text in texts(batch):
                s = shingles(text, n)
                sizes.append(len(s))
                signatures.append(xxhash.xxh3_128_digest(s.tobytes()))
                if whole:
                    odd = np.bincount(s % SKETCH, minlength=SKETCH) % 2 == 1
                    bits.append(np.packbits(odd).view(np.int64))
                elif len(s) > SMALL:
                    s = s[: max(len(s) - least_overlap(len(s), percent) + 2, int(np.searchsorted(s, region(percent))))]
                lows.append(s)
                ends.append(ends[-1] + len(s))
            low = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lows), pa.int64()))
            return None, [sizes, signatures, low] + [bits] * whole

        return work

    return map_texts(base, "n long, sig binary, low array<bigint>" + ", bits array<bigint>" * whole, make)


# ---- candidates ---------------------------------------------------------

def _ordered(low: Column, freq: Column, end: int) -> Column:
    """The shingles rare first. ``freq`` lists those that sets of several labels
    hold, as (df, h); the rest of the counted region leads to no other label. Shingles
    beyond the region, whose frequency nobody counted, come last."""
    shared = F.coalesce(F.transform(freq, lambda x: x["h"]), F.array().cast("array<bigint>"))
    alone = F.array_except(F.filter(low, lambda x: x < end), shared)
    beyond = F.filter(low, lambda x: x >= end)
    item = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("h"))
    return F.concat(F.transform(alone, item(0)), F.transform(shared, item(1)), F.transform(beyond, item(1)))


def _light_by_heads(percent: int) -> int:
    """The largest set size at which enumerating pairs of the first p + 1
    shingles costs no more than posting a set in p lists and comparing it with
    the head of each."""
    size = 1
    while (size + 2 - least_overlap(size + 1, percent) + 1) / 2 <= 2:
        size += 1
    return size


def _light_by_count(ranked: DataFrame, posted: DataFrame) -> int:
    """The set size up to which sets are light, from the costs of ``COUNTED`` sets
    (those of least hash of the id), each counted in full. ``posted`` are the
    entries (id, label, h) of first shingles. A pair of sets that share m of them
    meets m times in lists of single shingles and m * (m - 1) / 2 times in lists
    of pairs, which also have to be written."""
    some = ranked.orderBy(F.xxhash64("id"), "id").limit(COUNTED).select(F.col("id").alias("of"), "n")
    mine = posted.join(F.broadcast(some), F.col("id") == F.col("of")).select("of", F.col("n").alias("size"), F.col("label").alias("own_label"), "h")
    met = mine.join(posted, "h").where("label <> own_label").groupBy("of", "id").agg(F.count("*").alias("m")).groupBy("of").agg(
        F.sum("m").alias("scan"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"))
    written = mine.groupBy("of", "size").agg(F.count("*").alias("q"))
    rows = written.join(met, "of", "left").select("size", "q", F.coalesce("scan", F.lit(0)), F.coalesce("pairs", F.lit(0))).collect()
    costs = [(size, q * (q - 1) / 2 + pairs, q + scan) for size, q, scan, pairs in rows]
    total = lambda limit: sum(light if size <= limit else heavy for size, light, heavy in costs)
    return min(sorted({1, *(size for size, _, _ in costs)}), key=total)


def _keys(reps: DataFrame, percent: int, end: int, heads: bool) -> DataFrame:
    """A copy of (key, id, n, light, pos, own): what each class (id, label, n, low) is
    posted under, the place of that shingle in its order, and its share of
    shingles (per mille) that no other label holds. Those are left out: links
    are sought between labels, and two sets of different labels that share a
    shingle make it one that both labels hold. A scan makes a candidate of each
    entry and its list's head (``heads``), or of each two entries of different
    labels; that sets the boundary between light and heavy."""
    post = reps.select("id", "label", F.explode(F.filter("low", lambda x: x < end)).alias("h"))
    shared = materialise(post.groupBy("h").agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y"))
                         .where("x < y").select("h", "df"))
    # at most one set's shingles in a group
    freq = materialise(post.select("id", "h").join(shared, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("freq")))
    drop_copy(shared)
    ranked = reps.join(freq, "id", "left").select("id", "n", _ordered(F.col("low"), F.col("freq"), end).alias("order"))
    first = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1).cast("int")
    own = F.floor(1000 * F.size(F.filter("order", lambda x: x["kind"] == 0)) / F.size("order"))
    ranked = materialise(ranked.join(reps.select("id", "label"), "id").select(
        "id", "label", "n", own.alias("own"), F.slice("order", 1, first + 1).alias("order")))
    drop_copy(freq)

    def posted(size: Column) -> Column:
        placed = F.transform(F.slice("order", 1, size), lambda x, i: F.struct(x["kind"].alias("kind"), x["h"].alias("h"), (i + 1).alias("pos")))
        return F.filter(placed, lambda x: x["kind"] == 1)

    if heads:
        limit = _light_by_heads(percent)
    else:
        entries = materialise(ranked.select("id", "label", F.explode(posted(first + 1)).alias("x")).select("id", "label", "x.h"))
        limit = _light_by_count(ranked, entries)
        drop_copy(entries)
    light = F.col("n") <= limit
    # sets that a heavy one may link to are posted in the lists as well
    lists = ranked.where(F.col("n") >= least_overlap(limit + 1, percent)).select(
        "id", "n", light.alias("light"), "own", F.explode(posted(first)).alias("x")).select("*", F.col("x.h").alias("key"), F.col("x.pos").alias("pos"))
    pair = lambda a, b: F.xxhash64(F.least(a["h"], b["h"]), F.greatest(a["h"], b["h"]))
    pairs = ranked.where(light & (F.col("n") > 1)).withColumn("some", posted(first + 1)).select(
        "id", "n", F.lit(False).alias("light"), "own", F.explode(F.flatten(F.transform("some", lambda a, i: F.transform(
            F.slice("some", i + 2, F.size("some")), lambda b: pair(a, b))))).alias("key"), F.lit(1).alias("pos"))
    columns = ["key", "id", "n", "light", "pos", "own"]
    keys = materialise(lists.select(*columns).unionByName(pairs.select(*columns)))
    drop_copy(ranked)
    return keys


def _possible(percent: int) -> Column:
    """The sizes of two sets, and what is left of both after the places where
    they meet first, allow a link."""
    sized = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    most = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return sized & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))


def _near(percent: int) -> Column:
    """The bits in which two sketches differ are no more than the shingles in
    which linked sets of these sizes may differ: each such shingle turns one."""
    differ = sum((F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))) for i in range(SKETCH // 64)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for candidate pairs (a, b), on whole sets (id, low)."""
    left = sets.select(F.col("id").alias("a"), F.col("low").alias("low_a"))
    right = sets.select(F.col("id").alias("b"), F.col("low").alias("low_b"))
    both = F.size(F.array_intersect("low_a", "low_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select(
        "a", "b", (100 * both >= percent * (F.size("low_a") + F.size("low_b") - both)).alias("linked"))


def _whole_sets(ids: DataFrame, base: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, n, low) with all shingles, for some ids (distinct, with repeats)."""
    ids = materialise(ids.select("id").distinct())
    few = ids.count() <= BROADCAST_IDS  # ids alone, so the size is known; else texts are shuffled by id
    some = base.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = materialise(_sets(some, n, percent, whole=True).select("id", "n", "low", "bits"))
    drop_copy(ids)
    return sets


def _pairs(listed: DataFrame, percent: int, other: Column) -> DataFrame:
    """Distinct candidates (a, b) that meet in a list and may link."""
    side = lambda s: listed.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "light", "pos", "label", "bits")])
    return (side("a").join(side("b"), "key").where("id_a < id_b").where(other).where("NOT (light_a AND light_b)")
            .where(_possible(percent) & _near(percent)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())


def _of_several_labels(listed: DataFrame) -> DataFrame:
    """The keys whose lists hold sets of more than one label."""
    return listed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")


def _links(reps: DataFrame, base: DataFrame, n: int, percent: int, every: bool) -> DataFrame:
    """Verified links (a, b) between classes: all of them on ``every``, else
    enough that classes are connected just as by all. The copy ``reps`` is
    deleted on the way."""
    listed = _keys(reps.withColumn("label", F.col("id")), percent, region(percent), heads=not every)
    drop_copy(reps)
    if every:
        both = listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        sets = _whole_sets(listed.join(both, "key"), base, n, percent)
        met = listed.join(sets.select("id", "bits"), "id").withColumn("label", F.col("id"))
        pairs = materialise(_pairs(met, percent, F.lit(True)))
        drop_copy(listed)
        return _verified(pairs, sets, percent).where("linked").select("a", "b")

    # first each member of a list with the head of the list, the set with the
    # least of its own: in a group of copies that is the one next to all others
    heads = listed.groupBy("key").agg(F.min(F.struct("own", "id", "n", "pos")).alias("head"), F.count("*").alias("size"))
    single, listed = listed, materialise(listed.join(heads.where("size > 1"), "key"))
    drop_copy(single)
    star = (listed.where("id <> head.id").select(
        F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b"), F.col("n").alias("n_a"),
        F.col("head.n").alias("n_b"), F.col("pos").alias("pos_a"), F.col("head.pos").alias("pos_b"))
        .where(_possible(percent)).select("a", "b").distinct())
    star = materialise(star)
    sets = _whole_sets(star.select(F.explode(F.array("a", "b")).alias("id")), base, n, percent)
    tested = materialise(_verified(star, sets, percent))
    drop_copy(star, sets)
    links = tested.where("linked").select("a", "b")
    component = connected_components(links)
    label = component.withColumnRenamed("component", "label")

    # then the sets of lists that are not connected yet, among themselves: they
    # are few, so that all their shingles can be counted and the order is exact
    labelled = listed.select("key", "id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    whole = _whole_sets(labelled.join(_of_several_labels(labelled), "key"), base, n, percent)
    left = materialise(whole.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
    drop_copy(listed, whole, component)
    keys = _keys(left, percent, 2**63 - 1, heads=False)
    again = materialise(keys.join(left.select("id", "label", "bits"), "id"))
    drop_copy(keys)
    rest = _pairs(again.join(_of_several_labels(again), "key"), percent, F.col("label_a") != F.col("label_b"))
    rest = materialise(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    drop_copy(again)
    found = materialise(links.unionByName(_verified(rest, left, percent).where("linked").select("a", "b")))
    drop_copy(tested, rest, left)
    return found


# ---- the operator -------------------------------------------------------

def _classes(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members (id, n, rep), class representatives with their search sets,
    texts of the rows that have an id). The first two are copies."""
    base = id_and_text(df, id_col, text_col)
    sets = materialise(_sets(base, n, percent, whole=False))
    rep = sets.groupBy("sig").agg(F.min("id").alias("rep"))
    members = materialise(sets.select("id", "n", "sig").join(rep, "sig").select(
        "id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep")))
    chosen = rep.where("rep IS NOT NULL").select(F.col("rep").alias("id"), "sig")
    reps = materialise(sets.where("n > 0").join(chosen, ["id", "sig"], "left_semi").select("id", "n", "low"))
    drop_copy(sets)
    return members, reps, base.where("id IS NOT NULL")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                       percent: int = PERCENT) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` (set size), ``component_id``
    (the smallest id that links lead to, itself included) and ``class_id`` (the
    smallest id with the same set).

    Two sets link when 100 * intersection >= ``percent`` * union. A null, empty
    or blank text has an empty set, which links with nothing, not even another
    empty one. A null id joins no search: its component is that of an equal set
    with an id, else null. Rows that repeat (same id and text) are one document;
    an id must not stand for different texts. An empty table gives an empty result; other columns are
    ignored. Sets are of 63-bit hashes."""
    members, reps, base = _classes(df, id_col, text_col, n, percent)
    links = _links(reps, base, n, percent, every=False)
    label = connected_components(links).withColumnRenamed("id", "rep")
    drop_copy(links)
    return members.join(label, "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("class_id"))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                  percent: int = PERCENT) -> DataFrame:
    """The join itself: every link (a, b), a < b, between class representatives."""
    members, reps, base = _classes(df, id_col, text_col, n, percent)
    drop_copy(members)
    return _links(reps, base, n, percent, every=True)
