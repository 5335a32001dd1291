"""Byte-level BPE encoding and decoding by a rank file.

A text is split by the vocabulary's pattern and every match is encoded on its
own: a match that is a token as a whole is that token; in any other the live pair
of least rank, the leftmost of equals, is merged again and again.  A segment tree
over the byte positions holds rank and position of each live pair, so its root
names the next merge, and a merge changes three leaves on paths of logarithmic
length.  Short matches that were not seen before go through their trees together,
a step of all trees at a time (a row of one matrix is one tree); a long one has a
tree of its own.  Matches seen before come from a bounded table."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import id_and_text, map_texts, on_workers, pieces, texts

#: Matches of at most this many bytes go through their trees together and are
#: remembered, so many of them at once (and as many older ones).
SHORT, REMEMBERED = 64, 1 << 18
#: Entries below one node of the segment tree.
WIDE = 16
#: Characters of text whose matches are held at once, and matches of a longer text.
GROUP, STEP = 1 << 20, 1 << 16

# How rank files of this kind split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one match that is no token as a whole."""
    n, get = len(piece), ranks.get
    bits = n.bit_length()
    none = 1 << 40 + bits  # beyond every rank
    place = (1 << bits) - 1
    leaves = []
    for at in range(n - 1):
        rank = get(piece[at: at + 2])
        leaves.append(none if rank is None else rank << bits | at)
    levels = [leaves]  # of the tree; each entry is the least of WIDE entries below
    while len(levels[-1]) > WIDE:
        below = levels[-1]
        levels.append([min(below[k: k + WIDE]) for k in range(0, len(below), WIDE)])
    top = levels[-1]
    after = list(range(1, n + 2))  # of a live position; n ends the piece
    before = list(range(-1, n))

    def put(at: int, value: int) -> None:
        leaves[at] = value
        for below, level in zip(levels, levels[1:]):
            start = at // WIDE * WIDE
            at //= WIDE
            value = min(below[start: start + WIDE])
            if level[at] == value:
                return
            level[at] = value

    while top and (least := min(top)) != none:
        at = least & place
        gone = after[at]
        end = after[at] = after[gone]
        before[end] = at
        if gone < n - 1:
            put(gone, none)
        rank = get(piece[at: after[end]]) if end < n and after[end] - at <= longest else None
        put(at, none if rank is None else rank << bits | at)
        if (start := before[at]) >= 0:
            rank = get(piece[start:end]) if end - start <= longest else None
            put(start, none if rank is None else rank << bits | start)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at: after[at]]])
        at = after[at]
    return ids


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> id of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class _Ranks:
    """A vocabulary with its pairs: which two tokens make which one together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks), default=0)
        self.bits = max(ranks.values(), default=0).bit_length()
        self.none = 1 << (self.bits + SHORT.bit_length())  # beyond every (rank, position)
        self.of_byte = np.array([ranks.get(bytes([c]), 0) for c in range(256)], np.int64)
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << self.bits | right] = rank
        self.pairs = np.array(sorted(found), np.int64)
        self.made = np.array([found[x] for x in self.pairs.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two tokens make, -1 if none."""
        if not len(self.pairs):
            return np.full(left.shape, -1, np.int64)
        key = left << self.bits | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)


def merged_together(pieces: list[bytes], vocabulary: _Ranks, size: int) -> list[bytes]:
    """The packed ids of matches of up to ``size`` bytes (a power of two) that are
    no tokens as a whole. Row r of ``tree`` is the segment tree of match r: its
    root at 1, the leaf of byte position p at ``size + p``."""
    m, shift, none = len(pieces), size.bit_length() - 1, vocabulary.none
    n = np.array([len(x) for x in pieces])
    raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(m, size)
    ids = vocabulary.of_byte[raw]
    after = np.broadcast_to(np.arange(1, size + 2), (m, size + 1)).copy()  # of a live position; n ends the match
    before = np.broadcast_to(np.arange(-1, size), (m, size + 1)).copy()
    live = np.arange(size)[None] < n[:, None]

    def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank < 0, none, rank << shift | at)

    tree = np.full((m, 2 * size), none, np.int64)
    tree[:, size: 2 * size - 1] = np.where(live[:, 1:], leaf(vocabulary.rank(ids[:, :-1], ids[:, 1:]), np.arange(size - 1)[None]), none)
    width = size // 2
    while width:
        tree[:, width: 2 * width] = np.minimum(tree[:, 2 * width: 4 * width: 2], tree[:, 2 * width + 1: 4 * width: 2])
        width //= 2

    def put(row: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        node = at + size
        tree[row, node] = value
        for _ in range(shift):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    row = np.flatnonzero(tree[:, 1] < none)
    while len(row):
        least = tree[row, 1]
        at = least & size - 1
        gone = after[row, at]
        end = after[row, gone]
        after[row, at], before[row, end] = end, at
        ids[row, at], live[row, gone] = least >> shift, False
        put(row, gone, none)
        inner = end < n[row]
        right = np.where(inner, vocabulary.rank(ids[row, at], ids[row, np.minimum(end, size - 1)]), -1)
        put(row, at, leaf(right, at))
        some = before[row, at] >= 0
        r, a = row[some], at[some]
        start = before[r, a]
        put(r, start, leaf(vocabulary.rank(ids[r, start], ids[r, a]), start))
        row = row[tree[row, 1] < none]
    packed, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class _Packed:
    """Match -> its ids as little-endian unsigned 32-bit integers, remembered in
    two generations: when the new one is full, it becomes the old one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = _Ranks(ranks)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, matches: set[str]) -> dict[str, bytes]:
        """A table that has all of ``matches``."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        new, old, ranks = self.new, self.old, self.vocabulary.ranks
        longer, unknown = {}, {}
        for match in matches.difference(new):
            if (ids := old.get(match)) is not None:
                new[match] = ids
                continue
            piece = match.encode()
            rank = ranks.get(piece)
            if rank is not None:
                new[match] = pack("<I", rank)
            elif len(piece) > SHORT:
                ids = merged(piece, ranks, self.vocabulary.longest)
                longer[match] = np.array(ids, "<u4").tobytes()
            else:
                unknown.setdefault(1 << (len(piece) - 1).bit_length(), []).append((match, piece))
        for size, some in unknown.items():
            for k in range(0, len(some), 4096):
                part = some[k: k + 4096]
                new.update(zip([x for x, _ in part], merged_together([x for _, x in part], self.vocabulary, max(size, 2))))
        return {**new, **longer} if longer else new


@lru_cache(maxsize=4)
def _known(path: str) -> _Packed:
    """One table for all tasks of a worker."""
    return _Packed(read_ranks(path))


def _joined(found: list[list[str]], known: _Packed) -> list[bytes]:
    table = known.learn(set().union(*found))
    return [b"".join(map(table.__getitem__, x)) for x in found]


def packed_ids(texts: list[str], split: regex.Pattern, known: _Packed) -> list[bytes]:
    """The ids of whole texts, packed."""
    out: list[bytes] = []
    group, held = [], 0
    for text in texts:
        if held + len(text) > GROUP:
            out += _joined(group, known)
            group, held = [], 0
        if len(text) <= GROUP:
            group.append(split.findall(text))
            held += len(text)
        else:
            matches, parts = split.finditer(text), []
            while step := [m.group() for m in islice(matches, STEP)]:
                parts += _joined([step], known)
            out.append(b"".join(parts))
    return out + _joined(group, known)


def encode_packed(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
                  pattern: str = PATTERN) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, and ``ids`` as one binary of
    little-endian unsigned 32-bit integers, the form of token files.

    Whole texts, of any length; a null text is empty and gives no ids. Rows that
    repeat, null ids and ids that several rows share stay as they are; other
    columns are ignored, an empty table gives an empty result. ``ranks_path`` is
    read where the tasks run, so it must be there on every worker. Every single
    byte must be in the file, else a text that needs the byte fails."""

    def make():
        split, known = regex.compile(pattern), _known(ranks_path)

        def work(batch):
            ids = packed_ids(texts(batch), split, known)
            return None, [[len(x) // 4 for x in ids], ids]

        return work

    base = id_and_text(df, id_col, text_col)
    return map_texts(base, "n_tokens long, ids binary", make).withColumnRenamed("id", id_col)


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """As ``encode_packed``, with ``ids`` as an array of integers."""
    packed = encode_packed(df, ranks_path, id_col, text_col, pattern)
    schema = to_arrow_schema(kind := T.StructType([packed.schema[id_col], packed.schema["n_tokens"], T.StructField("ids", T.ArrayType(T.LongType()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids"):
            lists = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(2).to_pylist()], schema.field(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), batch.column(1), lists], schema=schema)

    on_workers(df.sparkSession)
    return packed.mapInArrow(run, kind)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id and ``decoded``, the bytes of its tokens one
    after another (a cut sequence need not be valid UTF-8).

    Ids come packed or as an array; null is empty. An id that the file doesn't
    have is an error. Other columns are ignored."""
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    listed = not isinstance(base.schema["ids"].dataType, T.BinaryType)
    schema = to_arrow_schema(kind := T.StructType([base.schema["id"], T.StructField("decoded", T.BinaryType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: t for t, rank in read_ranks(ranks_path).items()}.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that decoded bytes never pile up
                part = batch.slice(at, 256)
                ids = part.column(1).to_pylist()
                ids = [x or [] for x in ids] if listed else [np.frombuffer(x or b"", "<u4").tolist() for x in ids]
                out = pa.array([b"".join(map(token, x)) for x in ids], schema.field(1).type)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field(0).type), out], schema=schema)

    on_workers(df.sparkSession)
    return base.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
                       pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): SHA-256 in lower-case hex of
    the packed ids and of the bytes they decode to, for each row."""
    encoded = encode_packed(df, ranks_path, id_col, text_col, pattern)
    # the digest of the ids rides along with the id through the decoder
    known = encoded.select(F.struct(F.col(f"`{id_col}`").alias("id"), "n_tokens", F.sha2("ids", 256).alias("sha")).alias("row"), "ids")
    return decode(known, ranks_path, "row").select(
        F.col("row.id").alias(id_col), F.col("row.n_tokens").alias("n_tokens"), F.col("row.sha").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
