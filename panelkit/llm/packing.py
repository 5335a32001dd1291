"""Best-fit packing of tokenised documents by length patterns.

Documents become pieces of at most ``size`` tokens.  Everything that decides
the packing is the histogram of piece lengths (at most ``size`` numbers, however
many documents there are): patterns of few length classes that fill a sequence
are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares, rounded, and laid out with exact lengths; what is left goes by
best fit into the gaps.  The result is a short table of layouts, which the
pieces join by length and by their rank among the pieces of that length."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from functools import cache
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_and_text, map_texts, materialise, texts

#: Words whose ids one Python worker remembers; then it starts anew.
MEMO_WORDS = 600_000
#: Marks that may follow a word without joining it.
MARKS = b".,;:!?*#$%&()\"-"
#: Length classes per sequence, and the most documents in a pattern.
CLASSES, PARTS = 64, 3


# ---- tokens -------------------------------------------------------------

def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordIds(dict):
    """Ids (little-endian uint32 bytes) by word, for a tokenizer that lowers
    case, drops white space and never joins across it: the ids of a text are
    those of its words in order. Plain words go to the BPE model directly, and
    all others through the whole tokenizer; both are remembered."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            ids = self._plain(word.lower().decode())
        elif (stem := word.rstrip(MARKS)) and self._is_plain(stem):
            if stem != word:  # letters, then marks: the tokenizer cuts between them
                ids = self[stem] + self[word[len(stem):]]
            else:
                ids = self._plain("".join([self.letters[b] for b in word.decode().lower().encode()]))
        else:
            ids = pack_ids(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        self[word] = ids
        return ids

    @staticmethod
    def _is_plain(word: bytes) -> bool:
        """Latin letters only, composed, each of which has one lower-case letter."""
        if word.isalpha():
            return True
        text = word.decode()
        return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text and is_normalized("NFC", text)

    def _plain(self, letters: str) -> bytes:
        return pack_ids([t.id for t in self.model.tokenize(letters)])

    def of(self, text: str) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        data = text.encode()
        if b"<|" not in data:  # no special token, whose case counts
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))  # ASCII white space


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def word_ids(path: str) -> WordIds:
    """One memo per worker process, shared by its tasks."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


def tokenized_pieces(df: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                     text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids of every document, with the end id last."""
    base = id_and_text(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())

    def make():
        ids, end = word_ids(tokenizer_path), np.uint32(end_id).astype("<u4").tobytes()

        def work(batch):
            rows, out = [], [[] for _ in range(4 + keep_ids)]
            for row, text in enumerate(texts(batch)):
                data = ids.of(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at: at + 4 * size]
                    values = [piece, at // 4, len(part) // 4, zlib.crc32(part)]
                    if keep_ids:
                        values.append(np.frombuffer(part, "<i4"))
                    rows.append(row)
                    for column, value in zip(out, values):
                        column.append(value)
            return rows, out

        return work

    added = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_texts(base, added, make, keep=("id", "row"))


# ---- patterns -----------------------------------------------------------

def patterns(classes: int, parts: int) -> np.ndarray:
    """All multisets of at most ``parts`` class sizes 1..classes that sum to
    ``classes``, as count vectors."""
    found: list[list[int]] = []

    def grow(rest: int, most: int, chosen: list[int]) -> None:
        if rest == 0:
            found.append(chosen)
        elif len(chosen) < parts:
            for c in range(min(rest, most), 0, -1):
                if c * (parts - len(chosen)) < rest:
                    break
                grow(rest - c, c, [*chosen, c])

    grow(classes, classes, [])
    out = np.zeros((len(found), classes + 1))
    for row, p in zip(out, found):
        for c in p:
            row[c] += 1
    return out[:, 1:]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that makes ``a @ x`` nearest to ``b`` (active set)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        if gradient.max(initial=-np.inf) <= tol:
            break
        active[int(gradient.argmax())] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (z <= 0)
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            active &= x > tol
            x[~active] = 0
    return x


class _Layouts:
    """Groups of equal sequences under construction: (free, lengths, count)."""

    def __init__(self, size: int):
        self.size = size
        self.open: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by free tokens
        self.free: list[int] = []

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        free = self.size - sum(lengths)
        if not self.open[free]:
            insort(self.free, free)
        self.open[free].append((lengths, count))

    def take(self, length: int) -> tuple[tuple[int, ...], int] | None:
        """A group with the least free space that fits, taken out."""
        k = bisect_left(self.free, length)
        if k == len(self.free):
            return None
        free = self.free[k]
        group = self.open[free].pop()
        if not self.open[free]:
            self.free.pop(k)
        return group

    def groups(self) -> list[tuple[tuple[int, ...], int]]:
        return [g for free in sorted(self.open) for g in self.open[free]]


def layouts(histogram: dict[int, int], size: int, classes: int = CLASSES,
            parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) for a histogram of
    piece lengths. Every piece is used exactly once."""
    left = {n: c for n, c in histogram.items() if c}
    packed = _Layouts(size)
    if size in left:  # full pieces are sequences of their own
        packed.add((size,), left.pop(size))
    unit = -(-size // classes)
    by_class: dict[int, list[int]] = defaultdict(list)  # lengths of a class, the longest first
    for n in sorted(left, reverse=True):
        by_class[-(-n // unit)].append(n)
    if left:
        have = np.array([sum(left[n] for n in by_class[c]) for c in range(1, classes + 1)], float)
        shape = patterns(classes, parts)
        repeats = np.rint(nnls(shape.T, have)).astype(int)
        remaining = sorted(left)  # lengths, some of which may be used up

        def longest_within(room: int, chosen: list[int]) -> int | None:
            """The longest piece that is left and fits."""
            k = bisect_right(remaining, room)
            while k:
                k -= 1
                if left[remaining[k]] > chosen.count(remaining[k]):
                    return remaining[k]
                if not left[remaining[k]]:
                    remaining.pop(k)
            return None

        # patterns with the longest members first, so that short pieces are left for the gaps
        for k in sorted(range(len(shape)), key=lambda k: -np.flatnonzero(shape[k])[-1]):
            members = [c + 1 for c in np.flatnonzero(shape[k])[::-1] for _ in range(int(shape[k][c]))]
            want = int(repeats[k])
            while want > 0:
                chosen: list[int] = []
                for c in members[:-1]:
                    pick = next((n for n in by_class[c] if left[n] > chosen.count(n)), None)
                    if pick is None:
                        break
                    chosen.append(pick)
                # classes round lengths up, so the last member takes the exact room that is left
                last = longest_within(size - sum(chosen), chosen) if len(chosen) == len(members) - 1 else None
                if last is None:
                    break
                chosen.append(last)
                times = min([want, *(left[n] // chosen.count(n) for n in set(chosen))])
                for n in set(chosen):
                    left[n] -= times * chosen.count(n)
                packed.add(tuple(chosen), times)
                want -= times
    for n in sorted((n for n in left if left[n]), reverse=True):  # residuals: longest first, best fit
        count = left[n]
        while count:
            group = packed.take(n)
            lengths, there = group or ((), -(-count // (size // n)))
            if group is None:  # as many of the same length as a new sequence holds
                each = min(size // n, count)
                there = count // each
                packed.add((n,) * each, there)
                count -= there * each
                continue
            fits = (size - sum(lengths)) // n
            each = min(fits, count)
            used = min(there, count // each)
            packed.add(lengths + (n,) * each, used)
            if there > used:
                packed.add(lengths, there - used)
            count -= used * each
    return packed.groups()


def layout_rows(groups: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, offset): pieces of
    that length and those ranks take consecutive sequences at that offset."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in groups:
        at = 0
        for n in lengths:
            rows.append((n, rank[n], count, sequence, at))
            rank[n] += count
            at += n
        sequence += count
    return rows


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces that has
    ``length`` and the order columns ``id``, ``row``, ``piece``.

    The ranks are dealt in two steps (counts per length and bucket, then the
    position in the bucket), so that one length may hold most pieces."""
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int"))
    counts = materialise(dealt.groupBy("length", "bucket").count())
    # bounded by the sequence size: one number per possible length
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = spark.createDataFrame(layout_rows(layouts(histogram, size)) or [(0, 0, 0, 0, 0)],
                                 "length long, first long, many long, sequence long, offset long")
    before = F.coalesce(F.sum("count").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "bucket", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece")) - 1
    ranked = (dealt.withColumn("place", place).join(starts, ["length", "bucket"])
              .withColumn("rank", F.col("before") + F.col("place")).drop("bucket", "place", "before"))
    # the layouts of a length tile its ranks: look the right one up in its sorted array
    by_length = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "many", "sequence", "offset"))).alias("runs"))
    hit = F.filter("runs", lambda r: (F.col("rank") >= r["first"]) & (F.col("rank") < r["first"] + r["many"]))[0]
    return (ranked.join(F.broadcast(by_length), "length").withColumn("hit", hit)
            .withColumn("sequence_id", F.col("hit.sequence") + F.col("rank") - F.col("hit.first"))
            .withColumn("offset", F.col("hit.offset")).drop("runs", "hit", "rank"))


def pack_documents(df: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise every whole text, cut what is longer than ``size`` and pack all
    pieces into as few sequences as the method finds.

    One row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` (and ``ids`` on ``keep_ids``). A null or empty
    text is one piece that holds the end id alone. Null ids and repeated rows
    are pieces like others; equal lengths take sequences in any order. An empty
    table gives an empty result; other columns are ignored."""
    made = materialise(tokenized_pieces(df, tokenizer_path, size, end_id, id_col, text_col, keep_ids))
    packed = pack(made, size)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                         *["ids"] * keep_ids)
