"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows.  If a stretch of a document
is within ``k`` edits of a window of ``w`` characters, they share at least
``w + 1 - q * (k + 1)`` q-grams, all within a diagonal band of width ``2k + 1``
or so.  Shared q-grams are counted in overlapping bands, regions that meet the
bound are kept, and banded alignment decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, map_texts, materialise, texts

#: Characters of a window, distance of window starts, length of a q-gram, and
#: edits allowed per character.
WINDOW, STRIDE, Q, ERRORS = 80, 20, 8, 0.075
#: Characters of benchmark text in one block. Its index, which the driver builds and
#: every worker holds, takes about 60 bytes for each, and some 200 while it is built.
BLOCK_CHARS = 1 << 20
#: Bits of the table that tells quickly whether a q-gram occurs in the block.
FILTER_BITS = 22


def fold(text: str) -> str:
    """Lower case, with every run of white space as one blank."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling (``Q`` is a power of two)."""
    key, size = code.astype(np.uint64), 1
    while size < Q:
        key = (key[:-size] * np.uint64(0x9E3779B97F4A7C15)) ^ key[size:] if len(key) > size else key[:0]
        key *= np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
        size *= 2
    return key


def bound(w: int) -> tuple[int, int]:
    """Edits allowed in a window of ``w`` characters, and q-grams then shared."""
    k = int(ERRORS * w)
    while k and w + 1 - Q * (k + 1) < 4:
        k -= 1
    return k, max(1, w + 1 - Q * (k + 1))


@dataclass(frozen=True)
class Index:
    """Windows of a block of benchmark items and the places of their q-grams, in
    flat arrays of the smallest types that hold them."""

    items: np.ndarray  # item of each window
    code: np.ndarray  # the block's folded texts, one after another
    start: np.ndarray  # of each window in it
    size: np.ndarray
    edits: np.ndarray
    shared: np.ndarray
    key: np.ndarray  # sorted q-grams, with the window and the place there
    window: np.ndarray
    place: np.ndarray
    quick: np.ndarray
    least: int  # smallest bound of any window
    longest: int

    @property
    def windows(self) -> list[np.ndarray]:
        return [self.code[a: a + n] for a, n in zip(self.start, self.size)]


def build_index(items: list[tuple[object, str]]) -> Index | None:
    owner, starts, sizes, parts, total = [], [], [], [], 0
    for number, (_, text) in enumerate(items):
        code = codes(fold(text or ""))
        if len(code) < Q:
            continue
        last = max(0, len(code) - WINDOW)
        for start in sorted({*range(0, last, STRIDE), last}):
            owner.append(number)
            starts.append(total + start)
            sizes.append(min(WINDOW, len(code) - start))
        parts.append(code)
        total += len(code)
    if not parts:
        return None
    code, start, size = np.concatenate(parts), np.array(starts, np.int64), np.array(sizes, np.int64)
    many = size - Q + 1  # q-grams of a window: a stretch of those of the whole block
    window = np.repeat(np.arange(len(start), dtype=np.uint32), many)
    place = (np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint8)
    key = grams(code)[start[window] + place]
    order = np.argsort(key, kind="stable")
    quick = np.zeros(1 << FILTER_BITS, bool)
    quick[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    limits = np.array([bound(w) for w in range(WINDOW + 1)])[size]
    return Index(np.array(owner, np.int64), code, start, size, limits[:, 0], limits[:, 1], key[order], window[order], place[order], quick,
                 int(limits[:, 1].min()), int(size.max()))


def regions(code: np.ndarray, index: Index) -> np.ndarray:
    """Rows (window, first diagonal of the band) whose bands hold enough shared
    q-grams. No window within its edits of the text is missed."""
    key = grams(code)
    hit = index.quick[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    # the q-grams of a match lie within this stretch; too few hits in it rule it out
    reach = index.longest + int(ERRORS * index.longest)
    total = np.concatenate([[0], np.cumsum(hit)])
    starts = np.flatnonzero(hit)
    ends = np.minimum(starts + reach, len(hit))
    dense = starts[total[ends] - total[starts] >= index.least]
    if not len(dense):
        return np.zeros((0, 2), np.int64)
    cover = np.zeros(len(hit) + 1, np.int64)
    np.add.at(cover, dense, 1)
    np.add.at(cover, np.minimum(dense + reach, len(hit)), -1)
    at = np.flatnonzero(hit & (np.cumsum(cover[:-1]) > 0))
    low, high = np.searchsorted(index.key, key[at], "left"), np.searchsorted(index.key, key[at], "right")
    many = high - low
    at = np.repeat(at, many)
    entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    window = index.window[entry].astype(np.int64)
    diagonal = at - index.place[entry].astype(np.int64) + index.longest  # never negative
    step = 2 * index.edits[window] + 1  # each diagonal is in two bands of twice this width
    band = diagonal // step
    width = len(code) + 2 * index.longest + 2
    both = np.concatenate([window * width + band, (window * width + band - 1)[band > 0]])
    found, n = np.unique(both, return_counts=True)
    keep = n >= index.shared[found // width]
    window, band = found[keep] // width, found[keep] % width
    return np.stack([window, band * (2 * index.edits[window] + 1) - index.longest], 1)


def align(code: np.ndarray, index: Index, found: np.ndarray) -> np.ndarray:
    """For each region the least edits of its window and the end of that
    alignment in the text: rows (edits, end). All regions go together; the
    cells of a row are the diagonals of the band and its margins."""
    window, first = found[:, 0], found[:, 1]
    k = index.edits[window]
    most = int(k.max())
    lo = first - k  # diagonals lo .. lo + cells
    cells = 6 * most + 3
    size, column = index.size[window], np.arange(int(index.size[window].max()))
    inner = column[None] < size[:, None]
    pattern = np.where(inner, index.code[np.where(inner, index.start[window][:, None] + column, 0)], 0)
    far = 1 << 20
    text = np.concatenate([code, [np.uint32(0xFFFFFFFF)]])
    column = np.arange(cells)
    place = lo[:, None] + column  # text characters before the cell
    cost = np.where((place >= 0) & (place <= len(code)), 0, far)
    best = np.full(len(found), far)
    end = np.zeros(len(found), np.int64)
    for i in range(pattern.shape[1]):
        j = place + i  # text index matched by pattern character i on this diagonal
        inside = (j >= 0) & (j < len(code))
        same = text[np.where(inside, j, len(code))] == pattern[:, i: i + 1]
        new = np.where(inside, cost + ~same, far)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a pattern character is missing in the text
        inside_next = (j + 1 >= 0) & (j + 1 <= len(code))
        new = np.where(inside_next, new, far)
        new = np.minimum.accumulate(new - column, axis=1) + column  # text characters are extra
        cost = np.where(inside_next, new, far)
        last = size == i + 1
        if last.any():
            at = cost[last].argmin(axis=1)
            best[last] = cost[last][np.arange(len(at)), at]
            end[last] = (j[last] + 1)[np.arange(len(at)), at]
    return np.stack([best, end], 1)


def matches(text: str, index: Index) -> dict[int, tuple[int, int, int]]:
    """Item number -> (windows found, least edits, end of that one in the folded text)."""
    code = codes(fold(text))
    found = regions(code, index)
    out: dict[int, tuple[int, int, int]] = {}
    seen: dict[int, set] = {}
    for at in range(0, len(found), 4096):
        part = found[at: at + 4096]
        for (window, _), (edits, end) in zip(part, align(code, index, part)):
            if edits <= index.edits[window]:
                item = int(index.items[window])
                seen.setdefault(item, set()).add(int(window))
                _, least, place = out.get(item, (0, 1 << 20, 0))
                out[item] = (len(seen[item]), *min((least, place), (int(edits), int(end))))
    return out


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item of which a window (80 characters
    each 20; a shorter item whole) stands in the document within 7.5 % edits,
    in lower case with white space folded: the id, the item's id, ``n_windows``,
    ``edits`` (of the best window) and ``match_end`` (its end in the folded text).

    Null or empty texts and items match nothing, nor do items under 8
    characters; a null id passes as it is, repeated rows give repeated results;
    an empty table on either side gives an empty result; other columns are
    ignored. The benchmark is read to the driver in blocks of about a million
    characters, each of which is one pass over the documents; where there are
    several, a pass is written before the next block is read. The two id columns
    need different names."""
    if id_col.lower() == item_col.lower():
        raise ValueError(f"both ids are called {id_col}")
    kind = benchmark.schema[item_col].dataType.simpleString()
    out = None
    for block, only in _blocks(benchmark, item_col, item_text_col):
        part, index = _one_block(df, block, id_col, text_col, kind, item_col)
        if not only:
            part = materialise(part)
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return _one_block(df.limit(0), [], id_col, text_col, kind, item_col)[0] if out is None else out


def decontaminate(df: DataFrame, benchmark: DataFrame, item_text_col: str = "text") -> DataFrame:
    """The rows of a table with a ``text`` column in which no window of any
    benchmark item stands (see ``contamination``). All columns stay; there is
    no join and no shuffle. Null and empty texts are clean. With several blocks,
    what one leaves is written before the next."""
    for block, only in _blocks(benchmark, item_text_col, item_text_col):
        df, index = _clean(df, block)
        if not only:
            df = materialise(df)
            index.destroy()
    return df


def _clean(df: DataFrame, block: list):
    index = df.sparkSession.sparkContext.broadcast(build_index(block))

    def make():
        built = index.value

        def work(batch):
            return [i for i, t in enumerate(texts(batch)) if not (t and built and matches(t, built))], []

        return work

    return map_texts(df, "", make, keep=tuple(df.columns)), index


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Lists of (item, text) of at most ``BLOCK_CHARS`` characters (a longer
    item is a block of its own), and whether it is the only one; one block is on
    the driver at a time."""
    block, size, only = [], 0, True
    for r in benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").orderBy("item", "text").toLocalIterator():
        if block and size + len(r[1]) > BLOCK_CHARS:
            only = False
            yield block, only
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block, only


def _one_block(df: DataFrame, block: list, id_col: str, text_col: str, item_type: str, item_col: str):
    index = df.sparkSession.sparkContext.broadcast((build_index(block), [i for i, _ in block]))

    def make():
        built, names = index.value

        def work(batch):
            rows, out = [], [[], [], [], []]
            for row, text in enumerate(texts(batch) if built else []):
                for item, values in sorted(matches(text, built).items()):
                    rows.append(row)
                    for column, value in zip(out, (names[item], *values)):
                        column.append(value)
            return rows, out

        return work

    added = f"item {item_type}, n_windows long, edits long, match_end long"
    found = map_texts(id_and_text(df, id_col, text_col), added, make)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "edits", "match_end"), index
