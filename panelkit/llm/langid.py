"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-proximal,
elastic-net penalties), then temperature calibration.

Document frequencies count every training text, in the tasks; the classifier
itself is fitted on a bounded sample, drawn by a hash of the id."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, map_texts, texts

#: Hashed features, and the lengths of the character n-grams.
BITS, ORDERS = 14, (1, 2, 3)
DIM = 1 << BITS
#: Most training texts per language and in all (in expectation), and per language
#: however many there are; what a language has less is for the others.
SAMPLE, SAMPLE_ALL, LEAST = 1500, 8000, 20
#: Code points of a text that one step looks at; longer texts take more steps.
STEP = 1 << 20


#: Odd multipliers of the n-gram hash, one per place.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: By code point up to U+00FF: the letter, or a blank for whatever is none.
LATIN = np.array([c if chr(c).isalpha() else 32 for c in range(256)], np.uint32)


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole lower-case text. ASCII and
    Latin-1 characters that are no letters are blanks, so that digits and marks
    carry no language."""
    low = f" {text.lower()} "
    out = np.zeros(DIM, np.int64)
    for at in range(0, len(low), STEP):
        start = max(0, at - max(ORDERS) + 1)  # n-grams that end in this step
        code = np.frombuffer(low[start: at + STEP].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code < 256, LATIN[np.minimum(code, 255)], code)
        found, key = [], np.zeros(len(code), np.uint32)
        for n in ORDERS:  # the hash of n characters is made from that of the first n - 1
            if len(code) < n:
                break
            key = (key[: len(code) - n + 1] ^ code[n - 1:]) * MIX[n - 1]
            key ^= key >> np.uint32(15)
            found.append(key[max(0, at - start - n + 1):])
        index = (np.concatenate(found) * MIX[0]) >> np.uint32(32 - BITS)
        out += np.bincount(index, minlength=DIM)
    return out


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and L2-normed values (1 + log tf) * idf of one text."""
    tf = counts(text)
    at = np.flatnonzero(tf)
    value = (1 + np.log(tf[at])) * idf[at]
    norm = math.sqrt(float(value @ value))
    return at, value / norm if norm else value


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # (features + 1, langs); the last row is the bias
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0
        at, value = features(text, self.idf)
        z = (value @ self.weights[at] + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())  # the first of equals
        return self.langs[best], float(p[best] / p.sum())


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, per feature, of texts that hold it, over all rows."""

    def make():
        def work(batch):
            df, n = np.zeros(DIM, np.int64), 0
            for text in texts(batch):
                df += counts(text) > 0
                n += 1
            at = np.flatnonzero(df)
            return np.zeros(len(at) + 1), [np.append(at, -1), np.append(df[at], n)]

        return work

    # one row per feature whatever the number of texts
    rows = (map_texts(train, "feature int, n long", make).groupBy("feature").agg(F.sum("n").alias("n")).collect())
    out, n = np.zeros(DIM), 0
    for r in rows:
        if r["feature"] < 0:
            n = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return n, out


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int, epochs: int = 3, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, seed: int = 7) -> np.ndarray:
    """FTRL-proximal for the softmax loss with elastic-net penalties."""
    z, q = np.zeros((DIM + 1, n_langs)), np.zeros((DIM + 1, n_langs))
    rng = np.random.default_rng(seed)

    def solved(z: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(q)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            at, value = x[i]
            at, value = np.append(at.astype(np.int64), DIM), np.append(value.astype(float), 1.0)
            w = solved(z[at], q[at])
            p = value @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = value[:, None] * p
            new = q[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(q[at])) / alpha * w
            q[at] = new
    return solved(z, q)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that makes held-out log-likelihood largest
    (golden section over its logarithm)."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / math.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, ratio = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def texts_each(sizes: list[int], sample: int) -> int:
    """Texts per language: as many as ``SAMPLE_ALL`` holds when languages with
    fewer give all they have, at most ``sample`` and at least ``LEAST``."""
    left, each = SAMPLE_ALL, sample
    for k, n in enumerate(sorted(sizes)):
        each = left // (len(sizes) - k)
        if n >= each:
            break
        left -= n
    else:
        each = sample  # all of them fit
    return max(LEAST, min(sample, each))


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit a model on rows (id, text, lang) without nulls in text and lang, of
    every language there is. The sample holds ``sample`` texts per language in
    expectation, fewer of many languages; one in five of it calibrates, but no
    language's only texts; fewer than ``LEAST`` texts of a language are repeated
    to as many in the fit. No rows give a model that answers ``und``."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros(DIM), np.zeros((DIM + 1, 0)), 1.0)
    n, df = document_frequencies(rows.select("id", "text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = texts_each(list(sizes.values()), sample)
    # one row per language
    share = rows.sparkSession.createDataFrame([(k, min(1.0, sample / sizes[k])) for k in langs], "lang string, share double")
    u = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(share), "lang").where(u < F.col("share"))

    def make():
        def work(batch):
            at, values = zip(*(features(t, idf) for t in texts(batch)))
            return None, [[a.astype(np.uint16).tobytes() for a in at], [v.astype(np.float32).tobytes() for v in values]]

        return work

    made = map_texts(chosen, "at binary, value binary", make, keep=("id", "lang"))
    # bounded by the sample; sorted, so that the fit does not depend on the partitions
    got = sorted(((str(r["id"]), r["lang"], r["at"], r["value"]) for r in made.collect()), key=lambda r: r[:2])
    x = [(np.frombuffer(r[2], np.uint16), np.frombuffer(r[3], np.float32)) for r in got]
    place = {k: i for i, k in enumerate(langs)}
    y = np.array([place[r[1]] for r in got])
    held = np.arange(len(x)) % 5 == 4
    held &= np.isin(y, y[~held])
    fit = np.flatnonzero(~held)
    # the few texts of a rare language are shown several times
    few = -(-LEAST // np.bincount(y[fit], minlength=len(langs)).clip(1, LEAST))
    fit = np.repeat(fit, few[y[fit]])
    weights = ftrl([x[i] for i in fit], y[fit], len(langs))
    scores = np.array([x[i][1] @ weights[x[i][0]] + weights[-1] for i in np.flatnonzero(held)]).reshape(-1, len(langs))
    return Model(langs, idf, weights.astype(np.float32), temperature(scores, y[held]))


def is_held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``lang_pred`` and ``score`` of every row's whole text."""

    def make():
        def work(batch):
            return None, list(zip(*(model.predict(t) for t in texts(batch))))

        return work

    found = map_texts(id_and_text(df, id_col, text_col), "lang_pred string, score double", make)
    return found.select(F.col("id").alias(id_col), "lang_pred", "score")


def fold_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, text, lang) to learn from: outside the held-out fold, with a
    text and a language."""
    labelled = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                         F.col(f"`{lang_col}`").alias("lang"))
    return labelled.where(~is_held_out(F.col("id"))).where("text IS NOT NULL AND lang IS NOT NULL")


def keep_identified(df: DataFrame, model: Model, least: float = 0.35) -> DataFrame:
    """The rows of a table with a ``text`` column whose language the model can
    tell: not ``und``, and with a calibrated probability of ``least`` or more.
    All columns stay; there is no join and no shuffle."""

    def make():
        def work(batch):
            found = [model.predict(t) for t in texts(batch)]
            return [i for i, (lang, score) in enumerate(found) if lang != "und" and score >= least], []

        return work

    return map_texts(df, "", make, keep=tuple(df.columns))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows outside the held-out fold (crc32 of the id mod 4 is 2)
    that have a text and a language, and predict every row: the id,
    ``held_out``, ``lang_pred`` (``und`` if the text is null or has no letter)
    and ``score``, the calibrated probability (0 for ``und``).

    A null id is in no fold: ``held_out`` is false and it never trains. Rows
    that repeat are predicted alike; equal probabilities give the first
    language in order; a table without training rows gives ``und``; an empty
    table gives an empty result; other columns are ignored."""
    found = identify(df, train(fold_rows(df, id_col, text_col, lang_col)), id_col, text_col)
    held = F.coalesce(is_held_out(F.col(f"`{id_col}`")), F.lit(False))
    return found.select(id_col, held.alias("held_out"), "lang_pred", "score")
