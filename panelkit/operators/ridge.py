"""Ridge regression with the penalty chosen by leave-one-out error, for any
number of features and, in the same passes, for every training set of a k-fold
split (M15, M22, E3).

Rows are read three times, whatever the number of penalties and folds:

1. means and spreads, for numerically safe sums;
2. the Gram matrix of (1, features, label) per fold, summed in each task and then
   over tasks; what a fold trains on is the total less its own matrix, and the
   means, spreads and cross products of the training rows are read from it;
3. with one eigen-decomposition of each training set's p x p matrix, the
   leave-one-out residual of a row is a product for all penalties at once.

Only sums of the size of the feature list reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Penalties of the panel models (25, log-spaced 1e-3..1e4).
PANEL_ALPHAS = np.logspace(-3, 4, 25)


@dataclass
class RidgeFit:
    """A fit on the raw scale of the features; ``errors`` is the mean squared
    leave-one-out error of each penalty."""

    intercept: float
    coefficients: np.ndarray
    alpha: float
    errors: np.ndarray
    n: int


def _lists(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _summed(df: DataFrame, run, keys: int, size: int) -> np.ndarray:
    """The arrays (key, values) that the tasks of ``run`` yield, summed by key."""
    rows = df.mapInArrow(run, "key int, at int, value double").groupBy("key", "at").agg(F.sum("value")).collect()
    out = np.zeros((keys, size))
    for key, at, value in rows:
        out[key, at] = value
    return out


def _told(sums: np.ndarray) -> pa.RecordBatch:
    keys, size = sums.shape
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(keys), size), pa.int32()), pa.array(np.tile(np.arange(size), keys), pa.int32()),
                                       pa.array(sums.ravel())], names=["key", "at", "value"])


def fit_ridge_cv(df: DataFrame, x: str, y: str, scale, alphas=PANEL_ALPHAS, fold: str | None = None, k: int = 1) -> list[RidgeFit]:
    """Ridge with an unpenalised intercept on the array column ``x``; features
    marked in ``scale`` are standardised by the training rows (population
    deviation; a constant one stays unscaled). With ``fold`` (0 .. k - 1) one fit
    for each fold, on the rows of all others; else one on all rows.

    The penalty has the smallest mean squared leave-one-out error, the first of
    equals. Rows with a null label or a null or NaN feature take no part. A
    training set of fewer than two rows gets NaN coefficients."""
    scale = np.asarray(scale, bool)
    alphas = np.asarray(alphas, float)
    p, a = len(scale), len(alphas)
    key = F.col(fold).cast("int") if fold else F.lit(0)
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))).select(
        F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), key.alias("key"))
    if rows.isEmpty():
        return [RidgeFit(np.nan, np.full(p, np.nan), np.nan, np.full(a, np.nan), 0)] * k
    first = rows.agg(Summarizer.metrics("mean", "std").summary(array_to_vector(F.col("x"))).alias("s"), F.avg("y").alias("y")).first()
    shift, y0 = first["s"]["mean"].toArray(), first["y"]
    spread = np.where(scale & (first["s"]["std"].toArray() > 0), first["s"]["std"].toArray(), 1.0)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, (p + 2) ** 2))
        for batch in batches:
            if batch.num_rows:
                keys, one = batch.column(2).to_numpy(), np.ones((batch.num_rows, 1))
                full = np.concatenate([one, (_lists(batch, p) - shift) / spread, batch.column(1).to_numpy()[:, None] - y0], axis=1)
                for f in np.unique(keys):
                    sums[f] += (full[keys == f].T @ full[keys == f]).ravel()
        yield _told(sums)

    each = _summed(rows, gram, k, (p + 2) ** 2).reshape(k, p + 2, p + 2)
    trained = [each.sum(axis=0) - each[f] if fold else each[f] for f in range(k)]
    parts = []
    for g in trained:
        n = max(g[0, 0], 1.0)
        mean, y_mean = g[0, 1:-1] / n, g[0, -1] / n
        cov = g[1:-1, 1:-1] - n * np.outer(mean, mean)
        dev = np.sqrt(np.maximum(np.diag(cov), 0) / n)
        dev = np.where(scale & (dev > 1e-12), dev, 1.0)
        values, vectors = np.linalg.eigh(cov / np.outer(dev, dev))
        cross = (g[1:-1, -1] - n * mean * y_mean) / dev
        parts.append((g[0, 0], mean, y_mean, dev, np.maximum(values, 0), vectors, vectors.T @ cross))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, a))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rest = batch.column(2).to_numpy(), (_lists(batch, p) - shift) / spread
            label = batch.column(1).to_numpy() - y0
            for f, (n, mean, y_mean, dev, values, vectors, cross) in enumerate(parts):
                mine = keys != f if fold else keys == f
                if n >= 2 and mine.any():
                    z = (rest[mine] - mean) / dev @ vectors
                    shrunk = 1 / (values[:, None] + alphas[None])  # features x penalties
                    residual = (label[mine] - y_mean)[:, None] - z @ (cross[:, None] * shrunk)
                    sums[f] += ((residual / (1 - 1 / n - (z * z) @ shrunk)) ** 2).sum(axis=0)
        yield _told(sums)

    errors, fits = _summed(rows, left_out, k, a), []
    for f, (n, mean, y_mean, dev, values, vectors, cross) in enumerate(parts):
        if n < 2:
            fits.append(RidgeFit(np.nan, np.full(p, np.nan), np.nan, np.full(a, np.nan), int(n)))
            continue
        best = int(np.argmin(errors[f]))
        slope = vectors @ (cross / (values + alphas[best])) / dev  # on the shifted scale of pass 1
        coefficients = slope / spread
        fits.append(RidgeFit(y0 + y_mean - slope @ mean - coefficients @ shift, coefficients, float(alphas[best]), errors[f] / n, int(n)))
    return fits


def predicted(fits: list[RidgeFit], x: str, fold: str | None = None) -> Column:
    """The prediction for a row's features, by the fit of its own fold."""
    at = F.col(fold).cast("int") if fold else F.lit(0)
    weights = F.get(F.array(*[F.array(*[F.lit(float(c)) for c in fit.coefficients]) for fit in fits]), at)
    start = F.get(F.array(*[F.lit(float(fit.intercept)) for fit in fits]), at)
    products = F.zip_with(F.col(x), weights, lambda v, w: v * w)
    return start + F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
