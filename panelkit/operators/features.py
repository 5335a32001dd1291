"""Model features, labels and splits.

Leak-free by construction: same-period measures never enter the feature
list; covariates enter lagged within the entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import flag, log1p_target
from . import windows as W
from .joins import with_scalars


def add_panel_features(df: DataFrame, entity, period: str, target: str,
                       covariates: dict | None = None, logs: dict | None = None,
                       interactions: dict | None = None, horizons=(1, 5, 10)) -> DataFrame:
    """M3/M4: lag 1/2 and past-3 mean of the target (0 when missing), lagged
    covariates ``{out: col}`` (0 when missing), ``log1p`` of lagged values
    ``{out: lagged_col}``, products ``{out: (a, b)}`` and lead targets
    ``y_plus{h}``. All share one window spec (one sort per entity)."""
    cols = {
        f"{target}_lag1": W.lag_fill(target, 1, entity, period),
        f"{target}_lag2": W.lag_fill(target, 2, entity, period),
        f"{target}_roll3": W.past_mean(target, entity, period, 3, 1, default=0.0),
    }
    for out, c in (covariates or {}).items():
        cols[out] = W.lag_fill(c, 1, entity, period)
    for h in horizons:
        cols[f"y_plus{h}"] = W.lead(target, h, entity, period)
    out = df.withColumns(cols)
    derived = {o: log1p_target(c) for o, c in (logs or {}).items()}
    derived.update({o: F.col(a) * F.col(b) for o, (a, b) in (interactions or {}).items()})
    return out.withColumns(derived) if derived else out


# Measures that describe the same period as the target and so
# must never be features of a forecast of it.
SAME_PERIOD_MEASURES = ("amount", "qty", "n_customers", "intensity", "conflict", "conflict_level",
                        "supplier_count", "avg_price", "risk_score")


def check_leak_free(features, same_period=SAME_PERIOD_MEASURES, target: str | None = None) -> None:
    """M5: raise if a same-period measure (or the target itself) is used."""
    bad = [f for f in features if f in same_period or (target is not None and f == target)]
    if bad:
        raise ValueError(f"same-period columns in the feature list: {bad}")


def supervised_lag1(df: DataFrame, series: str, period: str, value: str) -> DataFrame:
    """M8: (series, period, lag1, y) with the first row of each series dropped."""
    w = Window.partitionBy(series).orderBy(period)
    return (df.withColumn("lag1", F.lag(value, 1).over(w)).dropna(subset=["lag1"])
              .select(series, period, "lag1", F.col(value).alias("y")))


# Integer scramble used for repeatable splits and samples
# (prime modulus and multiplier keep every product inside 64 bits).
SCRAMBLE_MOD = 1000003
SCRAMBLE_MUL = 7919


def scramble(key) -> F.Column:
    """Deterministic integer scramble of a non-negative integer key,
    reproducible in any SQL engine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.pmod(k, F.lit(SCRAMBLE_MOD)) * F.lit(SCRAMBLE_MUL), F.lit(SCRAMBLE_MOD))


def hash_split(df: DataFrame, key: str, pct: int = 80, out: str = "is_train") -> DataFrame:
    """Deterministic split by integer arithmetic on the key: the same
    row always lands on the same side, under any partitioning or retry."""
    return df.withColumn(out, (F.pmod(scramble(key), F.lit(100)) < pct).cast("long"))


def temporal_split(df: DataFrame, period: str, last_train, out: str = "is_train") -> DataFrame:
    """train = period <= last_train."""
    return df.withColumn(out, (F.col(period) <= last_train).cast("long"))


def stable_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """A repeatable sample of at most ``n`` rows: the ``n`` smallest
    scrambled keys (a distributed top-k, not a random draw)."""
    return df.withColumn("__h", scramble(key)).orderBy("__h", key).limit(n).drop("__h")


def label_train_quantile(df: DataFrame, score: str, period: str, last_train, q: float = 0.75,
                         out: str = "label") -> DataFrame:
    """threshold = quantile ``q`` of the score on training rows only;
    label = score >= threshold (the threshold column is kept)."""
    from .stats import exact_quantiles
    t = exact_quantiles(df.filter(F.col(period) <= last_train), score, {"threshold": q})
    return with_scalars(df, t).withColumn(out, flag(F.col(score) >= F.col("threshold")))


def observed_median(df: DataFrame, score: str) -> DataFrame:
    """One row: the median of the score as ``threshold``."""
    from .stats import exact_quantiles
    return exact_quantiles(df, score, {"threshold": 0.5})


def label_median(df: DataFrame, score: str, out: str = "label") -> DataFrame:
    """label = score > median of the observed rows."""
    return with_scalars(df, observed_median(df, score)).withColumn(out, flag(F.col(score) > F.col("threshold")))
