"""Declarative rule engine.

Rules are data: (id, name, priority, category, SQL predicate, text). All
rules are evaluated in one projection as ``array(when(pred, struct(...)))``;
NULLs are dropped and the rest exploded, so a row fires 0..n rules without a
join or a Python loop. A predicate that is NULL (missing input) counts as not
fired, like an exception in a Python rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import flag
from . import windows as W
from .joins import with_scalars
from .stats import exact_quantiles


def derive_rule_features(df: DataFrame, entity: str, period: str, count: str, severity: str,
                         covariate: str, group: str, last_train_period, trend_factor: float = 1.2):
    """Past-3 mean (min 2 rows), trend flag, low-covariate flag (below the
    observed 25% quantile), score and group tier (group means over the
    training era, cut at their 50% / 75% quantiles)."""
    from ..functions.numeric import tier, weighted_score
    from ..session import cut_lineage
    d = df.withColumn("past3", W.past_mean(count, entity, period, 3, 2, default=None))
    d = d.withColumn("trend_flag", flag(F.col(count) > F.col("past3") * trend_factor))
    # panel-sized and read by four branches below (quantile, cut, group means,
    # tiers): written once instead of re-derived per branch
    d = cut_lineage(d)
    q25 = exact_quantiles(d, covariate, {"__q25": 0.25})
    d = with_scalars(d, q25).withColumn("low_flag", flag(F.col(covariate) < F.col("__q25"))).drop("__q25")
    d = cut_lineage(d.withColumn("risk_score", weighted_score(count, severity)))
    means = d.filter(F.col(period) <= last_train_period).groupBy(group).agg(F.avg("risk_score").alias("group_mean"))
    q = exact_quantiles(means, "group_mean", {"__q50": 0.5, "__q75": 0.75})
    t = with_scalars(means, q).select(group, "group_mean",
                                      tier("group_mean", F.col("__q50"), F.col("__q75")).alias("tier"))
    # a group without training rows has mean 0 (dictionary default), then the same cuts
    d = with_scalars(d.join(means, group, "left"), q)
    d = d.withColumn("tier", tier("group_mean", F.col("__q50"), F.col("__q75"))).drop("__q50", "__q75")
    return d, t


def apply_rules(latest: DataFrame, rules, keep) -> DataFrame:
    """R2: evaluate every rule on every row; one output row per firing."""
    hits = F.array(*[
        F.when(F.coalesce(F.expr(r["predicate"]), F.lit(False)),
               F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["name"]).alias("rule_name"),
                        F.lit(r["priority"]).alias("priority"), F.lit(r["category"]).alias("category"),
                        F.lit(r["text"]).alias("recommendation")))
        for r in rules])
    return (latest.select(*keep, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
                  .select(*keep, "h.*"))


def hits_by(fired: DataFrame, by, entity: str) -> DataFrame:
    """Firings and distinct entities per key."""
    by = [by] if isinstance(by, str) else list(by)
    return fired.groupBy(*by).agg(F.count(F.lit(1)).alias("n_fired"),
                                  F.count_distinct(entity).alias("n_entities"))
