"""Budget allocation (R3, R4), closed form.

Minimise sum_i h_i * (1 - min(e_max, a * sqrt(x_i / m))) with m = B / n,
subject to sum_i x_i = B and lo <= x_i <= hi. Equal marginal benefit gives
x_i = k * h_i^2, clipped to [lo, up] with up = min(hi, m * (e_max / a)^2)
(beyond ``up`` the effect is capped, so money there buys nothing). The
total D(k) = sum_i clip(k h_i^2, lo, up) is piecewise linear and
non-decreasing in k: each group adds a break-point at lo/h^2 (slope +h^2)
and one at up/h^2 (slope -h^2). Sorting the break-points and taking prefix
sums of slope and constant gives the segment where D(k) = B, in closed
form. Feasible when n*lo <= B <= sum(up); otherwise the allocation is NULL.

Everything is keyed by ``scenario``: many budgets / group sets are solved
at once. The bounds depend on a scenario's budget and number of groups alone, so
they are columns of its row; the one running sum is over ranges of break-points
(``prefix_sums``), so a scenario with millions of groups is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .prefix import prefix_sums

# Parameters of the effectiveness curve and the bounds.
MIN_ALLOC = 2.0
MAX_ALLOC = 40.0
MAX_EFFECT = 0.70
ALPHA = 0.55


def allocate(harm: DataFrame, scenario: str, group: str, h: str, budgets: DataFrame,
             lo: float = MIN_ALLOC, hi: float = MAX_ALLOC, e_max: float = MAX_EFFECT,
             alpha: float = ALPHA) -> DataFrame:
    """``harm`` has (scenario, group, h); ``budgets`` has (scenario,
    budget). Returns per group: allocation, effectiveness, harm after."""
    base = harm.groupBy(scenario).agg(F.count(F.lit(1)).alias("__n")).join(budgets, scenario)
    base = base.withColumn("__m", F.col("budget") / F.col("__n"))
    base = base.withColumn("__up", F.least(F.lit(hi), F.col("__m") * (e_max / alpha) ** 2))
    base = cut_lineage(base.withColumns({"__c0": F.col("__n") * lo, "__sum_up": F.col("__n") * F.col("__up")}))  # one row per scenario
    g = cut_lineage(harm.select(scenario, group, h).join(base.select(scenario, "budget", "__m", "__up", "__c0"), scenario))
    h2 = F.col(h) * F.col(h)
    point = lambda k, typ, ds, dc: F.struct(k.alias("k"), F.lit(typ).alias("typ"), ds.alias("ds"), dc.alias("dc"))
    ev = g.filter(F.col(h) > 0).select(scenario, group, "budget", "__c0", F.inline(F.array(
        point(F.lit(lo) / h2, 0, h2, F.lit(-lo)), point(F.col("__up") / h2, 1, -h2, F.col("__up")))))
    # running slope / constant over break-points in (k, type, group) order
    ev = prefix_sums(ev, scenario, "k", ["typ", group], ["ds", "dc"])
    ev = ev.withColumnsRenamed({"ds_cum": "__slope", "dc_cum": "__cc"}).withColumn("__const", F.col("__c0") + F.col("__cc"))
    # the last break-point whose total is still within the budget holds k*
    seg = (ev.filter(F.col("__const") + F.col("__slope") * F.col("k") <= F.col("budget") + 1e-9)
             .groupBy(scenario).agg(F.max_by(F.struct("k", "__slope", "__const"),
                                             F.struct("k", "typ", group)).alias("s")))
    kstar = base.join(seg, scenario, "left").select(
        scenario,
        F.when((F.col("budget") < F.col("__c0") - 1e-9) | (F.col("budget") > F.col("__sum_up") + 1e-9), F.lit(None))
         .when(F.col("s").isNull(), F.lit(0.0))
         .when(F.col("s.__slope") > 0, (F.col("budget") - F.col("s.__const")) / F.col("s.__slope"))
         .otherwise(F.col("s.k")).alias("__k"))
    out = g.join(kstar, scenario, "left")
    x = F.when(F.col(h) > 0, F.least(F.greatest(F.col("__k") * h2, F.lit(lo)), F.col("__up"))).otherwise(F.lit(lo))
    x = F.when(F.col("__k").isNotNull() | (F.col(h) <= 0), x)
    out = out.withColumn("alloc", x)
    eff = F.least(F.lit(e_max), alpha * F.sqrt(F.greatest(F.col("alloc") / F.col("__m"), F.lit(0.0))))
    return out.select(scenario, group, F.col(h).alias("harm"), "budget", "alloc",
                      (eff * 100).alias("effect_pct"), (F.col(h) * (1 - eff)).alias("harm_after"))


def allocation_summary(alloc: DataFrame, scenario: str) -> DataFrame:
    """Totals per scenario and the overall harm reduction in percent."""
    return alloc.groupBy(scenario).agg(
        F.sum("alloc").alias("allocated"), F.sum("harm").alias("harm_before"),
        F.sum("harm_after").alias("harm_after"),
        (100 * (1 - F.try_divide(F.sum("harm_after"), F.sum("harm")))).alias("reduction_pct"))
