"""Statistics: correlation matrices, average ranks, ANOVA, Kruskal-Wallis,
chi-square goodness of fit and independence (X1-X6, W13, O4).

Ranks never use a window over all rows: values are first reduced to counts,
which ``operators.order`` puts in ranges whose borders follow the data. What is
computed from ranks weights the counts; ranks never go back to single rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import chi2_pvalue, f_pvalue
from .joins import with_scalars
from .order import order_table, placed, quantile_of, running


def _pairs(cols):
    return list(combinations(cols, 2))


def pearson_pairs(df: DataFrame, cols) -> DataFrame:
    """Pearson r for every pair (a < b in list order), pairwise complete
    rows, one aggregate. A constant column gives NULL, not an error."""
    aggs = []
    for i, (a, b) in enumerate(_pairs(cols)):
        x = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
        y = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
        aggs.append(F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))).alias(f"r{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(_pairs(cols))]
    return one.select(F.inline(F.array(*rows)))


def average_rank(df: DataFrame, value: str, by=(), out: str = "avg_rank", buckets: int | None = None) -> DataFrame:
    """Average rank (ties share the mean rank) of each distinct non-null
    ``value`` within ``by``; returns (by..., value, n_ties, out). ``buckets``:
    number of ranges (default: the shuffle setting)."""
    t = order_table(df, value, by, parts=buckets)
    return t.select(*by, value, F.col("n").alias("n_ties"), (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(out))


def spearman_pairs(df: DataFrame, cols, buckets: int | None = None) -> DataFrame:
    """Spearman rho per pair: rows complete on the pair are ranked (per
    pair), then Pearson on the ranks. The counts of (x, y) are put in order of
    x, then of y: each row gets its two ranks where it stands."""
    # one pass over the input: each row yields one (pair, x, y) row per pair
    pairs = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"),
                               F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                      for i, (a, b) in enumerate(_pairs(cols))])
    long = df.select(F.inline(pairs)).filter(F.col("y").isNotNull())
    by = ["pair", "a", "b"]
    # less the mean rank, so that the products below stay small
    rank = F.col("n_before") + (F.col("n_ties") + 1) / 2.0 - (F.col("n_total") + 1) / 2.0
    x = order_table(long, "x", by, also=["y"], parts=buckets).select(*by, "y", rank.alias("rx"), "n")
    y = running(placed(x, [*by, "y"], buckets), by, ["y"], ["n"], peers=True).select(*by, "rx", rank.alias("ry"), "n")
    product = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    return y.groupBy(*by).agg(F.try_divide(product("rx", "ry"), F.sqrt(product("rx", "rx") * product("ry", "ry"))).alias("rho"))


def top_pairs(pairs: DataFrame, value: str = "r", k: int = 8) -> DataFrame:
    """Top-k pairs by absolute coefficient."""
    return pairs.orderBy(F.abs(value).desc(), "a", "b").limit(k)


def anova(df: DataFrame, group: str, y: str) -> DataFrame:
    """One-way ANOVA F with its degrees of freedom, from per-group
    (n, mean, sample variance)."""
    d = df.filter(F.col(group).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
    grand = d.agg(F.avg(y).alias("__gm"), F.count(y).alias("__total"))
    x = with_scalars(g, grand)
    s = x.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("__gm"), 2)).alias("ssb"),
              F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw"),
              F.count(F.lit(1)).alias("k"), F.first("__total").alias("__total"))
    tot, k = F.col("__total"), F.col("k")
    return s.select(F.try_divide(F.col("ssb") / (k - 1), F.col("ssw") / (tot - k)).alias("f_stat"),
                    (k - 1).cast("bigint").alias("df_between"), (tot - k).cast("bigint").alias("df_within"))


def kruskal(df: DataFrame, group: str, y: str, buckets: int | None = None) -> DataFrame:
    """Kruskal-Wallis H (tie-corrected) and degrees of freedom, from the
    ranks of (value, group) counts."""
    d = df.filter(F.col(group).isNotNull()).select(group, F.col(y).cast("double").alias("v"))
    r = order_table(d, "v", also=[group], parts=buckets)
    rank = F.col("n_before") + (F.col("n_ties") + 1) / 2.0
    ties = F.col("n") * (F.pow(F.col("n_ties").cast("double"), F.lit(2.0)) - 1)  # over a value's groups: t^3 - t
    per = r.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * rank).alias("R"), F.sum(ties).alias("T"))
    s = per.agg(F.sum(F.col("R") * F.col("R") / F.col("n")).alias("S"), F.sum("n").alias("N"),
                F.count(F.lit(1)).alias("k"), F.sum("T").alias("T"))
    n = F.col("N").cast("double")
    h0 = F.lit(12.0) / (n * (n + 1)) * F.col("S") - 3 * (n + 1)
    c = 1 - F.try_divide(F.col("T"), n * n * n - n)
    return s.select(F.try_divide(h0, c).alias("h_stat"), (F.col("k") - 1).cast("bigint").alias("df"))


def chi2_gof(df: DataFrame, cat: str) -> DataFrame:
    """Chi-square goodness of fit against equal expected counts."""
    c = df.filter(F.col(cat).isNotNull()).groupBy(cat).agg(F.count(F.lit(1)).alias("o"))
    return chi2_gof_counts(c)


def chi2_gof_counts(counts: DataFrame) -> DataFrame:
    """X5 from pre-counted classes (column ``o``), in doubles and without the
    difference of two large sums."""
    x = with_scalars(counts, counts.agg(F.sum("o").cast("double").alias("N"), F.count(F.lit(1)).alias("k")))
    e = F.col("N") / F.col("k")
    return x.agg(F.sum(F.pow(F.col("o") - e, F.lit(2.0)) / e).alias("chi2"),
                 (F.count(F.lit(1)) - 1).cast("bigint").alias("df"))


def chi2_independence(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """Chi-square test of independence on the a x b contingency table.

    Sums (O - E)^2 / E over observed cells in doubles; each empty cell adds its
    E, which together is N less the E of observed cells, so no r x c grid is
    materialised. With one degree of freedom (2 x 2) and
    ``yates``, every |O - E| equals |O11 - E11| and is reduced by 0.5 (not
    below 0), as SciPy does."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cell = d.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = cell.groupBy(a).agg(F.sum("o").alias("ri"))
    cb = cell.groupBy(b).agg(F.sum("o").alias("cj"))
    tot = cell.agg(F.sum("o").alias("N"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"),
                   F.min(a).alias("__a1"), F.min(b).alias("__b1"))
    x = with_scalars(cell.join(ra, a).join(cb, b), tot)
    x = x.withColumn("e", F.col("ri").cast("double") * F.col("cj") / F.col("N"))
    first_a, first_b = F.col(a) == F.col("__a1"), F.col(b) == F.col("__b1")
    s = x.agg(F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2.0)) / F.col("e") - F.col("e")).alias("S"), F.first("N").alias("N"),
              F.first("r").alias("r"), F.first("c").alias("c"),
              F.sum(F.when(first_a & first_b, F.col("o"))).alias("o11"),
              F.max(F.when(first_a, F.col("ri"))).alias("r1"), F.max(F.when(first_b, F.col("cj"))).alias("c1"))
    n = F.col("N").cast("double")
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    plain = F.col("S") + n
    dd = F.abs(F.coalesce(F.col("o11"), F.lit(0)) - F.col("r1").cast("double") * F.col("c1") / n)
    adj = F.greatest(dd - 0.5, F.lit(0.0))
    corrected = adj * adj * n * n * n / (F.col("r1") * (n - F.col("r1")) * F.col("c1") * (n - F.col("c1")))
    stat = F.when(dof == 1, corrected).otherwise(plain) if yates else plain
    return s.select(stat.alias("chi2"), dof.cast("bigint").alias("df"))


def with_chi2_p(stat: DataFrame, x: str = "chi2", df: str = "df") -> DataFrame:
    return stat.withColumn("p_value", chi2_pvalue(F.col(x).cast("double"), F.col(df).cast("double")))


def with_f_p(stat: DataFrame) -> DataFrame:
    return stat.withColumn("p_value", f_pvalue(F.col("f_stat").cast("double"), F.col("df_between").cast("double"),
                                               F.col("df_within").cast("double")))


def exact_quantiles(df: DataFrame, value: str, probs: dict, by=(), buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (``quantile_cont``), for
    groups of any size: positions come from the order table instead of one
    in-memory value map per group (what ``percentile`` keeps).
    ``probs = {out_col: p}``; one row per group."""
    return quantile_of(order_table(df, value, by, parts=buckets), value, probs, by)


def column_quantiles(df: DataFrame, cols, probs: dict, buckets: int | None = None) -> DataFrame:
    """Exact quantiles of several columns at once: the columns are stacked
    into (column, value) rows and ``exact_quantiles`` runs per column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                        for c in cols])))
    return exact_quantiles(long, "value", probs, by=["column"], buckets=buckets)
