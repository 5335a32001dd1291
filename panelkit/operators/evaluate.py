"""Evaluation: regression errors, binary metrics, ROC AUC, PR curve, F1-best
threshold, confusion matrix and group k-fold folds (E1-E8, O7, M20).

Curves are running sums over distinct scores (see ``operators.order``); nothing
is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import with_scalars
from .order import order_table, quantiles_of


def rmse_r2(df: DataFrame, y: str, pred: str) -> DataFrame:
    """RMSE and R2 over rows where both are present."""
    d = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.col(y) - F.col(pred)
    s = d.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__sse"),
              F.var_pop(y).alias("__vy"), F.count(F.lit(1)).alias("n"))
    return s.select("rmse", (1 - F.try_divide(F.col("__sse"), F.col("__vy") * F.col("n"))).alias("r2"), "n")


def rmse_by(df: DataFrame, by, y: str, pred: str) -> DataFrame:
    """RMSE per key, worst first."""
    by = [by] if isinstance(by, str) else list(by)
    d = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.col(y) - F.col(pred)
    return d.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n")) \
            .orderBy(F.col("rmse").desc(), *by)


def binary_metrics(df: DataFrame, y: str, pred: str, by=()) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class (per key of
    ``by``); 0 when a ratio is undefined (zero_division=0)."""
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(yy & pp).alias("tp"),
                            F.count_if(~yy & pp).alias("fp"), F.count_if(yy & ~pp).alias("fn"),
                            F.count_if(~yy & ~pp).alias("tn"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return s.select(*by, "n", "tp", "fp", "fn", "tn",
                    F.try_divide(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Confusion matrix in long form."""
    return df.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class precision, recall, F1 (0 where undefined) and support, then
    ``accuracy`` (as f1), and the means over classes, plain (``macro avg``) and by
    support (``weighted avg``). Classes are those of either column; null is none."""
    d = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    cells = d.groupBy(F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # each cell tells of the class that it has and of the one that it was given
    told = cells.select(F.inline(F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("has"), F.lit(0).cast("long").alias("given")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("has"), F.col("n").alias("given")))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = told.groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("has").alias("support"), F.sum("given").alias("given")).select(
        "c", "hit", zero(F.try_divide("hit", "given")).alias("precision"), zero(F.try_divide("hit", "support")).alias("recall"),
        zero(F.try_divide(2 * F.col("hit"), F.col("given") + F.col("support"))).alias("f1"), "support")
    measures = ["precision", "recall", "f1"]
    by_support = lambda m: F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support"))
    whole = per.agg(F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                             F.try_divide(F.sum("hit"), F.sum("support")).alias("f1"), F.sum("support").alias("support")).alias("a"),
                    F.struct(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")).alias("b"),
                    F.struct(F.lit("weighted avg").alias("class"), *[by_support(m).alias(m) for m in measures], F.sum("support").alias("support")).alias("c"))
    return per.select(F.col("c").cast("string").alias("class"), *measures, "support").unionByName(whole.select(F.inline(F.array("a", "b", "c"))))


def roc_auc(df: DataFrame, y: str, score: str, by=(), buckets: int | None = None) -> DataFrame:
    """E5: AUC by the rank-sum formula with average ranks (per key of
    ``by``), from (score, class) counts; NULL with one class."""
    by = list(by)
    d = df.filter(F.col(y).isNotNull()).select(
        *by, (F.col(y) == 1).alias("__y"), F.col(score).cast("double").alias("__s"))
    r = order_table(d, "__s", by, also=["__y"], parts=buckets)
    rank = F.col("n_before") + (F.col("n_ties") + 1) / 2.0
    pos = F.col("__y")
    s = r.groupBy(*by).agg(F.sum(F.when(pos, F.col("n") * rank)).alias("__rp"),
                           F.sum(F.when(pos, F.col("n")).otherwise(0)).alias("n_pos"),
                           F.sum(F.when(pos, 0).otherwise(F.col("n"))).alias("n_neg"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (F.col("__rp") - p * (p + 1) / 2) / (p * n))
    if not by:  # one row, for no rows too
        s = s.withColumns({"n_pos": F.coalesce("n_pos", F.lit(0)), "n_neg": F.coalesce("n_neg", F.lit(0))})
    return s.select(*by, auc.alias("auc"), "n_pos", "n_neg")


def metrics_by(predictions: DataFrame, by, y: str = "y", pred: str = "pred", proba: str = "proba") -> DataFrame:
    """One row of ``binary_metrics`` and ``auc`` (null without scores) per
    key of a predictions frame."""
    return binary_metrics(predictions, y, pred, by).join(roc_auc(predictions, y, proba, by).select(*by, "auc"), by, "left")


def cumulative_by_score(df: DataFrame, score: str, cols, buckets: int | None = None) -> DataFrame:
    """Per distinct score: sums of ``cols`` over rows with score >= it, as
    ``cum_{c}``, and over all rows, as ``total_{c}``."""
    t = order_table(df, score, weights={c: F.col(c) for c in cols}, parts=buckets)
    return t.select(score, *[(F.col(f"{c}_total") - F.col(f"{c}_before")).alias(f"cum_{c}") for c in cols],
                    *[F.col(f"{c}_total").alias(f"total_{c}") for c in cols])


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """For each distinct score s (threshold 'score >= s'): true positives,
    predicted positives, precision and recall."""
    d = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("score"), (F.col(y) == 1).cast("long").alias("pos"),
        F.lit(1).cast("long").alias("one"))
    c = cumulative_by_score(d, "score", ["pos", "one"])
    return c.select(
        "score", F.col("cum_pos").alias("tp"), F.col("cum_one").alias("k"),
        F.try_divide(F.col("cum_pos"), F.col("cum_one")).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("cum_pos"), F.col("cum_one") + F.col("total_pos")), F.lit(0.0)).alias("f1"))


def best_f1_threshold(df: DataFrame, y: str, score: str, default: float = 0.5) -> DataFrame:
    """The score threshold with the highest F1 (lowest score among ties);
    ``default`` when only one class is present."""
    curve = pr_curve(df, y, score)
    best = curve.orderBy(F.col("f1").desc(), F.col("score").asc()).limit(1)
    classes = df.agg(F.count_distinct(y).alias("__k"))
    out = with_scalars(classes, best.select(F.col("score").alias("__t"), F.col("f1").alias("__f1")))
    # the curve is empty only with no rows; with one class fall back to ``default``
    return out.select(F.when(F.col("__k") < 2, F.lit(default)).otherwise(F.col("__t")).alias("threshold"),
                      F.when(F.col("__k") < 2, F.lit(None).cast("double")).otherwise(F.col("__f1")).alias("f1"))


def group_folds(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Whole groups per fold: groups ranked by (size desc, key), fold =
    (rank - 1) mod k. Returns (group, fold). The ranking is a distributed
    row number (range partitioning + per-partition offsets), so millions of
    groups never meet in one task."""
    from .prefix import row_numbers
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    r = row_numbers(g, [F.col("__size").desc(), F.col(group).asc()], "__rank")
    return r.select(group, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int").alias(out))


def fold_table(df: DataFrame, value: str, fold: str, k: int) -> DataFrame:
    """The order table of ``value`` with, for each fold f, the number of rows
    outside it as weight ``n{f}``. Every training set is read from this table;
    no row is copied per fold."""
    return order_table(df, value, weights={f"n{f}": F.when(F.col(fold) != f, 1).otherwise(0).cast("long") for f in range(k)})


def fold_thresholds(table: DataFrame, value: str, k: int, p: float) -> DataFrame:
    """One row from ``fold_table``: ``thresholds``, the ``p`` quantile of each
    fold's training rows, and ``positives`` and ``negatives``, how many of these
    reach it or not."""
    t = quantiles_of(table, value, {f"t{f}": (p, f"n{f}") for f in range(k)})
    t = t.select(F.array(*[F.col(f"t{f}") for f in range(k)]).alias("thresholds"))
    reach = lambda f: F.col(value) >= F.col("thresholds")[f]
    return with_scalars(table, t).agg(
        F.first("thresholds").alias("thresholds"),
        F.array(*[F.coalesce(F.sum(F.when(reach(f), F.col(f"n{f}"))), F.lit(0)) for f in range(k)]).alias("positives"),
        F.array(*[F.coalesce(F.sum(F.when(~reach(f), F.col(f"n{f}"))), F.lit(0)) for f in range(k)]).alias("negatives"))


def accuracy_f1(y, pred) -> list:
    """Aggregates: share of equal flags, and F1 of class 1 (0 where undefined)."""
    both = 2 * F.count_if((y == 1) & (pred == 1))
    f1 = F.try_divide(both, both + F.count_if((y == 0) & (pred == 1)) + F.count_if((y == 1) & (pred == 0)))
    return [F.avg((y == pred).cast("double")).alias("acc"), F.coalesce(f1, F.lit(0.0)).alias("f1")]


def over_folds(per: DataFrame, measures: dict, by=()) -> DataFrame:
    """Mean and population standard deviation over folds of some columns,
    ``measures = {column: name}``, with the number of folds."""
    aggs = [x for c, name in measures.items() for x in (F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"))]
    return per.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_splits"))
