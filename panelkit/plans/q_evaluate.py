"""Catalogue, part 6: evaluation metrics.

Labelled documents give a binary target (``labels.quality``) and a score
(document length relative to the longest labelled document); the dense
panel gives a lag-1 forecast to score regression errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import flag, rnd, weighted_score
from ..operators import evaluate as EV
from ..operators import windows as W
from ..operators.joins import with_scalars
from ..sources.readers import table
from .q_describe import P2_SQL
from .q_stats import _avg_rank_sql
from .registry import register
from .roles import p2_panel

PRED_CUT = 0.1


def scored_docs(spark, root):
    lab = table(spark, root, "labels", ["doc_id", "quality"])
    doc = table(spark, root, "documents", ["doc_id", "n_chars"])
    x = lab.join(doc, "doc_id")
    mx = x.agg(F.max("n_chars").alias("__mx"))
    x = with_scalars(x, mx).withColumn("score", F.col("n_chars").cast("double") / F.col("__mx")).drop("__mx")
    return x.select("doc_id", F.col("quality").alias("y"), "score",
                    (F.col("score") >= PRED_CUT).cast("int").alias("pred"))


DOCS_SQL = f"""
x0 AS (SELECT l.doc_id, l.quality AS y, CAST(d.n_chars AS DOUBLE) AS nc FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
x AS (SELECT doc_id, y, nc / (SELECT max(nc) FROM x0) AS score,
             CAST(nc / (SELECT max(nc) FROM x0) >= {PRED_CUT} AS INTEGER) AS pred FROM x0)
"""


def binary_metrics(spark, root):
    m = EV.binary_metrics(scored_docs(spark, root), "y", "pred")
    return m.select("n", "tp", "fp", "fn", "tn", *[rnd(c, 6).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


register("binary_metrics", f"""WITH {DOCS_SQL},
c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE y = 1 AND pred = 1) AS BIGINT) AS tp,
             CAST(count(*) FILTER (WHERE y <> 1 AND pred = 1) AS BIGINT) AS fp,
             CAST(count(*) FILTER (WHERE y = 1 AND pred <> 1) AS BIGINT) AS fn,
             CAST(count(*) FILTER (WHERE y <> 1 AND pred <> 1) AS BIGINT) AS tn FROM x)
SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy,
       round(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS precision, round(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall,
       round(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")(binary_metrics)


def confusion(spark, root):
    return EV.confusion(scored_docs(spark, root), "y", "pred")


register("confusion", f"""WITH {DOCS_SQL}
SELECT y, pred, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY y, pred""")(confusion)


def class_report(spark, root):
    r = EV.class_report(scored_docs(spark, root), "y", "pred")
    return r.select("class", *[rnd(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


register("class_report", f"""WITH {DOCS_SQL},
k AS (SELECT y AS c FROM x UNION SELECT pred FROM x),
per AS (SELECT c, count(*) FILTER (WHERE y = c AND pred = c) AS hit, count(*) FILTER (WHERE pred = c) AS given, count(*) FILTER (WHERE y = c) AS support
        FROM k CROSS JOIN x GROUP BY c),
m AS (SELECT c, hit, support, COALESCE(hit / NULLIF(given, 0), 0) AS precision, COALESCE(hit / NULLIF(support, 0), 0) AS recall,
             COALESCE(2 * hit / NULLIF(given + support, 0), 0) AS f1 FROM per)
SELECT CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""")(class_report)


def roc_auc(spark, root):
    a = EV.roc_auc(scored_docs(spark, root), "y", "score")
    return a.select(rnd("auc", 6).alias("auc"), "n_pos", "n_neg")


register("roc_auc", f"""WITH {DOCS_SQL},
r AS (SELECT y, {_avg_rank_sql('score')} AS rk FROM x),
s AS (SELECT sum(rk) FILTER (WHERE y = 1) AS rp, CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS n_pos,
             CAST(count(*) FILTER (WHERE y <> 1) AS BIGINT) AS n_neg FROM r)
SELECT round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rp - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END, 6) AS auc,
       n_pos, n_neg FROM s""")(roc_auc)


def pr_curve(spark, root):
    c = EV.pr_curve(scored_docs(spark, root), "y", "score")
    return c.select("score", "tp", "k", *[rnd(x, 6).alias(x) for x in ["precision", "recall", "f1"]])


_PR_SQL = f"""{DOCS_SQL},
h AS (SELECT score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, count(*) AS one FROM x GROUP BY score),
c AS (SELECT score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(one) OVER w AS BIGINT) AS k FROM h
      WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pp AS (SELECT sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p FROM x),
cur AS (SELECT score, tp, k, tp / k AS precision, tp / p AS recall, COALESCE(2 * tp / NULLIF(k + p, 0), 0) AS f1
        FROM c CROSS JOIN pp)
"""
register("pr_curve", f"""WITH {_PR_SQL}
SELECT score, tp, k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cur""")(pr_curve)


def best_f1(spark, root):
    b = EV.best_f1_threshold(scored_docs(spark, root), "y", "score")
    return b.select("threshold", rnd("f1", 6).alias("f1"))


register("best_f1", f"""WITH {_PR_SQL}
SELECT CASE WHEN (SELECT count(DISTINCT y) FROM x) < 2 THEN 0.5 ELSE score END AS threshold, round(f1, 6) AS f1
FROM cur ORDER BY f1 DESC, score ASC LIMIT 1""")(best_f1)


# ------------------------------------------------------------ regression errors

def _lag_forecast(spark, root):
    p = p2_panel(spark, root).withColumn("n_events", F.col("n_events").cast("double"))
    return p.withColumn("pred", W.lag_fill("n_events", 1, "n_name", "month_idx", default=None))


def rmse_by_entity(spark, root):
    e = EV.rmse_by(_lag_forecast(spark, root), "n_name", "n_events", "pred")
    return e.select("n_name", rnd("rmse", 6).alias("rmse"), "n")


_LAG_SQL = f"""{P2_SQL},
lf AS (SELECT n_name, month_idx, CAST(n_events AS DOUBLE) AS y,
              lag(CAST(n_events AS DOUBLE)) OVER (PARTITION BY n_name ORDER BY month_idx) AS pred FROM p2)"""
register("rmse_by_entity", f"""WITH {_LAG_SQL}
SELECT n_name, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, CAST(count(*) AS BIGINT) AS n
FROM lf WHERE pred IS NOT NULL GROUP BY n_name""")(rmse_by_entity)


def forecast_rmse(spark, root):
    e = EV.rmse_r2(_lag_forecast(spark, root), "n_events", "pred")
    return e.select(rnd("rmse", 6).alias("rmse"), rnd("r2", 6).alias("r2"), "n")


register("forecast_rmse", f"""WITH {_LAG_SQL}
SELECT round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
       round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2, CAST(count(*) AS BIGINT) AS n
FROM lf WHERE pred IS NOT NULL""")(forecast_rmse)


# ------------------------------------------------------------ group k-fold (E3 + M20)

K_FOLDS = 5


def group_kfold_baseline(spark, root):
    """Majority-class baseline under group k-fold: whole nations per fold; the
    label threshold (q75 of the risk score) and the majority class come from
    the training folds only, all of them from one order table."""
    d = p2_panel(spark, root).select("n_name", "month_idx", weighted_score("n_events", "qty").alias("risk"))
    d = d.join(EV.group_folds(d, "n_name", K_FOLDS), "n_name")
    t = EV.fold_thresholds(EV.fold_table(d, "risk", "fold", K_FOLDS), "risk", K_FOLDS, 0.75)
    of = lambda c: F.element_at(c, F.col("fold") + 1)
    test = with_scalars(d, t).where((of("positives") > 0) & (of("negatives") > 0))  # both classes in training
    test = test.select("fold", flag(F.col("risk") >= of("thresholds")).alias("y"), flag(of("positives") > of("negatives")).alias("maj"))
    per = test.groupBy("fold").agg(*EV.accuracy_f1(F.col("y"), F.col("maj")))
    s = with_scalars(EV.over_folds(per, {"acc": "accuracy", "f1": "f1"}), d.agg(F.count(F.lit(1)).alias("n_rows")))
    return s.select(*[rnd(c, 6).alias(c) for c in ["accuracy_mean", "accuracy_std", "f1_mean", "f1_std"]],
                    "n_splits", "n_rows")


register("group_kfold_baseline", f"""WITH {P2_SQL},
d0 AS (SELECT n_name, month_idx, n_events + 0.5 * qty AS risk FROM p2),
fo AS (SELECT n_name, CAST((row_number() OVER (ORDER BY sz DESC, n_name) - 1) % {K_FOLDS} AS INTEGER) AS fold
       FROM (SELECT n_name, count(*) AS sz FROM d0 GROUP BY n_name) t),
d AS (SELECT d0.*, fo.fold FROM d0 JOIN fo USING (n_name)),
fl AS (SELECT unnest(range(0, {K_FOLDS})) AS f),
train AS (SELECT d.risk, fl.f FROM d JOIN fl ON d.fold <> fl.f),
thr AS (SELECT f, quantile_cont(risk, 0.75) AS thr FROM train GROUP BY f),
tl AS (SELECT train.f, CAST(risk >= thr AS INTEGER) AS ytr FROM train JOIN thr USING (f)),
maj AS (SELECT f, first(ytr ORDER BY c DESC, ytr) AS maj, sum(ytr * c) AS s, sum(c) AS n FROM
        (SELECT f, ytr, count(*) AS c FROM tl GROUP BY f, ytr) z GROUP BY f),
ok AS (SELECT maj.f, maj.maj, thr.thr FROM maj JOIN thr USING (f) WHERE s > 0 AND s < n),
test AS (SELECT d.fold, CAST(d.risk >= ok.thr AS INTEGER) AS yte, ok.maj FROM d JOIN ok ON d.fold = ok.f),
per AS (SELECT fold, avg(CASE WHEN yte = maj THEN 1.0 ELSE 0.0 END) AS acc,
               COALESCE(2.0 * count(*) FILTER (WHERE yte = 1 AND maj = 1) / NULLIF(2 * count(*) FILTER (WHERE yte = 1 AND maj = 1)
                 + count(*) FILTER (WHERE yte = 0 AND maj = 1) + count(*) FILTER (WHERE yte = 1 AND maj = 0), 0), 0.0) AS f1
        FROM test GROUP BY fold)
SELECT round(avg(acc), 6) AS accuracy_mean, round(stddev_pop(acc), 6) AS accuracy_std, round(avg(f1), 6) AS f1_mean,
       round(stddev_pop(f1), 6) AS f1_std, CAST(count(*) AS BIGINT) AS n_splits, (SELECT CAST(count(*) AS BIGINT) FROM d) AS n_rows
FROM per""")(group_kfold_baseline)
