"""Catalogue, part 5: correlation, rank tests, ANOVA, chi-square, samples,
splits and labels (X1-X7, W13, O4, M28-M31, P8, P12, P15)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.numeric import rnd, weighted_score
from ..operators import features as FT
from ..operators import stats as S
from ..sources.readers import table
from .q_build import JOINED_SQL, joined_panel
from .q_describe import P2_SQL
from .registry import ORACLE, register
from .roles import ORDER_EVENTS_SQL, order_events, p1_panel, p2_panel

MEASURES = ["n_events", "amount", "supplier_count", "avg_price"]
_J = JOINED_SQL.replace("SELECT p.n_name, p.month_idx,", "SELECT p.n_name, p.month_idx, p.r_name,")


def _measures(spark, root):
    return joined_panel(spark, root).withColumn("n_events", F.col("n_events").cast("double"))


def corr_pearson(spark, root):
    return S.pearson_pairs(_measures(spark, root), MEASURES).select("a", "b", rnd("r", 6).alias("r"))


_PEARSON_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN isnan(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) THEN NULL "
    f"ELSE corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END, 6) AS r FROM j"
    for a, b in combinations(MEASURES, 2))
register("corr_pearson", f"WITH {_J} {_PEARSON_SQL}")(corr_pearson)


def corr_spearman(spark, root):
    return S.spearman_pairs(_measures(spark, root), MEASURES).select("a", "b", rnd("rho", 6).alias("rho"))


def _avg_rank_sql(v, part=""):
    p = f"PARTITION BY {part} " if part else ""
    return (f"(rank() OVER ({p}ORDER BY {v}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{v}) - 1) / 2.0)")


register("corr_spearman", f"WITH {_J} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE corr(rx, ry) END, 6) AS rho FROM ("
    f"SELECT {_avg_rank_sql('x')} AS rx, {_avg_rank_sql('y')} AS ry FROM ("
    f"SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM j WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t) u"
    for a, b in combinations(MEASURES, 2)))(corr_spearman)


def top_pairs(spark, root):
    return S.top_pairs(corr_pearson(spark, root), "r", 3)


register("top_pairs", f"WITH {_J}, pears AS ({_PEARSON_SQL}) SELECT * FROM pears ORDER BY abs(r) DESC, a, b LIMIT 3")(top_pairs)


def _p2(spark, root):
    return p2_panel(spark, root).withColumn("n_events", F.col("n_events").cast("double"))


def anova(spark, root):
    a = S.anova(_p2(spark, root), "r_name", "n_events")
    return a.select(rnd("f_stat", 6).alias("f_stat"), "df_between", "df_within")


register("anova", f"""WITH {P2_SQL},
g AS (SELECT r_name, count(n_events) AS n, avg(n_events) AS m, var_samp(n_events) AS v FROM p2 GROUP BY r_name),
gr AS (SELECT avg(n_events) AS gm, count(n_events) AS nn FROM p2)
SELECT round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum((n - 1) * COALESCE(v, 0)) / (max(nn) - count(*))), 6) AS f_stat,
       CAST(count(*) - 1 AS BIGINT) AS df_between, CAST(max(nn) - count(*) AS BIGINT) AS df_within
FROM g CROSS JOIN gr""")(anova)


def _tested(df, stat):
    """A statistic with its degrees of freedom and p-value, rounded."""
    return df.select(rnd(stat, 6).alias(stat), *[c for c in df.columns if c.startswith("df")], rnd("p_value", 6).alias("p_value"))


# p-values of the oracle: the density integrated by Simpson's rule, nothing shared with the engine's tails
_NODES = "(SELECT i, i / 20000.0 AS u, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 60000.0 AS w FROM range(0, 20001) r(i)) nodes"
#: P(F > f): the beta integral from 0 to d2 / (d2 + d1 f), which u scales.
_F_P = f"""(SELECT round(sum(w * CASE WHEN u = 0 THEN 0 ELSE exp((d2 / 2.0 - 1) * ln(x0 * u) + (d1 / 2.0 - 1) * ln(1 - x0 * u)
    + lgamma((d1 + d2) / 2.0) - lgamma(d1 / 2.0) - lgamma(d2 / 2.0)) * x0 END), 6) FROM {_NODES})"""
#: P(X > x) of chi-square: the gamma integral from x / 2 on; t = x / 2 + u / (1 - u).
_CHI2_P = f"""(SELECT round(sum(w * CASE WHEN u >= 1 THEN 0 ELSE exp((k / 2.0 - 1) * ln(x / 2 + u / (1 - u) + 1e-300) - (x / 2 + u / (1 - u)) - lgamma(k / 2.0))
    / ((1 - u) * (1 - u)) END), 6) FROM {_NODES})"""


def _with_p_sql(sql, stat):
    """The SQL of a chi-square statistic (columns ``stat``, df) with its p-value."""
    return f"SELECT {stat}, df, {_CHI2_P} AS p_value FROM (SELECT *, {stat} AS x, df AS k FROM (\n{sql}) q0) q1"


def anova_test(spark, root):
    return _tested(S.with_f_p(S.anova(_p2(spark, root), "r_name", "n_events")), "f_stat")


register("anova_test", f"""SELECT f_stat, df_between, df_within, {_F_P} AS p_value
FROM (SELECT *, df_between AS d1, df_within AS d2, df_within / (df_within + df_between * f_stat) AS x0 FROM (\n{ORACLE['anova']}) q0) q1""")(anova_test)


def kruskal(spark, root):
    k = S.kruskal(_p2(spark, root), "r_name", "n_events")
    return k.select(rnd("h_stat", 6).alias("h_stat"), "df")


register("kruskal", f"""WITH {P2_SQL},
r AS (SELECT r_name, CAST(n_events AS DOUBLE) AS v, {_avg_rank_sql('CAST(n_events AS DOUBLE)')} AS rk FROM p2),
t AS (SELECT sum(c * c * c - c) AS tt FROM (SELECT count(*) AS c FROM r GROUP BY v) x),
g AS (SELECT r_name, count(*) AS n, sum(rk) AS rr FROM r GROUP BY r_name),
s AS (SELECT sum(rr * rr / n) AS ss, CAST(sum(n) AS DOUBLE) AS nn, count(*) AS k FROM g)
SELECT round((12.0 / (nn * (nn + 1)) * ss - 3 * (nn + 1)) / (1 - tt / (nn * nn * nn - nn)), 6) AS h_stat,
       CAST(k - 1 AS BIGINT) AS df
FROM s CROSS JOIN t""")(kruskal)


def kruskal_test(spark, root):
    return _tested(S.with_chi2_p(S.kruskal(_p2(spark, root), "r_name", "n_events"), "h_stat", "df"), "h_stat")


register("kruskal_test", _with_p_sql(ORACLE["kruskal"], "h_stat"))(kruskal_test)


def chi2_gof(spark, root):
    c = S.chi2_gof(table(spark, root, "orders", ["o_orderpriority"]), "o_orderpriority")
    return c.select(rnd("chi2", 6).alias("chi2"), "df")


register("chi2_gof", """
WITH c AS (SELECT o_orderpriority, count(*) AS o FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority),
s AS (SELECT CAST(sum(o) AS DOUBLE) AS nn, count(*) AS k, CAST(sum(o * o) AS DOUBLE) AS s2 FROM c)
SELECT round(s2 / (nn / k) - nn, 6) AS chi2, CAST(k - 1 AS BIGINT) AS df FROM s""")(chi2_gof)


def chi2_gof_test(spark, root):
    return _tested(S.with_chi2_p(S.chi2_gof(table(spark, root, "orders", ["o_orderpriority"]), "o_orderpriority")), "chi2")


register("chi2_gof_test", _with_p_sql(ORACLE["chi2_gof"], "chi2"))(chi2_gof_test)


def chi2_independence(spark, root):
    c = S.chi2_independence(order_events(spark, root, with_qty=False), "r_name", "o_orderpriority")
    return c.select(rnd("chi2", 6).alias("chi2"), "df")


def _chi2_sql(src, a, b):
    return f"""
cell AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS ri FROM cell GROUP BY a), cb AS (SELECT b, sum(o) AS cj FROM cell GROUP BY b),
tot AS (SELECT CAST(sum(o) AS DOUBLE) AS nn, count(DISTINCT a) AS r, count(DISTINCT b) AS c, min(a) AS a1, min(b) AS b1 FROM cell),
x AS (SELECT cell.*, ri, cj, tot.* FROM cell JOIN ra USING (a) JOIN cb USING (b) CROSS JOIN tot),
s AS (SELECT sum(o * o / (ri * cj / nn)) AS ss, max(nn) AS nn, max(r) AS r, max(c) AS c,
             sum(CASE WHEN a = a1 AND b = b1 THEN o END) AS o11, max(CASE WHEN a = a1 THEN ri END) AS r1,
             max(CASE WHEN b = b1 THEN cj END) AS c1 FROM x)
SELECT round(CASE WHEN (r - 1) * (c - 1) = 1
  THEN greatest(abs(COALESCE(o11, 0) - r1 * c1 / nn) - 0.5, 0.0) * greatest(abs(COALESCE(o11, 0) - r1 * c1 / nn) - 0.5, 0.0)
       * nn * nn * nn / (r1 * (nn - r1) * c1 * (nn - c1))
  ELSE ss - nn END, 6) AS chi2, CAST((r - 1) * (c - 1) AS BIGINT) AS df FROM s"""


register("chi2_independence", f"WITH ev AS ({ORDER_EVENTS_SQL}), "
         + _chi2_sql("ev", "r_name", "o_orderpriority"))(chi2_independence)


def _two_by_two(spark, root):
    ev = order_events(spark, root, with_qty=False)
    return ev.select(F.when(F.col("o_orderstatus") == "F", "F").otherwise("other").alias("status"),
                     F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "urgent").otherwise("normal").alias("prio"))


def chi2_independence_2x2(spark, root):
    c = S.chi2_independence(_two_by_two(spark, root), "status", "prio", yates=True)
    return c.select(rnd("chi2", 6).alias("chi2"), "df")


register("chi2_independence_2x2", f"""WITH ev AS ({ORDER_EVENTS_SQL}),
t2 AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END AS status,
              CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'normal' END AS prio FROM ev), """
         + _chi2_sql("t2", "status", "prio"))(chi2_independence_2x2)


def chi2_independence_test(spark, root):
    return _tested(S.with_chi2_p(S.chi2_independence(order_events(spark, root, with_qty=False), "r_name", "o_orderpriority")), "chi2")


register("chi2_independence_test", _with_p_sql(ORACLE["chi2_independence"], "chi2"))(chi2_independence_test)


# --------------------------------------------------------------------------
# samples, splits and labels
# --------------------------------------------------------------------------

_SCR = f"(((o_orderkey % {FT.SCRAMBLE_MOD}) * {FT.SCRAMBLE_MUL}) % {FT.SCRAMBLE_MOD})"


def stable_sample(spark, root):
    o = table(spark, root, "orders", ["o_orderkey", "o_totalprice"])
    return FT.stable_sample(o, "o_orderkey", 2000)


register("stable_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_SCR}, o_orderkey LIMIT 2000")(stable_sample)


def hash_split(spark, root):
    o = table(spark, root, "orders", ["o_orderkey"])
    return FT.hash_split(o, "o_orderkey", 80)


register("hash_split", f"SELECT o_orderkey, CAST({_SCR} % 100 < 80 AS BIGINT) AS is_train FROM orders")(hash_split)


def temporal_split(spark, root):
    p = p1_panel(spark, root).select("c_custkey", "year")
    return FT.temporal_split(p, "year", 1998)


register("temporal_split", f"""WITH ev AS ({ORDER_EVENTS_SQL})
SELECT DISTINCT c_custkey, year, CAST(year <= 1998 AS BIGINT) AS is_train FROM ev""")(temporal_split)

TRAIN_LAST_MONTH = 1998 * 12 + 11


def _scored_p2(spark, root):
    return p2_panel(spark, root).withColumn("risk_score", weighted_score("n_events", "qty"))


def label_quantile(spark, root):
    lab = FT.label_train_quantile(_scored_p2(spark, root), "risk_score", "month_idx", TRAIN_LAST_MONTH, 0.75)
    return lab.select("n_name", "month_idx", rnd("risk_score", 6).alias("risk_score"),
                      rnd("threshold", 6).alias("threshold"), "label")


register("label_quantile", f"""WITH {P2_SQL},
s AS (SELECT n_name, month_idx, n_events + 0.5 * qty AS risk_score FROM p2),
t AS (SELECT quantile_cont(risk_score, 0.75) AS threshold FROM s WHERE month_idx <= {TRAIN_LAST_MONTH})
SELECT n_name, month_idx, round(risk_score, 6) AS risk_score, round(threshold, 6) AS threshold,
       CAST(COALESCE(risk_score >= threshold, false) AS BIGINT) AS label FROM s CROSS JOIN t""")(label_quantile)


def label_median(spark, root):
    lab = FT.label_median(_scored_p2(spark, root), "risk_score")
    return lab.select("n_name", "month_idx", rnd("threshold", 6).alias("threshold"), "label")


register("label_median", f"""WITH {P2_SQL},
s AS (SELECT n_name, month_idx, n_events + 0.5 * qty AS risk_score FROM p2),
t AS (SELECT median(risk_score) AS threshold FROM s)
SELECT n_name, month_idx, round(threshold, 6) AS threshold,
       CAST(COALESCE(risk_score > threshold, false) AS BIGINT) AS label FROM s CROSS JOIN t""")(label_median)
