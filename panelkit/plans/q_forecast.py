"""Catalogue, part 8: series forecasting.

The single global series of the reference is re-aimed to one series per
nation (monthly order counts, gaps filled with 0)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import features as FT
from ..operators import forecast as FC
from ..operators.panel import fill_gaps_zero
from .q_describe import P2_SQL
from .registry import register
from .roles import p2_panel


def series_totals(spark, root):
    p = p2_panel(spark, root).select("n_name", "month_idx", F.col("n_events").cast("double").alias("total"))
    return fill_gaps_zero(p, "n_name", "month_idx", "total")


def supervised(spark, root):
    return FT.supervised_lag1(series_totals(spark, root), "n_name", "month_idx", "total")


_SERIES_SQL = f"""{P2_SQL},
b AS (SELECT n_name, min(month_idx) AS lo, max(month_idx) AS hi FROM p2 GROUP BY n_name),
g AS (SELECT n_name, CAST(unnest(range(lo, hi + 1)) AS BIGINT) AS month_idx FROM b),
st AS (SELECT g.n_name, g.month_idx, CAST(COALESCE(p2.n_events, 0) AS DOUBLE) AS total
       FROM g LEFT JOIN p2 ON g.n_name = p2.n_name AND g.month_idx = p2.month_idx),
sup AS (SELECT * FROM (SELECT n_name, month_idx, lag(total) OVER (PARTITION BY n_name ORDER BY month_idx) AS lag1,
                              total AS y FROM st) t WHERE lag1 IS NOT NULL)"""


def lag_supervised(spark, root):
    return supervised(spark, root)


register("lag_supervised", f"WITH {_SERIES_SQL} SELECT n_name, month_idx, lag1, y FROM sup")(lag_supervised)


def walk_forward_lag1(spark, root):
    b = FC.naive_backtest(supervised(spark, root), "n_name", "month_idx", "y", (1, 5, 10))
    return b.select("n_name", F.col("horizon").cast("int").alias("horizon"), rnd("rmse", 6).alias("rmse"),
                    "anchors_used")


register("walk_forward_lag1", f"""WITH {_SERIES_SQL},
f AS (SELECT n_name, min(month_idx) AS first FROM sup GROUP BY n_name),
a AS (SELECT s.n_name, s.month_idx AS anchor, s.y AS y0, h.horizon FROM sup s JOIN f USING (n_name)
      CROSS JOIN (VALUES (1), (5), (10)) AS h(horizon) WHERE s.month_idx >= f.first + 7)
SELECT a.n_name, CAST(a.horizon AS INTEGER) AS horizon, round(sqrt(avg((t.y - a.y0) * (t.y - a.y0))), 6) AS rmse,
       CAST(count(*) AS BIGINT) AS anchors_used
FROM a JOIN sup t ON t.n_name = a.n_name AND t.month_idx = a.anchor + a.horizon
GROUP BY a.n_name, a.horizon""")(walk_forward_lag1)


def _ols_sql(x1, x2, src):
    return f"""SELECT n_name, b1, b2, my - b1 * m1 - b2 * m2 AS b0, n FROM (
  SELECT *, (s22 * s1y - s12 * s2y) / NULLIF(s11 * s22 - s12 * s12, 0) AS b1,
            (s11 * s2y - s12 * s1y) / NULLIF(s11 * s22 - s12 * s12, 0) AS b2 FROM (
    SELECT n_name, var_pop({x1}) AS s11, var_pop({x2}) AS s22, covar_pop({x1}, {x2}) AS s12,
           covar_pop({x1}, y) AS s1y, covar_pop({x2}, y) AS s2y, avg({x1}) AS m1, avg({x2}) AS m2, avg(y) AS my,
           CAST(count(*) AS BIGINT) AS n FROM {src} GROUP BY n_name) a) b"""


def ols(spark, root):
    """Y ~ lag1 + period per series."""
    o = FC.ols2(supervised(spark, root).withColumn("t", F.col("month_idx").cast("double")), "n_name", "y", "lag1", "t")
    return o.select("n_name", rnd("b0", 4).alias("b0"), rnd("b1", 6).alias("b1"), rnd("b2", 6).alias("b2"), "n")


register("ols", f"""WITH {_SERIES_SQL}, s2 AS (SELECT *, CAST(month_idx AS DOUBLE) AS t FROM sup),
o AS ({_ols_sql('lag1', 't', 's2')})
SELECT n_name, round(b0, 4) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, n FROM o""")(ols)


def trend_models(spark, root):
    """Linear trend and quadratic trend on the centred period."""
    st = series_totals(spark, root)
    c = st.groupBy("n_name").agg(F.avg("month_idx").alias("__c"))
    x = st.join(c, "n_name").withColumn("tc", F.col("month_idx") - F.col("__c")).withColumn("tc2", F.col("tc") * F.col("tc"))
    lin = st.groupBy("n_name").agg(F.regr_slope("total", "month_idx").alias("lin_slope"),
                                   F.regr_intercept("total", "month_idx").alias("lin_intercept"))
    quad = FC.ols2(x.withColumnRenamed("total", "y"), "n_name", "y", "tc", "tc2")
    out = lin.join(quad.join(c, "n_name"), "n_name")
    return out.select("n_name", rnd("lin_slope", 6).alias("lin_slope"), rnd("lin_intercept", 2).alias("lin_intercept"),
                      rnd("b0", 4).alias("q_b0"), rnd("b1", 6).alias("q_b1"), rnd("b2", 8).alias("q_b2"),
                      rnd("__c", 4).alias("center"))


register("trend_models", f"""WITH {_SERIES_SQL},
c AS (SELECT n_name, avg(month_idx) AS cc FROM st GROUP BY n_name),
x AS (SELECT st.n_name, st.total AS y, month_idx - cc AS tc, (month_idx - cc) * (month_idx - cc) AS tc2 FROM st JOIN c USING (n_name)),
lin AS (SELECT n_name, regr_slope(total, month_idx) AS lin_slope, regr_intercept(total, month_idx) AS lin_intercept FROM st GROUP BY n_name),
q AS ({_ols_sql('tc', 'tc2', 'x')})
SELECT lin.n_name, round(lin_slope, 6) AS lin_slope, round(lin_intercept, 2) AS lin_intercept, round(q.b0, 4) AS q_b0,
       round(q.b1, 6) AS q_b1, round(q.b2, 8) AS q_b2, round(c.cc, 4) AS center
FROM lin JOIN q USING (n_name) JOIN c USING (n_name)""")(trend_models)

RIDGE_ALPHA = 10.0


def ridge(spark, root):
    """M15 (fixed penalty): standardised ridge on (lag1, period) per series."""
    r = FC.ridge2(supervised(spark, root).withColumn("t", F.col("month_idx").cast("double")), "n_name", "y", "lag1", "t",
                  RIDGE_ALPHA)
    return r.select("n_name", rnd("b0", 4).alias("b0"), rnd("b1", 6).alias("b1"), rnd("b2", 6).alias("b2"), "n")


register("ridge", f"""WITH {_SERIES_SQL}, s2 AS (SELECT *, CAST(month_idx AS DOUBLE) AS t FROM sup),
a AS (SELECT n_name, var_pop(lag1) AS v1, var_pop(t) AS v2, covar_pop(lag1, t) AS c12, covar_pop(lag1, y) AS c1y,
             covar_pop(t, y) AS c2y, avg(lag1) AS m1, avg(t) AS m2, avg(y) AS my, CAST(count(*) AS DOUBLE) AS nn FROM s2 GROUP BY n_name),
gg AS (SELECT *, nn + {RIDGE_ALPHA} AS g11, nn + {RIDGE_ALPHA} AS g22, nn * (c12 / NULLIF(sqrt(v1) * sqrt(v2), 0)) AS g12,
             nn * (c1y / NULLIF(sqrt(v1), 0)) AS r1, nn * (c2y / NULLIF(sqrt(v2), 0)) AS r2 FROM a),
w AS (SELECT *, (g22 * r1 - g12 * r2) / NULLIF(g11 * g22 - g12 * g12, 0) / NULLIF(sqrt(v1), 0) AS b1,
             (g11 * r2 - g12 * r1) / NULLIF(g11 * g22 - g12 * g12, 0) / NULLIF(sqrt(v2), 0) AS b2 FROM gg)
SELECT n_name, round(my - b1 * m1 - b2 * m2, 4) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, CAST(nn AS BIGINT) AS n
FROM w""")(ridge)


def iterative_forecast(spark, root):
    """OLS lag model per series iterated 1, 5 and 10 steps past the
    last observed period."""
    sup = supervised(spark, root).withColumn("t", F.col("month_idx").cast("double"))
    o = FC.ols2(sup, "n_name", "y", "lag1", "t")
    last = sup.groupBy("n_name").agg(F.max_by("y", "month_idx").alias("y_last"), F.max("month_idx").alias("t_last"))
    x = o.join(last, "n_name").withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))
    x = x.withColumn("forecast", FC.iterate_linear("b0", "b1", "b2", "y_last", F.col("t_last").cast("double"),
                                                   F.col("horizon")))
    return x.select("n_name", "horizon", (F.col("t_last") + F.col("horizon")).alias("target_period"),
                    rnd("forecast", 4).alias("forecast"))


register("iterative_forecast", f"""WITH {_SERIES_SQL}, s2 AS (SELECT *, CAST(month_idx AS DOUBLE) AS t FROM sup),
o AS ({_ols_sql('lag1', 't', 's2')}),
l AS (SELECT n_name, arg_max(y, month_idx) AS y_last, max(month_idx) AS t_last FROM s2 GROUP BY n_name),
x AS (SELECT o.*, l.y_last, l.t_last, h.horizon FROM o JOIN l USING (n_name) CROSS JOIN (VALUES (1), (5), (10)) AS h(horizon))
SELECT n_name, CAST(horizon AS INTEGER) AS horizon, t_last + horizon AS target_period,
       round(pow(b1, horizon) * y_last + (SELECT sum(pow(b1, horizon - k) * (b0 + b2 * (t_last + k)))
                                          FROM range(1, horizon + 1) r(k)), 4) AS forecast
FROM x""")(iterative_forecast)


def backtest_lag1(spark, root):
    """Walk-forward ridge (penalty by leave-one-out) backtest."""
    b = FC.ridge_backtest(supervised(spark, root), "n_name", "month_idx", (1, 5, 10))
    return b.select(F.col("series").alias("n_name"), "horizon", rnd("rmse", 6).alias("rmse"), "anchors_used")


# every training row of every anchor under every penalty, written out
register("backtest_lag1", f"""WITH {_SERIES_SQL},
f AS (SELECT n_name, min(month_idx) + 2 AS start FROM sup GROUP BY n_name),
tr AS (SELECT a.n_name, a.month_idx AS anchor, s.lag1 AS x1, CAST(s.month_idx AS DOUBLE) AS x2, s.y
       FROM sup a JOIN f USING (n_name) JOIN sup s ON s.n_name = a.n_name AND s.month_idx >= f.start AND s.month_idx < a.month_idx
       WHERE a.month_idx >= f.start + 5),
ms AS (SELECT n_name, anchor, CAST(count(*) AS DOUBLE) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, COALESCE(NULLIF(stddev_pop(x1), 0), 1) AS d1,
              COALESCE(NULLIF(stddev_pop(x2), 0), 1) AS d2 FROM tr GROUP BY n_name, anchor HAVING count(*) >= 5),
z AS (SELECT tr.n_name, tr.anchor, n, (x1 - m1) / d1 AS z1, (x2 - m2) / d2 AS z2, y - my AS v FROM tr JOIN ms ON tr.n_name = ms.n_name AND tr.anchor = ms.anchor),
gm AS (SELECT n_name, anchor, sum(z1 * z1) AS g11, sum(z2 * z2) AS g22, sum(z1 * z2) AS g12, sum(z1 * v) AS r1, sum(z2 * v) AS r2 FROM z GROUP BY n_name, anchor),
w AS (SELECT *, ((g22 + a) * r1 - g12 * r2) / det AS w1, ((g11 + a) * r2 - g12 * r1) / det AS w2, (g22 + a) / det AS i11, (g11 + a) / det AS i22, -g12 / det AS i12
      FROM (SELECT gm.*, a, (g11 + a) * (g22 + a) - g12 * g12 AS det FROM gm CROSS JOIN (SELECT pow(10, -3 + 9 * k / 29.0) AS a FROM range(0, 30) r(k)) al) t),
e AS (SELECT w.n_name, w.anchor, a, any_value(w1) AS w1, any_value(w2) AS w2,
             sum(pow((v - w1 * z1 - w2 * z2) / (1 - 1 / n - i11 * z1 * z1 - 2 * i12 * z1 * z2 - i22 * z2 * z2), 2)) AS err
      FROM w JOIN z ON z.n_name = w.n_name AND z.anchor = w.anchor GROUP BY w.n_name, w.anchor, a),
bs AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY n_name, anchor ORDER BY err, a) = 1),
c AS (SELECT bs.n_name, bs.anchor, s.y AS y0, w1 / d1 AS b1, w2 / d2 AS b2, my - w1 / d1 * m1 - w2 / d2 * m2 AS b0
      FROM bs JOIN ms ON ms.n_name = bs.n_name AND ms.anchor = bs.anchor JOIN sup s ON s.n_name = bs.n_name AND s.month_idx = bs.anchor),
p AS (SELECT c.n_name, h.horizon, t.y, pow(b1, h.horizon) * y0 + (SELECT sum(pow(b1, h.horizon - k) * (b0 + b2 * (anchor + k))) FROM range(1, h.horizon + 1) r(k)) AS pred
      FROM c CROSS JOIN (VALUES (1), (5), (10)) AS h(horizon) JOIN sup t ON t.n_name = c.n_name AND t.month_idx = c.anchor + h.horizon)
SELECT n_name, CAST(horizon AS INTEGER) AS horizon, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, CAST(count(*) AS BIGINT) AS anchors_used
FROM p GROUP BY n_name, horizon""")(backtest_lag1)
