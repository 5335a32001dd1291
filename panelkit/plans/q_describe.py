"""Catalogue, part 3: descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import describe as D
from ..operators import windows as W
from ..sources.readers import table
from .q_build import P1_SQL, joined_panel, JOINED_SQL
from .registry import register
from .roles import ORDER_EVENTS_SQL, order_events, p1_panel, p2_panel

P2_SQL = f"""
ev AS ({ORDER_EVENTS_SQL}),
p2 AS (SELECT n_name, month_idx, count(*) AS n_events, COALESCE(sum(o_totalprice), 0) AS amount,
              COALESCE(sum(o_qty), 0) AS qty, count(DISTINCT c_custkey) AS n_customers, min(r_name) AS r_name
       FROM ev GROUP BY n_name, month_idx)
"""


def entity_totals(spark, root):
    return D.totals_by(p2_panel(spark, root), "n_name", "n_events", "total_events")


register("entity_totals", f"""WITH {P2_SQL}
SELECT n_name, CAST(sum(n_events) AS BIGINT) AS total_events FROM p2 GROUP BY n_name""")(entity_totals)


def group_means(spark, root):
    m = D.means_by(p1_panel(spark, root), "r_name", "amount", "mean_amount")
    return m.select("r_name", rnd("mean_amount", 6).alias("mean_amount"))


register("group_means", f"""WITH {P1_SQL}
SELECT r_name, round(avg(amount), 6) AS mean_amount FROM p1 GROUP BY r_name""")(group_means)


def top10_entities(spark, root):
    t = D.totals_by(p1_panel(spark, root), "c_custkey", "n_events", "total_events")
    return D.top_k(t, [F.col("total_events").desc(), F.col("c_custkey")], 10)


register("top10_entities", f"""WITH {P1_SQL}
SELECT c_custkey, CAST(sum(n_events) AS BIGINT) AS total_events FROM p1 GROUP BY c_custkey
ORDER BY total_events DESC, c_custkey LIMIT 10""")(top10_entities)


def category_share(spark, root):
    ev = order_events(spark, root, with_qty=False).withColumn("one", F.lit(1))
    return D.share_of_total(ev, "o_orderpriority", "one", places=1) \
        .select("o_orderpriority", F.col("total").cast("bigint").alias("n_events"), "share_pct")


register("category_share", f"""WITH ev AS ({ORDER_EVENTS_SQL})
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_events,
       round(count(*) * 100.0 / (SELECT count(*) FROM ev), 1) AS share_pct
FROM ev GROUP BY o_orderpriority""")(category_share)


def frequency(spark, root):
    return D.frequency(table(spark, root, "orders", ["o_orderstatus"]), "o_orderstatus")


register("frequency", """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus""")(frequency)


SUMMARY_COLS = ["n_events", "amount", "qty"]


def summary_stats(spark, root):
    p = p2_panel(spark, root).withColumn("n_events", F.col("n_events").cast("double"))
    return D.summary_stats(p, SUMMARY_COLS)


register("summary_stats", f"WITH {P2_SQL}\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, "
    f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
    f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM p2" for c in SUMMARY_COLS))(summary_stats)


def driver_table(spark, root):
    return D.driver_table(joined_panel(spark, root), "r_name", "n_events", "conflict_level")


register("driver_table", f"""WITH {JOINED_SQL.replace("SELECT p.n_name, p.month_idx,", "SELECT p.n_name, p.month_idx, p.r_name,")}
SELECT r_name, CAST(count(*) AS BIGINT) AS n, round(avg(n_events), 6) AS mean_y, round(median(n_events), 6) AS median_y,
       round(avg(conflict_level), 6) AS mean_level, round(count(*) * 100.0 / (SELECT count(*) FROM j), 6) AS share_pct
FROM j GROUP BY r_name""")(driver_table)


def _month_totals(spark, root):
    return p2_panel(spark, root).groupBy("month_idx").agg(F.sum("n_events").cast("double").alias("total"))


def period_totals_growth(spark, root):
    t = _month_totals(spark, root)
    # one row per period: a window without a partition key is bounded by the
    # number of periods here
    return t.select("month_idx", "total", rnd(W.growth("total", None, "month_idx"), 6).alias("growth"))


MT_SQL = f"""{P2_SQL}, mt AS (SELECT month_idx, CAST(sum(n_events) AS DOUBLE) AS total FROM p2 GROUP BY month_idx)"""
register("period_totals_growth", f"""WITH {MT_SQL}
SELECT month_idx, total,
       round((total - lag(total) OVER (ORDER BY month_idx)) / NULLIF(lag(total) OVER (ORDER BY month_idx), 0), 6) AS growth
FROM mt""")(period_totals_growth)


def rolling3_trailing(spark, root):
    p = p2_panel(spark, root)
    return p.select("n_name", "month_idx",
                    rnd(W.trailing_mean("n_events", "n_name", "month_idx", 3, 3), 6).alias("roll3"))


register("rolling3_trailing", f"""WITH {P2_SQL}
SELECT n_name, month_idx,
  round(CASE WHEN count(n_events) OVER w >= 3 THEN avg(n_events) OVER w END, 6) AS roll3
FROM p2 WINDOW w AS (PARTITION BY n_name ORDER BY month_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")(rolling3_trailing)


def rolling3_total(spark, root):
    t = _month_totals(spark, root)
    return t.select("month_idx", rnd(W.trailing_mean("total", None, "month_idx", 3, 1), 6).alias("roll3"))


register("rolling3_total", f"""WITH {MT_SQL}
SELECT month_idx, round(avg(total) OVER (ORDER BY month_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS roll3
FROM mt""")(rolling3_total)


def rolling3_past(spark, root):
    p = p2_panel(spark, root)
    return p.select("n_name", "month_idx",
                    rnd(W.past_mean("n_events", "n_name", "month_idx", 3, 2, default=None), 6).alias("past3"))


register("rolling3_past", f"""WITH {P2_SQL}
SELECT n_name, month_idx,
  round(CASE WHEN count(n_events) OVER w >= 2 THEN avg(n_events) OVER w END, 6) AS past3
FROM p2 WINDOW w AS (PARTITION BY n_name ORDER BY month_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")(rolling3_past)


def _top_nations(ev, k=10):
    t = ev.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    return D.top_k(t, [F.col("n").desc(), F.col("n_name")], k).select("n_name")


# The years of the order table (the pivot's column list; an order
# of another year fails the job).
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


def pivot_entity_period(spark, root):
    """Orders of the ten largest nations by year, largest nation first."""
    ev = order_events(spark, root, with_qty=False).withColumn("one", F.lit(1.0))
    p = D.pivot_wide(ev.join(_top_nations(ev), "n_name", "left_semi"), "n_name", "year", "one", values=YEARS, fill=0.0)
    total = sum((F.col(f"`{y}`") for y in YEARS[1:]), F.col(f"`{YEARS[0]}`"))
    return p.withColumn("total", total).orderBy(F.col("total").desc(), "n_name")


register("pivot_entity_period", f"""WITH ev AS ({ORDER_EVENTS_SQL}),
top AS (SELECT n_name FROM ev GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 10)
SELECT n_name, """ + ", ".join(f"CAST(count(*) FILTER (WHERE year = {y}) AS DOUBLE) AS \"{y}\"" for y in YEARS)
    + """, CAST(count(*) AS DOUBLE) AS total
FROM ev WHERE n_name IN (SELECT n_name FROM top) GROUP BY n_name
ORDER BY total DESC, n_name""")(pivot_entity_period)


# The five region names of the star schema (the pivot's column list).
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def pivot_period_group(spark, root):
    ev = order_events(spark, root, with_qty=False)
    p = D.pivot_wide(ev, "year", "r_name", "o_totalprice", values=REGIONS, fill=0.0)
    return p.select("year", *[rnd(F.col(f"`{r}`"), 2).alias(r) for r in REGIONS])


register("pivot_period_group", f"""WITH ev AS ({ORDER_EVENTS_SQL})
SELECT year, """ + ", ".join(
    f"round(COALESCE(sum(o_totalprice) FILTER (WHERE r_name = '{r}'), 0), 2) AS \"{r}\"" for r in REGIONS)
    + " FROM ev GROUP BY year")(pivot_period_group)


def crosstab(spark, root):
    return D.crosstab_long(order_events(spark, root, with_qty=False), "r_name", "o_orderpriority")


register("crosstab", f"""WITH ev AS ({ORDER_EVENTS_SQL})
SELECT r_name, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY r_name, o_orderpriority""")(crosstab)


def histogram50(spark, root):
    h = D.histogram(table(spark, root, "orders", ["o_totalprice"]), "o_totalprice", 50)
    return h.select("bin", rnd("lo", 6).alias("lo"), rnd("hi", 6).alias("hi"), "n")


register("histogram50", """
WITH v AS (SELECT CAST(o_totalprice AS DOUBLE) AS v FROM orders WHERE o_totalprice IS NOT NULL),
mm AS (SELECT min(v) AS mn, max(v) AS mx FROM v),
b AS (SELECT CAST(COALESCE(least(49, floor((v - mn) * (50.0 / NULLIF(mx - mn, 0)))), 0) AS INTEGER) AS bin, mn, mx
      FROM v CROSS JOIN mm),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(r.bin AS INTEGER) AS bin, round(mn + r.bin * ((mx - mn) / 50), 6) AS lo,
       round(mn + (r.bin + 1) * ((mx - mn) / 50), 6) AS hi, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM mm CROSS JOIN range(50) r(bin) LEFT JOIN c ON c.bin = r.bin WHERE mn IS NOT NULL""")(histogram50)


def trend(spark, root):
    t = D.trend(p2_panel(spark, root), "n_events", "month_idx", by="n_name")
    return t.select("n_name", rnd("slope", 6).alias("slope"), rnd("intercept", 4).alias("intercept"),
                    F.col("n_points").cast("bigint").alias("n_points"))


register("trend", f"""WITH {P2_SQL}
SELECT n_name, round(regr_slope(n_events, month_idx), 6) AS slope, round(regr_intercept(n_events, month_idx), 4) AS intercept,
       CAST(regr_count(n_events, month_idx) AS BIGINT) AS n_points
FROM p2 GROUP BY n_name""")(trend)


def entity_profile(spark, root):
    e = D.entity_profile(p1_panel(spark, root), "c_custkey", "year", "n_events", "amount", 3)
    return e.select("c_custkey", rnd("mean_count", 6).alias("mean_count"),
                    rnd("mean_severity", 4).alias("mean_severity"), rnd("count_slope", 6).alias("count_slope"))


register("entity_profile", f"""WITH {P1_SQL}
SELECT c_custkey, mean_count, mean_severity,
       CASE WHEN slope_r = 0 THEN 0.0 ELSE slope_r END AS count_slope  -- no negative zero
FROM (SELECT c_custkey, round(avg(n_events), 6) AS mean_count, round(avg(amount), 4) AS mean_severity,
       round(CASE WHEN count(n_events) < 3 THEN 0.0 ELSE COALESCE(regr_slope(n_events, year), 0.0) END, 6) AS slope_r
FROM p1 GROUP BY c_custkey) t""")(entity_profile)
