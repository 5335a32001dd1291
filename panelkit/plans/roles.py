"""Role mapping of the driver tables onto the panel model.

* P1 (main panel): event = order, entity = customer, period = order year,
  group = region, cat1/cat2/cat3 = order priority / market segment / order
  status, count = orders, severity1 = order total price, severity2 = order
  quantity (line quantities summed per order *before* the join, so an
  order's amount is never repeated per line).
* P2 (dense panel): same events, entity = nation name, period = month index
  ``year * 12 + month - 1``.
* P3 (stream-like): ``events``, entity = user, period = day.

Reference series are (nation, period) aggregates of ``lineitem`` joined to
``supplier``. Dirty inputs are derived by fixed integer rules on keys so the
Spark side and the SQL oracle derive exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import event_panel
from ..session import built_once
from ..sources.readers import table

MONTH_INDEX_SQL = "(year({c}) * 12 + month({c}) - 1)"


def month_index(c: str) -> F.Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("bigint")


def order_qty(spark: SparkSession, root: str) -> DataFrame:
    """Quantity per order (pre-aggregated, unique on l_orderkey)."""
    li = table(spark, root, "lineitem", ["l_orderkey", "l_quantity"])
    return li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("o_qty"))


def geo(spark: SparkSession, root: str) -> DataFrame:
    """nation + region; the planner broadcasts them by their bytes."""
    n = table(spark, root, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = table(spark, root, "region", ["r_regionkey", "r_name"])
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


def order_events(spark: SparkSession, root: str, with_qty: bool = True) -> DataFrame:
    """One row per order with customer, nation and region attributes."""
    o = table(spark, root, "orders", ["o_orderkey", "o_custkey", "o_orderstatus",
                                       "o_totalprice", "o_orderdate", "o_orderpriority"])
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    ev = o.join(c, o.o_custkey == c.c_custkey)
    ev = ev.join(geo(spark, root), ev.c_nationkey == F.col("n_nationkey"))
    if with_qty:
        ev = ev.join(order_qty(spark, root), ev.o_orderkey == F.col("l_orderkey"), "left")
    cols = ["o_orderkey", "c_custkey", "n_nationkey", "n_name", "r_name", "o_orderpriority",
            "c_mktsegment", "o_orderstatus", "o_totalprice", "o_orderdate"]
    ev = ev.select(*cols, *(["o_qty"] if with_qty else []))
    return ev.withColumns({"year": F.year("o_orderdate").cast("bigint"),
                           "month_idx": month_index("o_orderdate")})


# SQL text of the same event table for the oracle.
ORDER_EVENTS_SQL = """
SELECT o.o_orderkey, c.c_custkey, n.n_nationkey, n.n_name, r.r_name, o.o_orderpriority,
       c.c_mktsegment, o.o_orderstatus, o.o_totalprice, o.o_orderdate, q.o_qty,
       CAST(year(o.o_orderdate) AS BIGINT) AS year,
       CAST(year(o.o_orderdate) * 12 + month(o.o_orderdate) - 1 AS BIGINT) AS month_idx
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS o_qty FROM lineitem GROUP BY l_orderkey) q
  ON o.o_orderkey = q.l_orderkey
"""


def p1_panel(spark: SparkSession, root: str) -> DataFrame:
    """(customer, year) panel with count, two sums and modes."""
    return built_once(spark, ("p1", root), lambda: event_panel(
        order_events(spark, root), "c_custkey", "year", count_col="n_events",
        sums={"amount": "o_totalprice", "qty": "o_qty"},
        modes={"cat1_mode": "o_orderpriority", "cat3_mode": "o_orderstatus"},
        constants={"r_name": "r_name", "n_nationkey": "n_nationkey", "cat2_mode": "c_mktsegment"}))


def p2_panel(spark: SparkSession, root: str) -> DataFrame:
    """(nation, month) panel."""
    return built_once(spark, ("p2", root), lambda: event_panel(
        order_events(spark, root), "n_name", "month_idx", count_col="n_events",
        sums={"amount": "o_totalprice", "qty": "o_qty"}, distincts={"n_customers": "c_custkey"},
        modes={"cat1_mode": "o_orderpriority", "cat2_mode": "c_mktsegment", "cat3_mode": "o_orderstatus"},
        constants={"r_name": "r_name"}))


def supply_series(spark: SparkSession, root: str, period: str = "year") -> DataFrame:
    """Reference series: shipped value per (supplier nation, ship period),
    unique on its key."""
    li = table(spark, root, "lineitem", ["l_suppkey", "l_extendedprice", "l_quantity",
                                         "l_returnflag", "l_shipdate"])
    s = table(spark, root, "supplier", ["s_suppkey", "s_nationkey"])
    x = li.join(s, li.l_suppkey == s.s_suppkey)
    p = F.year("l_shipdate").cast("bigint") if period == "year" else month_index("l_shipdate")
    return (x.withColumn(period, p).groupBy(F.col("s_nationkey").alias("n_nationkey"), period)
             .agg(F.sum("l_extendedprice").alias("supply_value"),
                  F.count(F.lit(1)).alias("supply_lines")))


def dirty_orders(spark: SparkSession, root: str) -> DataFrame:
    """Order events with rule-derived dirt: padded names, text periods with
    junk, missing and non-numeric measures, sentinel categories."""
    ev = order_events(spark, root)
    k = F.col("o_orderkey")
    null_s = F.lit(None).cast("string")
    return ev.select(
        "o_orderkey", "c_custkey",
        F.when(k % 17 == 0, null_s).otherwise(F.concat(F.lit("  "), "n_name", F.lit("\t"))).alias("entity_txt"),
        F.when(k % 19 == 0, F.concat(F.lit("x"), F.col("year").cast("string")))
         .when(k % 7 == 0, F.concat(F.col("year").cast("string"), F.lit(".0")))
         .otherwise(F.col("year").cast("string")).alias("period_txt"),
        F.when(k % 11 == 0, null_s).when(k % 23 == 0, F.lit("n/a"))
         .otherwise(F.col("o_totalprice").cast("string")).alias("sev1_txt"),
        F.when(k % 13 == 0, null_s).otherwise(F.col("o_qty").cast("string")).alias("sev2_txt"),
        F.concat(F.lit(" "), "r_name").alias("group_txt"),
        F.col("o_orderpriority").alias("cat1_txt"),
        F.when(k % 13 == 0, F.lit("Unknown")).when(k % 29 == 0, F.lit(""))
         .when(k % 31 == 0, F.lit("UNKNOWN ")).otherwise(F.col("o_orderstatus")).alias("cat3_txt"),
    )


DIRTY_ORDERS_SQL = f"""
SELECT o_orderkey, c_custkey,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE '  ' || n_name || chr(9) END AS entity_txt,
  CASE WHEN o_orderkey % 19 = 0 THEN 'x' || CAST(year AS VARCHAR)
       WHEN o_orderkey % 7 = 0 THEN CAST(year AS VARCHAR) || '.0'
       ELSE CAST(year AS VARCHAR) END AS period_txt,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'n/a'
       ELSE CAST(o_totalprice AS VARCHAR) END AS sev1_txt,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_qty AS VARCHAR) END AS sev2_txt,
  ' ' || r_name AS group_txt, o_orderpriority AS cat1_txt,
  CASE WHEN o_orderkey % 13 = 0 THEN 'Unknown' WHEN o_orderkey % 29 = 0 THEN ''
       WHEN o_orderkey % 31 = 0 THEN 'UNKNOWN ' ELSE o_orderstatus END AS cat3_txt
FROM ({ORDER_EVENTS_SQL}) ev
"""


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
