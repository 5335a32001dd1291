"""Catalogue, part 1: building the panel (sources, cleaning, harmonising,
aggregation, joins, flags, diagnostics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import ordinal_bucket, rnd, tier, weighted_score
from ..functions.text import coerce_double, coerce_long, is_entity_code, norm_key, strip_ws
from ..operators import clean
from ..operators.harmonize import apply_mapping
from ..operators.panel import event_panel, first_non_null, left_join_chain
from ..operators.quality import panel_diagnostics
from ..operators.stats import exact_quantiles
from ..session import built_once
from ..sources.readers import load_mapping, table
from .registry import register
from .roles import ORDER_EVENTS_SQL, order_events, p1_panel, p2_panel, supply_series, month_index


# --------------------------------------------------------------------------
# flagship: totals by group from a freshly built panel
# --------------------------------------------------------------------------

def flagship(spark, root):
    panel = p1_panel(spark, root)
    sup = supply_series(spark, root, "year")
    j = left_join_chain(panel, ["n_nationkey", "year"], [sup])
    out = (j.groupBy("r_name")
             .agg(F.count(F.lit(1)).alias("panel_rows"),
                  F.sum("n_events").alias("total_events"),
                  rnd(F.sum("amount"), 2).alias("total_amount"),
                  rnd(F.sum("qty"), 2).alias("total_qty"),
                  rnd(F.avg(F.col("supply_value").isNotNull().cast("double")), 6).alias("supply_match_rate")))
    return out.orderBy(F.col("total_events").desc(), "r_name")


register("flagship_group_totals", f"""
WITH ev AS ({ORDER_EVENTS_SQL}),
panel AS (
  SELECT c_custkey, year, count(*) AS n_events, sum(o_totalprice) AS amount, sum(o_qty) AS qty,
         min(r_name) AS r_name, min(n_nationkey) AS n_nationkey
  FROM ev GROUP BY c_custkey, year),
sup AS (
  SELECT s.s_nationkey AS n_nationkey, CAST(year(l.l_shipdate) AS BIGINT) AS year,
         sum(l.l_extendedprice) AS supply_value
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)
SELECT p.r_name, CAST(count(*) AS BIGINT) AS panel_rows, CAST(sum(n_events) AS BIGINT) AS total_events,
       round(sum(amount), 2) AS total_amount, round(sum(qty), 2) AS total_qty,
       round(avg(CASE WHEN s.supply_value IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS supply_match_rate
FROM panel p LEFT JOIN sup s ON p.n_nationkey = s.n_nationkey AND p.year = s.year
GROUP BY p.r_name ORDER BY total_events DESC, r_name LIMIT 10
""")(flagship)


# --------------------------------------------------------------------------
# clean_events: strip, coerce, drop null keys, fill, sentinels
# --------------------------------------------------------------------------

from .roles import DIRTY_ORDERS_SQL, dirty_orders, strip_sql  # noqa: E402
from .sqlkit import mode_cte  # noqa: E402


def cleaned_orders(spark, root):
    d = clean.rename(dirty_orders(spark, root), {"entity_txt": "entity", "period_txt": "period",
                                                 "sev1_txt": "sev1", "sev2_txt": "sev2",
                                                 "group_txt": "grp", "cat1_txt": "cat1", "cat3_txt": "cat3"})
    d = clean.clean_events(d, text_cols=["entity", "grp", "cat1"], numeric_cols=["sev1", "sev2"],
                           key_text="entity", key_num="period", category_cols=["cat3"])
    return clean.conform(d, ["o_orderkey", "c_custkey", "entity", "period", "grp", "sev1", "sev2", "cat1", "cat3"])


CLEAN_SQL = f"""
SELECT o_orderkey, c_custkey, {strip_sql('entity_txt')} AS entity,
       CAST(TRY_CAST(period_txt AS DOUBLE) AS BIGINT) AS period,
       {strip_sql('group_txt')} AS grp,
       COALESCE(TRY_CAST(sev1_txt AS DOUBLE), 0.0) AS sev1,
       COALESCE(TRY_CAST(sev2_txt AS DOUBLE), 0.0) AS sev2,
       {strip_sql('cat1_txt')} AS cat1,
       COALESCE(CASE WHEN lower({strip_sql('cat3_txt')}) IN ('unknown', '') THEN NULL
                     ELSE {strip_sql('cat3_txt')} END, 'N/A') AS cat3
FROM ({DIRTY_ORDERS_SQL}) d
WHERE entity_txt IS NOT NULL AND TRY_CAST(period_txt AS DOUBLE) IS NOT NULL
"""

register("clean_events", CLEAN_SQL)(cleaned_orders)


# --------------------------------------------------------------------------
# entity_code_filter: keep three-letter upper-case codes, drop aggregates
# --------------------------------------------------------------------------

def _codes(spark, root):
    n = table(spark, root, "nation", ["n_nationkey", "n_name"])
    k = F.col("n_nationkey")
    base = F.concat(F.char(k % 26 + 65), F.char((k * 7) % 26 + 65), F.char((k * 3 + 1) % 26 + 65))
    code = (F.when(k % 5 == 0, F.concat(F.lit("OWID_"), base))
             .when(k % 5 == 1, F.lower(base))
             .when(k % 5 == 2, F.concat(F.lit(" "), base, F.lit(" ")))
             .when(k % 5 == 3, F.concat(base, F.lit("X")))
             .otherwise(base))
    return n.withColumn("code", code)


def entity_code_filter(spark, root):
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey"])
    x = c.join(F.broadcast(_codes(spark, root)), c.c_nationkey == F.col("n_nationkey"))
    kept = clean.entity_rows(x, code_col="code")
    return kept.select("c_custkey", strip_ws("code").alias("code"), "n_name")


CODES_SQL = """
SELECT n_nationkey, n_name,
  CASE WHEN n_nationkey % 5 = 0 THEN 'OWID_' || b WHEN n_nationkey % 5 = 1 THEN lower(b)
       WHEN n_nationkey % 5 = 2 THEN ' ' || b || ' ' WHEN n_nationkey % 5 = 3 THEN b || 'X' ELSE b END AS code
FROM (SELECT n_nationkey, n_name,
        chr(CAST(n_nationkey % 26 + 65 AS INTEGER)) || chr(CAST((n_nationkey * 7) % 26 + 65 AS INTEGER))
        || chr(CAST((n_nationkey * 3 + 1) % 26 + 65 AS INTEGER)) AS b FROM nation) t
"""

register("entity_code_filter", f"""
WITH codes AS ({CODES_SQL})
SELECT c.c_custkey, {strip_sql('code')} AS code, n_name
FROM customer c JOIN codes ON c.c_nationkey = codes.n_nationkey
WHERE regexp_full_match({strip_sql('code')}, '[A-Z]{{3}}') AND NOT starts_with({strip_sql('code')}, 'OWID_')
""")(entity_code_filter)


# --------------------------------------------------------------------------
# event_panel: count, two sums, three modes per (entity, period) (A1 A5 U4)
# --------------------------------------------------------------------------

def q_event_panel(spark, root):
    p = p1_panel(spark, root)
    return p.select("c_custkey", "year", "n_events", rnd("amount", 2).alias("amount"),
                    rnd("qty", 2).alias("qty"), "cat1_mode", "cat2_mode", "cat3_mode")


_K1 = ["c_custkey", "year"]
register("event_panel", f"""
WITH ev AS ({ORDER_EVENTS_SQL}),
{mode_cte('m1', 'ev', _K1, 'o_orderpriority', 'cat1_mode')},
{mode_cte('m2', 'ev', _K1, 'c_mktsegment', 'cat2_mode')},
{mode_cte('m3', 'ev', _K1, 'o_orderstatus', 'cat3_mode')},
agg AS (SELECT c_custkey, year, CAST(count(*) AS BIGINT) AS n_events,
               round(COALESCE(sum(o_totalprice), 0), 2) AS amount, round(COALESCE(sum(o_qty), 0), 2) AS qty
        FROM ev GROUP BY c_custkey, year)
SELECT agg.*, m1.cat1_mode, m2.cat2_mode, m3.cat3_mode FROM agg
LEFT JOIN m1 USING (c_custkey, year) LEFT JOIN m2 USING (c_custkey, year) LEFT JOIN m3 USING (c_custkey, year)
""")(q_event_panel)


# --------------------------------------------------------------------------
# harmonize_names: mapping dimension + left join + flag
# --------------------------------------------------------------------------

# The literal name-mapping table used by the harmonisation
# queries: (position, source_name, canonical_name, source_dataset, active_flag).
NAME_MAPPING = [
    (1, "nation 2", "NATION_2", "orders", 1),
    (2, " Nation 5", "NATION_5", "orders", 1),
    (3, "NATION 8", "NATION_8", "orders", 1),
    (4, "nation 11", "NATION_11", "orders", 1),
    (5, "nation 14", "NATION_14", "orders", 0),
    (6, "nation 17", "NATION_17", "orders", 1),
    (7, "nation 17", "NATION_SEVENTEEN", "orders", 1),
    (8, "nation 20", "NATION_20", "suppliers", 1),
    (9, "nation_3", "NATION_3", "orders", 1),
    (10, "NATION_6", "NATION_6", "Orders ", 1),
]
MAPPING_SCHEMA = "pos long, source_name string, canonical_name string, source_dataset string, active_flag long"
MAPPING_SQL = "(VALUES " + ", ".join(
    "({}, '{}', '{}', '{}', {})".format(*r) for r in NAME_MAPPING) + \
    ") AS m(pos, source_name, canonical_name, source_dataset, active_flag)"


def _mapping(spark):
    return load_mapping(spark.createDataFrame(NAME_MAPPING, MAPPING_SCHEMA).withColumn("pos", F.col("pos")),
                        source="orders").select("map_key", "canonical_name", "pos")


def _dirty_names(spark, root):
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey"])
    n = table(spark, root, "nation", ["n_nationkey", "n_name"])
    k = F.col("n_nationkey")
    name = (F.when(k % 3 == 2, F.concat(F.lit("  Nation "), k.cast("string"), F.lit("\t")))
             .when(k % 3 == 0, F.lower("n_name"))
             .otherwise(F.col("n_name")))
    return c.join(F.broadcast(n.withColumn("name_raw", name)), c.c_nationkey == k).select("c_custkey", "name_raw")


def harmonize_names(spark, root):
    out = apply_mapping(_dirty_names(spark, root), _mapping(spark), "name_raw",
                        out_col="name_std", flag_col="mapping_applied", order_col="pos")
    return out.select("c_custkey", "name_raw", "name_std", "mapping_applied")


DIRTY_NAMES_SQL = """
SELECT c.c_custkey,
  CASE WHEN n.n_nationkey % 3 = 2 THEN '  Nation ' || CAST(n.n_nationkey AS VARCHAR) || chr(9)
       WHEN n.n_nationkey % 3 = 0 THEN lower(n.n_name) ELSE n.n_name END AS name_raw
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""
MAP_SQL = f"""
SELECT map_key, first(canonical_name ORDER BY pos) AS canonical_name FROM (
  SELECT lower({strip_sql('source_name')}) AS map_key, {strip_sql('canonical_name')} AS canonical_name, pos
  FROM {MAPPING_SQL}
  WHERE active_flag = 1 AND lower({strip_sql('source_dataset')}) = 'orders') t GROUP BY map_key
"""
register("harmonize_names", f"""
WITH d AS (SELECT c_custkey, {strip_sql('name_raw')} AS name_raw FROM ({DIRTY_NAMES_SQL}) x),
mp AS ({MAP_SQL})
SELECT c_custkey, name_raw, COALESCE(mp.canonical_name, name_raw) AS name_std,
       CAST(CASE WHEN mp.canonical_name IS NULL THEN 0 ELSE 1 END AS BIGINT) AS mapping_applied
FROM d LEFT JOIN mp ON lower(d.name_raw) = mp.map_key
""")(harmonize_names)


# --------------------------------------------------------------------------
# merge_remapped: two spellings -> one name; sums, mode of modes, max flag,
# first value (A2 A3 A4)
# --------------------------------------------------------------------------

def merge_remapped(spark, root):
    ev = order_events(spark, root)
    spelled = ev.withColumn("name_raw", F.when(F.col("o_orderkey") % 2 == 0, F.lower("n_name"))
                            .otherwise(F.col("n_name")))
    pre = event_panel(spelled, "name_raw", "year", count_col="n_events",
                      sums={"amount": "o_totalprice"}, modes={"cat1_mode": "o_orderpriority"})
    mapped = apply_mapping(pre, _mapping(spark), "name_raw", out_col="name_std",
                           flag_col="mapping_applied", order_col="pos")
    out = event_panel(mapped, "name_std", "year", count_col=None,
                      sums={"n_events": "n_events", "amount": "amount"},
                      modes={"cat1_mode": "cat1_mode"}, maxes={"mapping_applied": "mapping_applied"})
    first = first_non_null(mapped, ["name_std", "year"], "amount", "name_raw", out_col="first_amount")
    return (out.join(first, ["name_std", "year"], "left")
               .select("name_std", "year", F.col("n_events").cast("bigint").alias("n_events"),
                       rnd("amount", 2).alias("amount"), "cat1_mode", "mapping_applied",
                       rnd("first_amount", 2).alias("first_amount")))


register("merge_remapped", f"""
WITH ev AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name_raw
            FROM ({ORDER_EVENTS_SQL}) e),
{mode_cte('m0', 'ev', ['name_raw', 'year'], 'o_orderpriority', 'cat1_mode')},
pre AS (SELECT name_raw, year, count(*) AS n_events, COALESCE(sum(o_totalprice), 0) AS amount
        FROM ev GROUP BY name_raw, year),
mp AS ({MAP_SQL}),
mapped AS (SELECT pre.name_raw, pre.year, pre.n_events, pre.amount, m0.cat1_mode,
                  COALESCE(mp.canonical_name, pre.name_raw) AS name_std,
                  CASE WHEN mp.canonical_name IS NULL THEN 0 ELSE 1 END AS mapping_applied
           FROM pre JOIN m0 USING (name_raw, year) LEFT JOIN mp ON lower(pre.name_raw) = mp.map_key),
{mode_cte('mm', 'mapped', ['name_std', 'year'], 'cat1_mode', 'cat1_mode')}
SELECT a.name_std, a.year, CAST(sum(n_events) AS BIGINT) AS n_events, round(sum(amount), 2) AS amount,
       min(mm.cat1_mode) AS cat1_mode, CAST(max(mapping_applied) AS BIGINT) AS mapping_applied,
       round(first(amount ORDER BY name_raw), 2) AS first_amount
FROM mapped a JOIN mm USING (name_std, year)
GROUP BY a.name_std, a.year
""")(merge_remapped)


# --------------------------------------------------------------------------
# panel_join_flags: dense panel + three (nation, month) series, fills, flags
# (J1 P9 P11 A3 F10); panel_diagnostics on the result
# --------------------------------------------------------------------------

from .roles import MONTH_INDEX_SQL  # noqa: E402
from ..operators.joins import with_scalars  # noqa: E402
from ..operators.panel import mode_two_level  # noqa: E402,F401


# Series definitions (business conditions on the shipped lines): returns
# with a high discount, low-tax lines, large filled lines. Each leaves some
# (nation, month) keys without data, which the join flags must report.
def RETURNS():
    return (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08)


def LOW_TAX():
    return F.col("l_tax") <= 0.01


def LARGE_FILLED():
    return (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 40)


def _ship_lines(spark, root):
    li = table(spark, root, "lineitem", ["l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                         "l_returnflag", "l_linestatus", "l_shipdate"])
    s = table(spark, root, "supplier", ["s_suppkey", "s_nationkey"])
    n = table(spark, root, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = table(spark, root, "region", ["r_regionkey", "r_name"])
    # nation/region: 25 and 5 rows by the schema definition at every scale
    g = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(g), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.withColumn("month_idx", month_index("l_shipdate"))


def conflict_series(spark, root):
    """Per return line: intensity = quantity, flag and ordinal level; then per
    (nation, month): modal region, max flag, max level, summed intensity."""
    x = _ship_lines(spark, root).filter(RETURNS())
    x = x.withColumns({"conflict": (F.col("l_quantity") > 0).cast("long"),
                       "level": ordinal_bucket("l_quantity")})
    return event_panel(x, "n_name", "month_idx", count_col=None,
                       sums={"intensity": "l_quantity"}, maxes={"conflict": "conflict", "conflict_level": "level"},
                       modes={"conflict_region": "r_name"})


def supplier_series(spark, root):
    x = _ship_lines(spark, root).filter(LOW_TAX())
    return x.groupBy("n_name", "month_idx").agg(F.count_distinct("l_suppkey").cast("double").alias("supplier_count"))


def price_series(spark, root):
    x = _ship_lines(spark, root).filter(LARGE_FILLED())
    # mean price to the cent, half up, in exact integer cents
    a = x.groupBy("n_name", "month_idx").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("s"),
                                             F.count(F.lit(1)).alias("n"))
    return a.select("n_name", "month_idx",
                    (F.expr("(2 * s + n) div (2 * n)").cast("double") / 100.0).alias("avg_price"))


def reference_series(spark, root):
    """The three (nation, month) reference series from ONE scan and ONE
    aggregate of the shipped lines: each series is a conditional aggregate
    with its own presence count, so a key missing from a series stays NULL
    there. (Equivalent to ``conflict_series``, ``supplier_series`` and
    ``price_series`` joined one by one, with a third of the scans.)"""
    x = _ship_lines(spark, root)
    c1, c2, c3 = RETURNS(), LOW_TAX(), LARGE_FILLED()
    # level 1: per (nation, month, supplier) - partial sums that the second
    # level adds up; distinct suppliers become a plain count (no Expand of
    # the lines). r_name is fixed per supplier nation, so keying it costs
    # no extra rows and its line mode equals its mode over these groups.
    s1 = x.groupBy("n_name", "month_idx", "l_suppkey", "r_name").agg(
        F.count_if(c1).alias("n1"), F.count_if(c2).alias("n2"), F.count_if(c3).alias("n3"),
        F.sum(F.when(c1, F.col("l_quantity"))).alias("q1"),
        F.max(F.when(c1, (F.col("l_quantity") > 0).cast("long"))).alias("cf"),
        F.max(F.when(c1, ordinal_bucket("l_quantity"))).alias("lv"),
        # mean price to the cent, half up, in exact integer cents
        F.sum(F.when(c3, F.round(F.col("l_extendedprice") * 100).cast("bigint"))).alias("cents"))
    a = s1.groupBy("n_name", "month_idx").agg(
        F.sum("n1").alias("__n1"), F.sum("n2").alias("__n2"), F.sum("n3").alias("__n3"),
        F.sum("q1").alias("intensity"), F.max("cf").alias("conflict"), F.max("lv").alias("conflict_level"),
        F.mode(F.when(F.col("n1") > 0, F.col("r_name")), True).alias("conflict_region"),
        F.count_if(F.col("n2") > 0).cast("double").alias("supplier_count"),
        F.sum("cents").alias("__cents"))
    a = a.withColumn("avg_price", F.when(F.col("__n3") > 0, F.expr("(2 * __cents + __n3) div (2 * __n3)")
                                         .cast("double") / 100.0))
    return a.select("n_name", "month_idx",
                    *[F.when(F.col("__n1") > 0, F.col(c)).alias(c)
                      for c in ["intensity", "conflict", "conflict_level", "conflict_region"]],
                    F.when(F.col("__n2") > 0, F.col("supplier_count")).alias("supplier_count"),
                    F.when(F.col("__n3") > 0, F.col("avg_price")).alias("avg_price"))


def joined_panel(spark, root):
    """Dense panel + three reference series, filled and flagged; built once
    per session and data root."""
    def build():
        p = p2_panel(spark, root).select("n_name", "month_idx", "n_events", "amount", "r_name")
        j = left_join_chain(p, ["n_name", "month_idx"], [reference_series(spark, root)])
        j = clean.fill_constant(j, {"conflict": 0, "conflict_level": 0, "intensity": 0.0})
        return clean.presence_flags(j, {"has_conflict_data": "conflict_region",
                                        "has_supplier_data": "supplier_count",
                                        "has_price_data": "avg_price"})
    return built_once(spark, ("joined", root), build)


def panel_join_flags(spark, root):
    j = joined_panel(spark, root)
    return j.select("n_name", "month_idx", "n_events", rnd("amount", 2).alias("amount"),
                    F.col("conflict").cast("bigint").alias("conflict"),
                    F.col("conflict_level").cast("bigint").alias("conflict_level"),
                    rnd("intensity", 2).alias("intensity"), "supplier_count",
                    rnd("avg_price", 6).alias("avg_price"),
                    "has_conflict_data", "has_supplier_data", "has_price_data")


_SHIP_SQL = f"""
SELECT l.*, s.s_nationkey, n.n_name, r.r_name, CAST({MONTH_INDEX_SQL.format(c='l.l_shipdate')} AS BIGINT) AS month_idx
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""
_BUCKET_SQL = ("CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN 0 " +
               " ".join(f"WHEN {{x}} <= {b} THEN {i}" for i, b in enumerate(
                   (10, 25, 50, 100, 250, 500, 1000, 2500, 5000), start=1)) + " ELSE 10 END")

JOINED_SQL = f"""
ev AS ({ORDER_EVENTS_SQL}),
p AS (SELECT n_name, month_idx, count(*) AS n_events, sum(o_totalprice) AS amount, min(r_name) AS r_name FROM ev GROUP BY n_name, month_idx),
ship AS ({_SHIP_SQL}),
cl AS (SELECT *, CASE WHEN l_quantity > 0 THEN 1 ELSE 0 END AS conflict, {_BUCKET_SQL.format(x='l_quantity')} AS lvl
       FROM ship WHERE l_returnflag = 'R' AND l_discount >= 0.08),
{mode_cte('cr', 'cl', ['n_name', 'month_idx'], 'r_name', 'conflict_region')},
c AS (SELECT n_name, month_idx, COALESCE(sum(l_quantity), 0) AS intensity, max(conflict) AS conflict,
             max(lvl) AS conflict_level FROM cl GROUP BY n_name, month_idx),
sc AS (SELECT n_name, month_idx, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS supplier_count FROM ship
       WHERE l_tax <= 0.01 GROUP BY n_name, month_idx),
pr AS (SELECT n_name, month_idx, CAST((2 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100.0 AS avg_price FROM ship
       WHERE l_linestatus = 'F' AND l_quantity >= 40 GROUP BY n_name, month_idx),
j AS (
SELECT p.n_name, p.month_idx, CAST(p.n_events AS BIGINT) AS n_events, round(p.amount, 2) AS amount,
       CAST(COALESCE(c.conflict, 0) AS BIGINT) AS conflict, CAST(COALESCE(c.conflict_level, 0) AS BIGINT) AS conflict_level,
       round(COALESCE(c.intensity, 0.0), 2) AS intensity, sc.supplier_count, round(pr.avg_price, 6) AS avg_price,
       CAST(cr.conflict_region IS NOT NULL AS BIGINT) AS has_conflict_data,
       CAST(sc.supplier_count IS NOT NULL AS BIGINT) AS has_supplier_data,
       CAST(pr.avg_price IS NOT NULL AS BIGINT) AS has_price_data
FROM p LEFT JOIN c USING (n_name, month_idx) LEFT JOIN cr USING (n_name, month_idx)
LEFT JOIN sc USING (n_name, month_idx) LEFT JOIN pr USING (n_name, month_idx))
"""

register("panel_join_flags", f"WITH {JOINED_SQL} SELECT * FROM j")(panel_join_flags)


def q_panel_diagnostics(spark, root):
    return panel_diagnostics(joined_panel(spark, root), "n_name", "month_idx",
                             {"conflict": "has_conflict_data", "supplier": "has_supplier_data",
                              "price": "has_price_data"})


register("panel_diagnostics", f"""
WITH {JOINED_SQL}
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(count(DISTINCT n_name) AS BIGINT) AS distinct_entities,
       min(month_idx) AS period_min, max(month_idx) AS period_max,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT n_name, month_idx FROM j) t) AS BIGINT) AS duplicate_keys,
       round(avg(has_conflict_data), 6) AS match_rate_conflict,
       round(avg(has_supplier_data), 6) AS match_rate_supplier,
       round(avg(has_price_data), 6) AS match_rate_price
FROM j
""")(q_panel_diagnostics)


# --------------------------------------------------------------------------
# ordinal_bucket / risk_score / tier
# --------------------------------------------------------------------------

TRAIN_LAST_YEAR = 1998

P1_SQL = f"""
ev AS ({ORDER_EVENTS_SQL}),
p1 AS (SELECT c_custkey, year, count(*) AS n_events, COALESCE(sum(o_totalprice), 0) AS amount,
              COALESCE(sum(o_qty), 0) AS qty, min(r_name) AS r_name FROM ev GROUP BY c_custkey, year)
"""


def q_ordinal_bucket(spark, root):
    p = p1_panel(spark, root).withColumn("amount_k", F.round("amount", 2) / 1000.0)
    return p.select("c_custkey", "year", rnd("amount_k", 6).alias("amount_k"),
                    ordinal_bucket("amount_k").alias("level"))


register("ordinal_bucket", f"""
WITH {P1_SQL}
SELECT c_custkey, year, round(round(amount, 2) / 1000.0, 6) AS amount_k,
       CAST({_BUCKET_SQL.format(x='(round(amount, 2) / 1000.0)')} AS BIGINT) AS level
FROM p1
""")(q_ordinal_bucket)


def _with_risk(spark, root):
    p = p1_panel(spark, root)
    return p.withColumn("risk_score", weighted_score("n_events", "qty", 0.5))


def q_risk_score(spark, root):
    p = _with_risk(spark, root)
    return p.select("c_custkey", "year", rnd("risk_score", 6).alias("risk_score"),
                    F.col("cat1_mode").isin("1-URGENT", "2-HIGH").cast("long").alias("urgent_flag"))


register("risk_score", f"""
WITH {P1_SQL},
{mode_cte('m1', 'ev', ['c_custkey', 'year'], 'o_orderpriority', 'cat1_mode')}
SELECT c_custkey, year, round(n_events + 0.5 * qty, 6) AS risk_score,
       CAST(COALESCE(m1.cat1_mode IN ('1-URGENT', '2-HIGH'), false) AS BIGINT) AS urgent_flag
FROM p1 LEFT JOIN m1 USING (c_custkey, year)
""")(q_risk_score)


def region_tiers(panel, group: str, score: str, period: str, last_train_period):
    """A21 + F13: mean score per group over the training era, then tiers by
    the 0.5 / 0.75 quantiles *of the group means* (kept lazy: the one-row
    quantile aggregate is attached with a broadcast, no driver round trip)."""
    means = (panel.filter(F.col(period) <= last_train_period)
                  .groupBy(group).agg(F.avg(score).alias("group_mean")))
    q = exact_quantiles(means, "group_mean", {"q50": 0.5, "q75": 0.75})
    groups = panel.select(group).distinct().join(means, group, "left")
    return with_scalars(groups, q).withColumn("tier", tier("group_mean", F.col("q50"), F.col("q75")))


def q_tier(spark, root):
    t = region_tiers(_with_risk(spark, root), "r_name", "risk_score", "year", TRAIN_LAST_YEAR)
    return t.select("r_name", rnd("group_mean", 6).alias("group_mean"), "tier")


register("tier", f"""
WITH {P1_SQL},
m AS (SELECT r_name, avg(n_events + 0.5 * qty) AS group_mean FROM p1 WHERE year <= {TRAIN_LAST_YEAR} GROUP BY r_name),
q AS (SELECT quantile_cont(group_mean, 0.5) AS q50, quantile_cont(group_mean, 0.75) AS q75 FROM m),
g AS (SELECT DISTINCT r_name FROM p1)
SELECT g.r_name, round(m.group_mean, 6) AS group_mean,
       CASE WHEN COALESCE(m.group_mean, 0) >= q.q75 THEN 'HIGH'
            WHEN COALESCE(m.group_mean, 0) >= q.q50 THEN 'MEDIUM' ELSE 'LOW' END AS tier
FROM g LEFT JOIN m USING (r_name) CROSS JOIN q
""")(q_tier)
