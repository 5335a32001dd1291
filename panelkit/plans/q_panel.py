"""Catalogue, part 4: balanced panels, gap fills, interpolation, latest
values, dedup, features and lead targets (J4 J5 W1-W5 W9-W12 M1-M5 A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import features as FT
from ..operators import windows as W
from ..operators.panel import balance_panel, event_panel
from .q_build import JOINED_SQL, P1_SQL, joined_panel
from .q_describe import P2_SQL
from .registry import register
from .roles import ORDER_EVENTS_SQL, order_events, p1_panel, p2_panel


def _balanced_p1(spark, root, mode):
    p = p1_panel(spark, root)
    return balance_panel(p, "c_custkey", "year", zero_cols=["n_events"], carry_cols=["amount", "qty"],
                         attr={"region": "r_name"}, mode=mode)


def balanced_panel(spark, root):
    b = _balanced_p1(spark, root, "carry")
    return b.select("c_custkey", "year", "region", "n_events", rnd("amount", 2).alias("amount"),
                    rnd("qty", 2).alias("qty"), "observed")


def balanced_panel_zero(spark, root):
    b = _balanced_p1(spark, root, "zero")
    return b.select("c_custkey", "year", "region", "n_events", rnd("amount", 2).alias("amount"),
                    rnd("qty", 2).alias("qty"), "observed")


def _grid_sql(src, entity, period):
    return (f"SELECT e.{entity}, CAST(g.{period} AS BIGINT) AS {period} FROM (SELECT DISTINCT {entity} FROM {src}) e "
            f"CROSS JOIN (SELECT unnest(range((SELECT min({period}) FROM {src}), (SELECT max({period}) FROM {src}) + 1)) "
            f"AS {period}) g")


def _carry(c, entity, period):
    return (f"COALESCE(last_value({c} IGNORE NULLS) OVER (PARTITION BY {entity} ORDER BY {period} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER "
            f"(PARTITION BY {entity} ORDER BY {period} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)")


_BAL_P1 = f"""WITH {P1_SQL},
g AS ({_grid_sql('p1', 'c_custkey', 'year')}),
rm AS (SELECT c_custkey, first(r_name ORDER BY n DESC, r_name) AS region FROM
       (SELECT c_custkey, r_name, count(*) AS n FROM p1 GROUP BY c_custkey, r_name) t GROUP BY c_custkey),
x AS (SELECT g.c_custkey, g.year, p1.n_events, p1.amount, p1.qty, p1.c_custkey IS NOT NULL AS obs
      FROM g LEFT JOIN p1 ON g.c_custkey = p1.c_custkey AND g.year = p1.year)
SELECT x.c_custkey, x.year, COALESCE(rm.region, 'Unknown') AS region,
       CAST(COALESCE(n_events, 0) AS DOUBLE) AS n_events,
       round({{amount}}, 2) AS amount, round({{qty}}, 2) AS qty, CAST(obs AS BIGINT) AS observed
FROM x LEFT JOIN rm USING (c_custkey)"""

register("balanced_panel", _BAL_P1.format(amount=_carry("amount", "x.c_custkey", "x.year"),
                                          qty=_carry("qty", "x.c_custkey", "x.year")))(balanced_panel)
register("balanced_panel_zero", _BAL_P1.format(amount="COALESCE(amount, 0)", qty="COALESCE(qty, 0)"))(balanced_panel_zero)


# A6 + M2: group x period roll-up of the joined dense panel, then balanced
GROUP_ROLLUP = {"sums": {"total_events": "n_events", "total_amount": "amount", "total_intensity": "intensity"},
                "means": {"mean_level": "conflict_level", "mean_suppliers": "supplier_count",
                          "mean_price": "avg_price", "conflict_share": "conflict"},
                "distincts": {"entities_reporting": "n_name"}}


def group_panel(spark, root):
    j = joined_panel(spark, root)
    return event_panel(j, "r_name", "month_idx", count_col=None, **GROUP_ROLLUP)


def balanced_group_panel(spark, root):
    g = group_panel(spark, root)
    carry = ["total_amount", "total_intensity", "mean_level", "mean_suppliers", "mean_price",
             "conflict_share", "entities_reporting"]
    b = balance_panel(g, "r_name", "month_idx", zero_cols=["total_events"], carry_cols=carry)
    return b.select("r_name", "month_idx", "total_events", *[rnd(c, 4).alias(c) for c in carry], "observed")


register("balanced_group_panel", f"""WITH {JOINED_SQL.replace("SELECT p.n_name, p.month_idx,", "SELECT p.n_name, p.month_idx, p.r_name,")},
gp AS (SELECT r_name, month_idx, COALESCE(sum(n_events), 0) AS total_events, COALESCE(sum(amount), 0) AS total_amount,
              COALESCE(sum(intensity), 0) AS total_intensity, avg(conflict_level) AS mean_level,
              avg(supplier_count) AS mean_suppliers, avg(avg_price) AS mean_price, avg(conflict) AS conflict_share,
              count(DISTINCT n_name) AS entities_reporting FROM j GROUP BY r_name, month_idx),
g AS ({_grid_sql('gp', 'r_name', 'month_idx')}),
x AS (SELECT g.r_name, g.month_idx, gp.* EXCLUDE (r_name, month_idx), gp.r_name IS NOT NULL AS obs
      FROM g LEFT JOIN gp ON g.r_name = gp.r_name AND g.month_idx = gp.month_idx)
SELECT r_name, month_idx, CAST(COALESCE(total_events, 0) AS DOUBLE) AS total_events, """ + ", ".join(
    f"round(CAST({_carry(c, 'r_name', 'month_idx')} AS DOUBLE), 4) AS {c}" for c in
    ["total_amount", "total_intensity", "mean_level", "mean_suppliers", "mean_price", "conflict_share",
     "entities_reporting"]) + ", CAST(obs AS BIGINT) AS observed FROM x")(balanced_group_panel)


# W10 interpolation on a dense series with every 7th month removed
def interpolate(spark, root):
    p = p2_panel(spark, root).withColumn("v", F.when(F.col("month_idx") % 7 == 0, F.lit(None))
                                         .otherwise(F.col("amount")))
    out = W.interpolate_df(p, ["v"], "n_name", "month_idx", by="position")
    return out.select("n_name", "month_idx", rnd("v", 4).alias("amount_interp"))


register("interpolate", f"""WITH {P2_SQL},
x AS (SELECT n_name, month_idx, CASE WHEN month_idx % 7 = 0 THEN NULL ELSE amount END AS v,
             CAST(row_number() OVER (PARTITION BY n_name ORDER BY month_idx) AS DOUBLE) AS pos FROM p2),
y AS (SELECT *, last_value(v IGNORE NULLS) OVER wb AS v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER wb AS x0,
             first_value(v IGNORE NULLS) OVER wf AS v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER wf AS x1
      FROM x WINDOW wb AS (PARTITION BY n_name ORDER BY month_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    wf AS (PARTITION BY n_name ORDER BY month_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT n_name, month_idx,
       round(COALESCE(v, CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * ((pos - x0) / NULLIF(x1 - x0, 0)) END, v0, v1), 4)
       AS amount_interp
FROM y""")(interpolate)


# Last non-null value per column, per entity, since a period
def _gappy_p1(spark, root):
    p = p1_panel(spark, root)
    return p.withColumns({
        "amount": F.when((F.col("c_custkey") + F.col("year")) % 4 == 0, F.lit(None)).otherwise(F.col("amount")),
        "cat1_mode": F.when((F.col("c_custkey") * F.col("year")) % 5 == 0, F.lit(None)).otherwise(F.col("cat1_mode")),
    })


def latest_non_null(spark, root):
    out = W.latest_non_null(_gappy_p1(spark, root), "c_custkey", "year", ["amount", "cat1_mode"], since=1997)
    return out.select("c_custkey", "year", rnd("amount", 2).alias("amount"), "cat1_mode")


register("latest_non_null", f"""WITH {P1_SQL},
{__import__('panelkit.plans.sqlkit', fromlist=['mode_cte']).mode_cte('m1', 'ev', ['c_custkey', 'year'], 'o_orderpriority', 'cat1_mode')},
gp AS (SELECT p1.c_custkey, p1.year,
              CASE WHEN (p1.c_custkey + p1.year) % 4 = 0 THEN NULL ELSE p1.amount END AS amount,
              CASE WHEN (p1.c_custkey * p1.year) % 5 = 0 THEN NULL ELSE m1.cat1_mode END AS cat1_mode
       FROM p1 LEFT JOIN m1 USING (c_custkey, year) WHERE p1.year >= 1997)
SELECT c_custkey, max(year) AS year,
       round(arg_max(amount, year) FILTER (WHERE amount IS NOT NULL), 2) AS amount,
       arg_max(cat1_mode, year) FILTER (WHERE cat1_mode IS NOT NULL) AS cat1_mode
FROM gp GROUP BY c_custkey""")(latest_non_null)


# One event per (customer, year): the first by date, then order key
def dedup_first(spark, root):
    ev = order_events(spark, root, with_qty=False)
    d = W.dedup_first(ev, ["c_custkey", "year"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return d.select("c_custkey", "year", "o_orderkey", rnd("o_totalprice", 2).alias("o_totalprice"))


register("dedup_first", f"""WITH ev AS ({ORDER_EVENTS_SQL})
SELECT c_custkey, year, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey, year ORDER BY o_orderdate, o_orderkey) AS rn FROM ev) t
WHERE rn = 1""")(dedup_first)


# M1 + M3: balanced dense panel with lagged features and lead targets
BAL_CARRY = ["amount", "conflict_level", "conflict", "supplier_count", "avg_price"]


def balanced_dense(spark, root):
    j = joined_panel(spark, root)
    return balance_panel(j, "n_name", "month_idx", zero_cols=["n_events"], carry_cols=BAL_CARRY,
                         attr={"region": "r_name"})


def dense_features(spark, root):
    b = balanced_dense(spark, root)
    return FT.add_panel_features(
        b, "n_name", "month_idx", "n_events",
        covariates={"price_lag1": "avg_price", "suppliers_lag1": "supplier_count",
                    "level_lag1": "conflict_level", "conflict_lag1": "conflict"},
        logs={"log_price_lag1": "price_lag1", "log_suppliers_lag1": "suppliers_lag1"},
        interactions={"price_x_level_lag1": ("price_lag1", "level_lag1")})


FEATURES = ["n_events_lag1", "n_events_lag2", "n_events_roll3", "price_lag1", "suppliers_lag1", "level_lag1",
            "conflict_lag1", "log_price_lag1", "log_suppliers_lag1", "price_x_level_lag1"]


def panel_features(spark, root):
    f = dense_features(spark, root)
    FT.check_leak_free(FEATURES, target="n_events")
    return f.select("n_name", "month_idx", *[rnd(c, 6).alias(c) for c in FEATURES])


def lead_targets(spark, root):
    f = dense_features(spark, root)
    return f.select("n_name", "month_idx", "n_events", "y_plus1", "y_plus5", "y_plus10")


_BAL_DENSE = f"""WITH {JOINED_SQL.replace("SELECT p.n_name, p.month_idx,", "SELECT p.n_name, p.month_idx, p.r_name,")},
g AS ({_grid_sql('j', 'n_name', 'month_idx')}),
x AS (SELECT g.n_name, g.month_idx, j.n_events, j.amount, j.conflict_level, j.conflict, j.supplier_count, j.avg_price
      FROM g LEFT JOIN j ON g.n_name = j.n_name AND g.month_idx = j.month_idx),
b AS (SELECT n_name, month_idx, CAST(COALESCE(n_events, 0) AS DOUBLE) AS n_events, """ + ", ".join(
    f"CAST({_carry(c, 'n_name', 'month_idx')} AS DOUBLE) AS {c}" for c in BAL_CARRY) + """ FROM x),
f AS (SELECT *,
  COALESCE(lag(n_events, 1) OVER w, 0) AS n_events_lag1, COALESCE(lag(n_events, 2) OVER w, 0) AS n_events_lag2,
  COALESCE(CASE WHEN count(n_events) OVER w3 >= 1 THEN avg(n_events) OVER w3 END, 0) AS n_events_roll3,
  COALESCE(lag(avg_price, 1) OVER w, 0) AS price_lag1, COALESCE(lag(supplier_count, 1) OVER w, 0) AS suppliers_lag1,
  COALESCE(lag(conflict_level, 1) OVER w, 0) AS level_lag1, COALESCE(lag(conflict, 1) OVER w, 0) AS conflict_lag1,
  lead(n_events, 1) OVER w AS y_plus1, lead(n_events, 5) OVER w AS y_plus5, lead(n_events, 10) OVER w AS y_plus10
  FROM b WINDOW w AS (PARTITION BY n_name ORDER BY month_idx),
                w3 AS (PARTITION BY n_name ORDER BY month_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
"""

register("panel_features", _BAL_DENSE + """
SELECT n_name, month_idx, round(n_events_lag1, 6) AS n_events_lag1, round(n_events_lag2, 6) AS n_events_lag2,
       round(n_events_roll3, 6) AS n_events_roll3, round(price_lag1, 6) AS price_lag1,
       round(suppliers_lag1, 6) AS suppliers_lag1, round(level_lag1, 6) AS level_lag1,
       round(conflict_lag1, 6) AS conflict_lag1, round(ln(1 + greatest(price_lag1, 0)), 6) AS log_price_lag1,
       round(ln(1 + greatest(suppliers_lag1, 0)), 6) AS log_suppliers_lag1,
       round(price_lag1 * level_lag1, 6) AS price_x_level_lag1
FROM f""")(panel_features)

register("lead_targets", _BAL_DENSE + """
SELECT n_name, month_idx, n_events, y_plus1, y_plus5, y_plus10 FROM f""")(lead_targets)
