"""Catalogue, part 7: rule engine and budget allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import allocate as AL
from ..operators import rules as RU
from ..operators import windows as W
from ..operators.describe import listed_only
from .q_build import JOINED_SQL, joined_panel
from .q_stats import TRAIN_LAST_MONTH
from .registry import register
from .roles import p2_panel

RULES_SINCE = 1999 * 12  # latest row per entity among periods from Jan 1999

# The rule table re-worded on the dense panel's columns.
RULES = [
    {"id": "R01", "name": "Sustained high-volume urgent orders", "priority": "CRITICAL", "category": "Capacity",
     "predicate": "tier = 'HIGH' AND cat1_mode = '1-URGENT' AND n_events >= 10",
     "text": "Add dedicated capacity for urgent orders in this market."},
    {"id": "R02", "name": "Orders a fifth above their recent mean", "priority": "HIGH", "category": "Early warning",
     "predicate": "trend_flag = 1 AND n_events >= 5",
     "text": "Bring replenishment forward for the next months."},
    {"id": "R03", "name": "Many returned lines at low prices", "priority": "HIGH", "category": "Stabilisation",
     "predicate": "conflict_level >= 2 AND low_flag = 1",
     "text": "Find out why lines come back before prices change again."},
    {"id": "R04", "name": "Fulfilled orders dominant", "priority": "HIGH", "category": "Retention",
     "predicate": "cat3_mode = 'F' AND n_events >= 8",
     "text": "Start retention offers for repeat customers."},
    {"id": "R05", "name": "High-priority concentration", "priority": "MEDIUM", "category": "Operations",
     "predicate": "cat1_mode = '2-HIGH' AND n_events >= 5",
     "text": "Rebalance handling capacity towards high-priority orders."},
    {"id": "R06", "name": "Low-priority hotspot", "priority": "MEDIUM", "category": "Policy",
     "predicate": "cat1_mode = '5-LOW'",
     "text": "Review service levels offered on low-priority orders."},
    {"id": "R07", "name": "Mid-tier market with steady orders", "priority": "MEDIUM", "category": "Monitoring",
     "predicate": "tier = 'MEDIUM' AND n_events >= 3",
     "text": "Check this market against its forecast every month."},
    {"id": "R08", "name": "Segment spike", "priority": "HIGH", "category": "Accounts",
     "predicate": "cat2_mode IN ('AUTOMOBILE', 'BUILDING') AND n_events >= 6",
     "text": "Assign account managers to the dominant segments."},
]

LATEST_COLS = ["r_name", "n_events", "cat1_mode", "cat2_mode", "cat3_mode", "conflict_level", "low_flag",
               "trend_flag", "tier"]


def rule_features(spark, root):
    j = joined_panel(spark, root)
    p = p2_panel(spark, root).select("n_name", "month_idx", "qty", "cat1_mode", "cat2_mode", "cat3_mode")
    d = j.join(p, ["n_name", "month_idx"])
    feats, _ = RU.derive_rule_features(d, "n_name", "month_idx", "n_events", "qty", "avg_price", "r_name",
                                       TRAIN_LAST_MONTH)
    return feats


def fired_rules(spark, root):
    latest = W.latest_non_null(rule_features(spark, root), "n_name", "month_idx", LATEST_COLS, since=RULES_SINCE)
    return RU.apply_rules(latest, RULES, ["n_name", "r_name", "month_idx", "n_events"])


def rule_hits(spark, root):
    return fired_rules(spark, root).select("n_name", "r_name", "month_idx", "n_events", "rule_id", "priority",
                                           "category")


_J = JOINED_SQL.replace("SELECT p.n_name, p.month_idx,", "SELECT p.n_name, p.month_idx, p.r_name,")
_RULE_SQL = f"""WITH {_J},
ev2 AS (SELECT * FROM ev),
{__import__('panelkit.plans.sqlkit', fromlist=['mode_cte']).mode_cte('mc1', 'ev2', ['n_name', 'month_idx'], 'o_orderpriority', 'cat1_mode')},
{__import__('panelkit.plans.sqlkit', fromlist=['mode_cte']).mode_cte('mc2', 'ev2', ['n_name', 'month_idx'], 'c_mktsegment', 'cat2_mode')},
{__import__('panelkit.plans.sqlkit', fromlist=['mode_cte']).mode_cte('mc3', 'ev2', ['n_name', 'month_idx'], 'o_orderstatus', 'cat3_mode')},
qq AS (SELECT n_name, month_idx, COALESCE(sum(o_qty), 0) AS qty FROM ev GROUP BY n_name, month_idx),
d AS (SELECT j.*, qq.qty, mc1.cat1_mode, mc2.cat2_mode, mc3.cat3_mode,
             CASE WHEN count(n_events) OVER w3 >= 2 THEN avg(n_events) OVER w3 END AS past3
      FROM j JOIN qq USING (n_name, month_idx) JOIN mc1 USING (n_name, month_idx) JOIN mc2 USING (n_name, month_idx)
      JOIN mc3 USING (n_name, month_idx)
      WINDOW w3 AS (PARTITION BY n_name ORDER BY month_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
q25 AS (SELECT quantile_cont(avg_price, 0.25) AS q25 FROM d),
d2 AS (SELECT d.*, CAST(COALESCE(n_events > past3 * 1.2, false) AS BIGINT) AS trend_flag,
              CAST(COALESCE(avg_price < q25, false) AS BIGINT) AS low_flag, n_events + 0.5 * qty AS risk_score
       FROM d CROSS JOIN q25),
gm AS (SELECT r_name, avg(risk_score) AS group_mean FROM d2 WHERE month_idx <= {TRAIN_LAST_MONTH} GROUP BY r_name),
gq AS (SELECT quantile_cont(group_mean, 0.5) AS q50, quantile_cont(group_mean, 0.75) AS q75 FROM gm),
d3 AS (SELECT d2.*, CASE WHEN COALESCE(gm.group_mean, 0) >= q75 THEN 'HIGH' WHEN COALESCE(gm.group_mean, 0) >= q50
                         THEN 'MEDIUM' ELSE 'LOW' END AS tier
       FROM d2 LEFT JOIN gm USING (r_name) CROSS JOIN gq),
latest AS (SELECT n_name, max(month_idx) AS month_idx, """ + ", ".join(
    f"arg_max({c}, month_idx) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in LATEST_COLS) + f"""
    FROM d3 WHERE month_idx >= {RULES_SINCE} GROUP BY n_name),
fired AS (""" + " UNION ALL ".join(
    f"SELECT n_name, r_name, month_idx, n_events, '{r['id']}' AS rule_id, '{r['priority']}' AS priority, "
    f"'{r['category']}' AS category FROM latest WHERE COALESCE(({r['predicate']}), false)" for r in RULES) + ")"

register("rule_hits", _RULE_SQL + "\nSELECT * FROM fired")(rule_hits)


def rule_hits_by_priority(spark, root):
    return RU.hits_by(fired_rules(spark, root), "priority", "n_name")


register("rule_hits_by_priority", _RULE_SQL + """
SELECT priority, CAST(count(*) AS BIGINT) AS n_fired, CAST(count(DISTINCT n_name) AS BIGINT) AS n_entities
FROM fired GROUP BY priority""")(rule_hits_by_priority)

# Rule priorities in report order (pivot columns).
PRIORITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def rule_hits_by_group(spark, root):
    # a rule with a priority that the list lacks fails the job instead of vanishing
    f = fired_rules(spark, root).withColumn("priority", listed_only("priority", PRIORITIES))
    p = f.groupBy("r_name").pivot("priority", PRIORITIES).agg(F.count(F.lit(1))).fillna(0)
    return p.withColumn("total", sum(F.col(c) for c in PRIORITIES))


register("rule_hits_by_group", _RULE_SQL + "\nSELECT r_name, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE priority = '{p}') AS BIGINT) AS \"{p}\"" for p in PRIORITIES)
    + ", CAST(count(*) AS BIGINT) AS total FROM fired GROUP BY r_name")(rule_hits_by_group)


# ------------------------------------------------------------------ allocation

# Allocation scenarios (name, group level, budget in percent).
SCENARIOS = [("regions_100", "region", 100.0), ("regions_50", "region", 50.0), ("nations_100", "nation", 100.0)]


def _harms(spark, root):
    p = p2_panel(spark, root).filter(F.col("month_idx") <= TRAIN_LAST_MONTH) \
        .withColumn("risk", F.col("n_events") + 0.5 * F.col("qty"))
    reg = p.groupBy(F.col("r_name").alias("grp")).agg(F.avg("risk").alias("h")).withColumn("level", F.lit("region"))
    nat = p.groupBy(F.col("n_name").alias("grp")).agg(F.avg("risk").alias("h")).withColumn("level", F.lit("nation"))
    sc = spark.createDataFrame(SCENARIOS, "scenario string, level string, budget double")
    harms = reg.unionByName(nat).join(F.broadcast(sc), "level").select("scenario", "grp", "h")
    return harms, sc.select("scenario", "budget")


def allocation_table(spark, root):
    harms, budgets = _harms(spark, root)
    return AL.allocate(harms, "scenario", "grp", "h", budgets)


def allocation(spark, root):
    a = allocation_table(spark, root)
    return a.select("scenario", "grp", rnd("harm", 6).alias("harm"), rnd("alloc", 6).alias("alloc"),
                    rnd("effect_pct", 6).alias("effect_pct"), rnd("harm_after", 6).alias("harm_after"))


_SC_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in SCENARIOS) + ") AS sc(scenario, level, budget)"
_ALLOC_SQL = f"""WITH {__import__('panelkit.plans.q_describe', fromlist=['P2_SQL']).P2_SQL},
pp AS (SELECT *, n_events + 0.5 * qty AS risk FROM p2 WHERE month_idx <= {TRAIN_LAST_MONTH}),
hh AS (SELECT r_name AS grp, avg(risk) AS h, 'region' AS level FROM pp GROUP BY r_name
       UNION ALL SELECT n_name AS grp, avg(risk) AS h, 'nation' AS level FROM pp GROUP BY n_name),
g0 AS (SELECT sc.scenario, hh.grp, hh.h, sc.budget FROM hh JOIN {_SC_SQL} ON hh.level = sc.level),
g AS (SELECT g0.*, budget / count(*) OVER (PARTITION BY scenario) AS m,
             least({AL.MAX_ALLOC}, budget / count(*) OVER (PARTITION BY scenario) * pow({AL.MAX_EFFECT} / {AL.ALPHA}, 2)) AS up
      FROM g0),
base AS (SELECT scenario, count(*) * {AL.MIN_ALLOC} AS c0, max(budget) AS budget, sum(up) AS sum_up FROM g GROUP BY scenario),
bp AS (SELECT scenario, grp, {AL.MIN_ALLOC} / (h * h) AS k, 0 AS typ, h * h AS ds, -{AL.MIN_ALLOC} AS dc FROM g WHERE h > 0
       UNION ALL SELECT scenario, grp, up / (h * h) AS k, 1 AS typ, -(h * h) AS ds, up AS dc FROM g WHERE h > 0),
bp2 AS (SELECT bp.*, sum(ds) OVER w AS slope, base.c0 + sum(dc) OVER w AS cst,
               row_number() OVER (PARTITION BY bp.scenario ORDER BY k, typ, grp) AS rn, base.budget
        FROM bp JOIN base USING (scenario)
        WINDOW w AS (PARTITION BY bp.scenario ORDER BY k, typ, grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
seg AS (SELECT scenario, arg_max(k, rn) AS k, arg_max(slope, rn) AS slope, arg_max(cst, rn) AS cst FROM bp2
        WHERE cst + slope * k <= budget + 1e-9 GROUP BY scenario),
ks AS (SELECT base.scenario, CASE WHEN base.budget < c0 - 1e-9 OR base.budget > sum_up + 1e-9 THEN NULL
                                  WHEN seg.k IS NULL THEN 0.0
                                  WHEN seg.slope > 0 THEN (base.budget - seg.cst) / seg.slope ELSE seg.k END AS kstar
       FROM base LEFT JOIN seg USING (scenario)),
al AS (SELECT g.scenario, g.grp, g.h, g.m,
              CASE WHEN h > 0 THEN (CASE WHEN ks.kstar IS NULL THEN NULL ELSE least(greatest(ks.kstar * h * h, {AL.MIN_ALLOC}), up) END)
                   ELSE {AL.MIN_ALLOC} END AS alloc
       FROM g JOIN ks USING (scenario)),
res AS (SELECT scenario, grp, h AS harm, alloc, least({AL.MAX_EFFECT}, {AL.ALPHA} * sqrt(greatest(alloc / m, 0.0))) AS eff FROM al)
"""

register("allocation", _ALLOC_SQL + """
SELECT scenario, grp, round(harm, 6) AS harm, round(alloc, 6) AS alloc, round(eff * 100, 6) AS effect_pct,
       round(harm * (1 - eff), 6) AS harm_after FROM res""")(allocation)


def allocation_summary(spark, root):
    s = AL.allocation_summary(allocation_table(spark, root), "scenario")
    return s.select("scenario", *[rnd(c, 6).alias(c) for c in ["allocated", "harm_before", "harm_after", "reduction_pct"]])


register("allocation_summary", _ALLOC_SQL + """
SELECT scenario, round(sum(alloc), 6) AS allocated, round(sum(harm), 6) AS harm_before,
       round(sum(harm * (1 - eff)), 6) AS harm_after, round(100 * (1 - sum(harm * (1 - eff)) / sum(harm)), 6) AS reduction_pct
FROM res GROUP BY scenario""")(allocation_summary)
