"""Catalogue, part 2: profiling and the text pattern scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import coerce_double, sentinel_to_null
from ..operators import quality as Q
from ..sources.readers import table
from .q_build import CLEAN_SQL, cleaned_orders
from .registry import register
from .roles import DIRTY_ORDERS_SQL, dirty_orders

DIRTY_COLS = ["entity_txt", "period_txt", "sev1_txt", "sev2_txt", "group_txt", "cat1_txt", "cat3_txt"]


def profile_nulls(spark, root):
    return Q.profile_nulls(dirty_orders(spark, root), DIRTY_COLS)


register("profile_nulls", "WITH d AS (" + DIRTY_ORDERS_SQL + ")\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS null_pct FROM d"
    for c in DIRTY_COLS))(profile_nulls)


def profile_distinct(spark, root):
    return Q.profile_distinct(dirty_orders(spark, root), DIRTY_COLS, count_null=True)


register("profile_distinct", "WITH d AS (" + DIRTY_ORDERS_SQL + ")\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS n_distinct FROM d" for c in DIRTY_COLS))(profile_distinct)


NUM_COLS = ["period", "sev1", "sev2"]


def profile_numeric(spark, root):
    return Q.profile_numeric(cleaned_orders(spark, root).withColumn("period", F.col("period").cast("double")),
                             NUM_COLS)


register("profile_numeric", "WITH d AS (" + CLEAN_SQL + ")\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(CAST(count({c}) AS DOUBLE), 6) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max, "
    f"round(CAST(count(*) FILTER (WHERE {c} < 0) AS DOUBLE), 6) AS negatives FROM d"
    for c in NUM_COLS))(profile_numeric)


TOP_COLS = ["entity_txt", "period_txt", "group_txt", "cat1_txt", "cat3_txt"]


def profile_top10(spark, root):
    return Q.profile_top_values(dirty_orders(spark, root), TOP_COLS, k=10)


register("profile_top10", "WITH d AS (" + DIRTY_ORDERS_SQL + "),\nc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM d GROUP BY {c}"
    for c in TOP_COLS) + """)
SELECT "column", value, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS FIRST) AS rank FROM c) t
WHERE rank <= 10""")(profile_top10)


def profile_issues(spark, root):
    d = dirty_orders(spark, root)
    return Q.issue_counts(d, {
        "null_entity": F.col("entity_txt").isNull(),
        "bad_period": coerce_double("period_txt").isNull(),
        "null_sev1": F.col("sev1_txt").isNull(),
        "nonnumeric_sev1": F.col("sev1_txt").isNotNull() & coerce_double("sev1_txt").isNull(),
        "sentinel_cat3": F.col("cat3_txt").isNotNull() & sentinel_to_null("cat3_txt").isNull(),
        "zero_sev2": coerce_double("sev2_txt") == 0,
        "nonzero_sev2": coerce_double("sev2_txt") != 0,
    })


register("profile_issues", f"""
WITH d AS ({DIRTY_ORDERS_SQL})
SELECT CAST(count(*) FILTER (WHERE entity_txt IS NULL) AS BIGINT) AS null_entity,
       CAST(count(*) FILTER (WHERE TRY_CAST(period_txt AS DOUBLE) IS NULL) AS BIGINT) AS bad_period,
       CAST(count(*) FILTER (WHERE sev1_txt IS NULL) AS BIGINT) AS null_sev1,
       CAST(count(*) FILTER (WHERE sev1_txt IS NOT NULL AND TRY_CAST(sev1_txt AS DOUBLE) IS NULL) AS BIGINT) AS nonnumeric_sev1,
       CAST(count(*) FILTER (WHERE cat3_txt IS NOT NULL AND lower(regexp_replace(cat3_txt, '^\\s+|\\s+$', '', 'g')) IN ('unknown', '')) AS BIGINT) AS sentinel_cat3,
       CAST(count(*) FILTER (WHERE TRY_CAST(sev2_txt AS DOUBLE) = 0) AS BIGINT) AS zero_sev2,
       CAST(count(*) FILTER (WHERE TRY_CAST(sev2_txt AS DOUBLE) <> 0) AS BIGINT) AS nonzero_sev2
FROM d
""")(profile_issues)


def profile_issue_examples(spark, root):
    d = dirty_orders(spark, root)
    return Q.issue_examples(d, coerce_double("period_txt").isNull() & F.col("period_txt").isNotNull(),
                            "period_txt", k=15)


register("profile_issue_examples", f"""
SELECT DISTINCT period_txt FROM ({DIRTY_ORDERS_SQL}) d
WHERE period_txt IS NOT NULL AND TRY_CAST(period_txt AS DOUBLE) IS NULL ORDER BY period_txt LIMIT 15
""")(profile_issue_examples)


def duplicate_rows(spark, root):
    d = dirty_orders(spark, root).select("entity_txt", "period_txt", "cat1_txt", "cat3_txt")
    return Q.duplicate_rows(d)


register("duplicate_rows", f"""
SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS n FROM ({DIRTY_ORDERS_SQL}) d GROUP BY entity_txt, period_txt, cat1_txt, cat3_txt) t
""")(duplicate_rows)


def period_range(spark, root):
    return Q.period_range(dirty_orders(spark, root), "period_txt")


register("period_range", f"""
SELECT min(CAST(TRY_CAST(period_txt AS DOUBLE) AS BIGINT)) AS period_min,
       max(CAST(TRY_CAST(period_txt AS DOUBLE) AS BIGINT)) AS period_max
FROM ({DIRTY_ORDERS_SQL}) d
""")(period_range)


# --------------------------------------------------------------------------
# pattern_scan over every line of every document
# --------------------------------------------------------------------------

def pattern_scan(spark, root):
    docs = table(spark, root, "documents", ["doc_id", "text"])
    return Q.pattern_scan(Q.split_lines(docs, "text", "doc_id"))


def _scan_sql():
    br = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
    parts = []
    for kind, label, rx, skip in Q.SCAN_PATTERNS:
        cond = f"regexp_matches(line, '{rx.replace(chr(39), chr(39) * 2)}')"
        if skip:
            cond += f" AND NOT contains(upper(line), '{skip}')"
        parts.append(f"SELECT doc_id, line_no, '{kind}' AS type, '{label}' AS reason, "
                     f"substring(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 240) AS content "
                     f"FROM lines WHERE {cond}")
    return f"""
WITH sp AS (SELECT doc_id, string_split_regex(regexp_replace(text, '({br})\\z', ''), '{br}') AS ls FROM documents),
lines AS (SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line_no, unnest(ls) AS line FROM sp)
""" + "\nUNION ALL\n".join(parts)


register("pattern_scan", _scan_sql())(pattern_scan)


def scan_gate(spark, root):
    return Q.scan_gate(pattern_scan(spark, root))


register("scan_gate", "WITH f AS (" + _scan_sql() + """)
SELECT CAST(count(*) AS BIGINT) AS n_findings, count(*) > 0 AS blocked FROM f""")(scan_gate)


# --------------------------------------------------------------------------
# filter report (P14), schema table (Q1), contract (Q7), content hashes
# --------------------------------------------------------------------------

from ..functions.hashing import sha256_hex  # noqa: E402
from ..functions.text import strip_ws  # noqa: E402
from ..operators.clean import filter_with_report  # noqa: E402
from .roles import ORDER_EVENTS_SQL, p1_panel  # noqa: E402


def filter_report(spark, root):
    d = dirty_orders(spark, root).withColumn("entity", strip_ws("entity_txt"))
    _, report = filter_with_report(d, coerce_double("sev1_txt").isNotNull(), "entity")
    return report


register("filter_report", f"""
WITH d AS ({DIRTY_ORDERS_SQL})
SELECT CAST(count(*) AS BIGINT) AS rows_before,
       CAST(count(*) FILTER (WHERE TRY_CAST(sev1_txt AS DOUBLE) IS NULL) AS BIGINT) AS rows_removed,
       CAST(count(DISTINCT CASE WHEN TRY_CAST(sev1_txt AS DOUBLE) IS NULL
                                THEN regexp_replace(entity_txt, '^\\s+|\\s+$', '', 'g') END) AS BIGINT) AS entities_touched
FROM d""")(filter_report)


def schema_table(spark, root):
    return Q.schema_table(spark, table(spark, root, "orders"))


register("schema_table", """WITH n AS (SELECT CAST(count(*) AS BIGINT) AS n_rows FROM orders),
c(position, "column", dtype) AS (VALUES (1, 'o_orderkey', 'bigint'), (2, 'o_custkey', 'bigint'), (3, 'o_orderstatus', 'string'),
  (4, 'o_totalprice', 'double'), (5, 'o_orderdate', 'timestamp_ntz'), (6, 'o_orderpriority', 'string'))
SELECT CAST(position AS BIGINT) AS position, "column", dtype, true AS nullable, n_rows, CAST(6 AS BIGINT) AS n_columns FROM c CROSS JOIN n""")(schema_table)


PROFILE_COLS = [*DIRTY_COLS, "o_totalprice", "price_change"]
PROFILE_TOP, PROFILE_NUMBERS = ["group_txt", "cat1_txt", "cat3_txt"], ["o_totalprice", "price_change"]


def profile_table(spark, root):
    """Q10 over the dirty orders with their price and a signed number."""
    o = table(spark, root, "orders", ["o_orderkey", "o_totalprice"])
    d = dirty_orders(spark, root).join(o, "o_orderkey").withColumn("price_change", F.floor("o_totalprice") % 1000 - 400)
    checks = {"missing_entity_or_period": F.col("entity_txt").isNull() | F.col("period_txt").isNull(),
              "null_severity": F.col("sev1_txt").isNull() | F.col("sev2_txt").isNull(),
              "unknown_category": F.lower(strip_ws("cat3_txt")) == "unknown"}
    return Q.profile_table(d.select(*PROFILE_COLS), PROFILE_TOP, PROFILE_NUMBERS, checks)


_P = lambda section, column, metric, value, text="NULL": (
    f"SELECT '{section}' AS section, {column} AS \"column\", {metric} AS metric, CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text")
_TYPES = {c: "string" for c in DIRTY_COLS} | {"o_totalprice": "double", "price_change": "bigint"}
register("profile_table", f"""WITH d AS (
  SELECT {', '.join(DIRTY_COLS)}, o.o_totalprice, CAST(floor(o.o_totalprice) AS BIGINT) % 1000 - 400 AS price_change
  FROM ({DIRTY_ORDERS_SQL}) x JOIN orders o ON o.o_orderkey = x.o_orderkey),
t AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC NULLS FIRST) AS r FROM d GROUP BY {c}"
    for c in PROFILE_TOP) + ")\n" + "\nUNION ALL ".join(
    [_P("basic", "NULL", "'rows'", "count(*)") + " FROM d", _P("basic", "NULL", "'columns'", len(PROFILE_COLS))]
    + [_P("basic", f"'{c}'", "'dtype'", "NULL", f"'{k}'") for c, k in _TYPES.items()]
    + [x for c in PROFILE_COLS for x in (
        _P("quality", f"'{c}'", "'missing_count'", f"count(*) FILTER (WHERE {c} IS NULL)") + " FROM d",
        _P("quality", f"'{c}'", "'missing_pct'", f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2)") + " FROM d",
        _P("quality", f"'{c}'", "'unique_values'", f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)") + " FROM d")]
    + [_P("quality", "NULL", "'duplicate_rows'", "COALESCE(sum(n - 1), 0)") + f" FROM (SELECT count(*) AS n FROM d GROUP BY {', '.join(PROFILE_COLS)}) z"]
    + [_P("top", "c", "'rank_' || r", "n", "v") + " FROM t WHERE r <= 10"]
    + [_P("numeric", f"'{c}'", f"'{m}'", e) + " FROM d" for c in PROFILE_NUMBERS for m, e in (
        ("mean", f"round(avg({c}), 6)"), ("median", f"round(quantile_cont({c}, 0.5), 6)"), ("min", f"round(min({c}), 6)"), ("max", f"round(max({c}), 6)"),
        ("negatives", f"count(*) FILTER (WHERE {c} < 0)"))]
    + [_P("issues", "NULL", "'missing_entity_or_period'", "count(*) FILTER (WHERE entity_txt IS NULL OR period_txt IS NULL)") + " FROM d",
       _P("issues", "NULL", "'null_severity'", "count(*) FILTER (WHERE sev1_txt IS NULL OR sev2_txt IS NULL)") + " FROM d",
       _P("issues", "NULL", "'unknown_category'", r"count(*) FILTER (WHERE lower(regexp_replace(cat3_txt, '^\s+|\s+$', '', 'g')) = 'unknown')") + " FROM d"]))(profile_table)

# The panel contract (column order, required columns, type families).
PANEL_CONTRACT = {
    "columns": ["c_custkey", "year", "r_name", "n_events", "amount", "qty", "cat1_mode", "cat2_mode", "cat3_mode"],
    "required": ["c_custkey", "year", "n_events", "amount", "qty"],
    "types": {"c_custkey": "long", "year": "long", "r_name": "string", "n_events": "long", "amount": "double",
              "qty": "double", "cat1_mode": "string", "cat2_mode": "string", "cat3_mode": "string"},
}


def contract_panel(spark, root):
    """Q7: the customer-year panel in contract order; the schema is checked
    (metadata) and the primary key is verified unique before returning."""
    p = p1_panel(spark, root).select(*PANEL_CONTRACT["columns"])
    Q.validate_contract(p, PANEL_CONTRACT)
    Q.assert_unique(p, ["c_custkey", "year"])
    return p.withColumns({"amount": F.round("amount", 2), "qty": F.round("qty", 2)})


_K = ["c_custkey", "year"]
_MODES = "\n".join([
    __import__('panelkit.plans.sqlkit', fromlist=['mode_cte']).mode_cte(n, 'ev', _K, c, o) + ","
    for n, c, o in [("m0", "r_name", "r_name"), ("m1", "o_orderpriority", "cat1_mode"),
                    ("m2", "c_mktsegment", "cat2_mode"), ("m3", "o_orderstatus", "cat3_mode")]])
register("contract_panel", f"""WITH ev AS ({ORDER_EVENTS_SQL}),
{_MODES}
agg AS (SELECT c_custkey, year, CAST(count(*) AS BIGINT) AS n_events, round(COALESCE(sum(o_totalprice), 0), 2) AS amount,
               round(COALESCE(sum(o_qty), 0), 2) AS qty FROM ev GROUP BY c_custkey, year)
SELECT agg.c_custkey, agg.year, m0.r_name, n_events, amount, qty, cat1_mode, cat2_mode, cat3_mode
FROM agg JOIN m0 USING (c_custkey, year) JOIN m1 USING (c_custkey, year) JOIN m2 USING (c_custkey, year)
JOIN m3 USING (c_custkey, year)""")(contract_panel)


def content_hashes(spark, root):
    d = table(spark, root, "documents", ["doc_id", "text"])
    return d.select("doc_id", sha256_hex("text").alias("sha256"))


register("content_hashes", "SELECT doc_id, sha256(text) AS sha256 FROM documents")(content_hashes)


def content_digest(spark, root):
    """K4: one digest over the hashes of all documents in order of their ids."""
    from ..sources.publish import merkle_digest
    return merkle_digest(content_hashes(spark, root), "doc_id", "sha256")


register("content_digest", """WITH h AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, sha256(text) AS h FROM documents),
l1 AS (SELECT k // 1024 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM h GROUP BY k // 1024),
l2 AS (SELECT k // 1024 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l1 GROUP BY k // 1024),
n AS (SELECT count(*) AS n FROM h)
SELECT CASE WHEN n = 1 THEN (SELECT max(h) FROM h) WHEN n <= 1024 THEN (SELECT max(h) FROM l1) ELSE (SELECT max(h) FROM l2) END AS digest,
       CAST(n AS BIGINT) AS n FROM n""")(content_digest)


# --------------------------------------------------------------------------
# row filters of their own: complete rows, empty strings, excluded names
# --------------------------------------------------------------------------

from ..operators import clean as C  # noqa: E402
from .roles import strip_sql  # noqa: E402

USED_COLS = ["entity_txt", "period_txt", "sev1_txt", "sev2_txt"]
# Names that are no single market here.
EXCLUDED_NAMES = ["NATION_3", "NATION_7", "NATION_11"]


def complete_rows(spark, root):
    """P4 + P5: rows with every used column and a category that is not empty."""
    d = C.drop_empty(C.complete_cases(dirty_orders(spark, root), USED_COLS), "cat3_txt")
    return d.select("o_orderkey", *USED_COLS, "cat3_txt")


register("complete_rows", f"""SELECT o_orderkey, {', '.join(USED_COLS)}, cat3_txt FROM ({DIRTY_ORDERS_SQL}) d
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in USED_COLS)} AND {strip_sql('cat3_txt')} <> ''""")(complete_rows)


def named_entities(spark, root):
    """Rows of entities that the exclude list does not name; a row without a
    name is none of those."""
    d = C.entity_rows(dirty_orders(spark, root), name_col="entity_txt", exclude_names=EXCLUDED_NAMES)
    return d.select("o_orderkey", strip_ws("entity_txt").alias("entity"))


register("named_entities", f"""SELECT o_orderkey, {strip_sql('entity_txt')} AS entity FROM ({DIRTY_ORDERS_SQL}) d
WHERE COALESCE({strip_sql('entity_txt')} NOT IN ({', '.join(f"'{n}'" for n in EXCLUDED_NAMES)}), true)""")(named_entities)
