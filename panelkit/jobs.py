"""Jobs that publish: the final panel with its reports, and the risk predictions
with their metrics. Each writes all its tables as one version (see
``sources.publish``): contract and pattern scan read back what was written, and a
finding of either publishes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import evaluate as EV
from .operators import quality as Q
from .plans.q_models import risk_predictions
from .plans.q_quality import PANEL_CONTRACT
from .plans.roles import p1_panel
from .sources.publish import publish
from .sources.readers import file_hashes
from .sources.sinks import hash_of_hashes

#: Tables that the panel is built from.
PANEL_INPUTS = ("orders", "customer", "nation", "region", "lineitem")


def _input_hash(spark: SparkSession, root: str, names) -> tuple[list[str], str]:
    paths = [f"{root.rstrip('/')}/{n}.parquet" for n in names]
    return paths, hash_of_hashes(file_hashes(spark, paths)).first()["input_hash"]


def contract_findings(df: DataFrame, contract: dict, keys) -> DataFrame:
    """Breaches of the contract: of the schema as an error, of the key as rows."""
    Q.validate_contract(df, contract)
    return Q.duplicate_keys(df, keys)


def text_findings(tables: dict[str, DataFrame]) -> DataFrame | None:
    """Hits of the pattern scan in the text columns of all tables: (table, column,
    line_no, type, reason, content)."""
    out = None
    for name, df in tables.items():
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StringType):
                texts = df.select(F.col(f"`{f.name}`").alias("text")).where("text IS NOT NULL").distinct().select(
                    F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("column")).alias("at"), "text")
                hits = Q.pattern_scan(Q.split_lines(texts, "text", "at")).select("at.table", "at.column", "line_no", "type", "reason", "content")
                out = hits if out is None else out.unionByName(hits)
    return out


def build_final_table(spark: SparkSession, root: str, out: str, more: dict[str, DataFrame] | None = None, actor: str | None = None) -> str:
    """Build the customer-year panel in contract order and publish it in Parquet
    and CSV with its diagnostics, schema report and profile (and tables in
    ``more``). Returns the version; raises ``Blocked`` or ``ContractError`` and
    publishes nothing where a check fails."""
    keys = ["c_custkey", "year"]
    panel = p1_panel(spark, root).select(*PANEL_CONTRACT["columns"])
    paths, digest = _input_hash(spark, root, PANEL_INPUTS)
    numbers = [f.name for f in panel.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    groups = [f.name for f in panel.schema.fields if isinstance(f.dataType, T.StringType)]
    tables = {
        "final_table": panel,
        "diagnostics": Q.panel_diagnostics(panel.withColumn("has_qty", F.col("qty") > 0), *keys, {"quantity": "has_qty"}),
        "schema": Q.schema_table(spark, panel),
        "profile": Q.profile_table(panel, groups, numbers, {"no_quantity": F.col("qty") == 0}),
    } | (more or {})
    return publish(spark, out, tables, "build_final_table", paths, digest, checks={
        "contract": lambda t: contract_findings(t["final_table"], PANEL_CONTRACT, keys), "scan": text_findings,
    }, csv=["final_table"], json_copies=["diagnostics", "schema"], actor=actor)


def score_risk(spark: SparkSession, root: str, out: str, actor: str | None = None) -> str:
    """Publish the test predictions of the risk classifiers on both panel levels
    and their metrics by (level, model)."""
    paths, digest = _input_hash(spark, root, (*PANEL_INPUTS, "supplier"))
    predictions = risk_predictions(spark, root)
    return publish(spark, out, {"risk_predictions": predictions, "risk_metrics": EV.metrics_by(predictions, ["level", "model"])}, "score_risk", paths, digest,
                   checks={"scan": text_findings}, csv=["risk_metrics"], partition_by={"risk_predictions": "level"}, actor=actor)
