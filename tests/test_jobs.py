"""Jobs end to end: every output is read back; a blocked run publishes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from panelkit import jobs
from panelkit.plans import q_models
from panelkit.plans.q_quality import PANEL_CONTRACT
from panelkit.sources import publish as P
from panelkit.sources import sinks as SK

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_final_table_is_published_with_its_reports(spark, tmp_path):
    out = str(tmp_path / "final")
    secret = spark.createDataFrame([(1, "x\nkey AKIA" + "A" * 16)], "k long, note string")
    with pytest.raises(P.Blocked):
        jobs.build_final_table(spark, SF, out, more={"notes": secret})
    assert P.versions(spark, out) == []
    blocked, = os.listdir(f"{out}/blocked")
    hit = spark.read.json(f"{out}/blocked/{blocked}/scan").first()
    assert (hit.table, hit.column, hit.line_no, hit.reason) == ("notes", "note", 2, "aws_access_key")

    version = jobs.build_final_table(spark, SF, out, actor="tester")
    final = P.read_published(spark, out, "final_table")
    assert final.columns == PANEL_CONTRACT["columns"]
    n = final.count()
    diagnostics = P.read_published(spark, out, "diagnostics").first()
    assert diagnostics.row_count == n and diagnostics.duplicate_keys == 0
    schema = {r.column: r for r in P.read_published(spark, out, "schema").collect()}
    assert list(schema) and all(r.n_rows == n and r.n_columns == len(final.columns) for r in schema.values())
    profile = {(r.section, r.column, r.metric): r.value for r in P.read_published(spark, out, "profile").collect()}
    assert profile["basic", None, "rows"] == n and profile["quality", "c_custkey", "unique_values"] == final.select("c_custkey").distinct().count()
    assert profile["numeric", "amount", "max"] == pytest.approx(final.agg(F.max("amount")).first()[0])
    folder = f"{out}/versions/{version}"
    assert spark.read.option("header", True).csv(f"{folder}/final_table_csv").count() == n
    assert spark.read.json(f"{folder}/diagnostics_json").first().row_count == n and spark.read.json(f"{folder}/schema_json").count() == len(schema)
    entry, = spark.read.schema(SK.LEDGER_SCHEMA).json(f"{out}/ledger").collect()
    assert entry.action == "build_final_table" and entry.actor == "tester" and len(entry.input_hash) == 64
    assert entry.output_hashes["final_table"] == P.table_digest(final) and len(entry.inputs) == len(jobs.PANEL_INPUTS) + 1


def test_contract_breach_publishes_nothing(spark, tmp_path):
    out = str(tmp_path / "broken")
    twice = spark.createDataFrame([(1, 2000), (1, 2000)], "k long, year long")
    check = lambda t: jobs.contract_findings(t["panel"], {"columns": ["k", "year"]}, ["k", "year"])
    with pytest.raises(P.Blocked):
        P.publish(spark, out, {"panel": twice}, "build", checks={"contract": check})
    with pytest.raises(ValueError):
        P.publish(spark, out, {"panel": twice.select("year", "k")}, "build", checks={"contract": check})
    assert P.versions(spark, out) == []


def test_predictions_of_both_levels_are_published_with_metrics(spark, tmp_path, monkeypatch):
    small = {"trees": 5, "depth": 4}
    monkeypatch.setattr(q_models.MD, "forest_classifier", lambda d, y, f=q_models.MD.forest_classifier: f(d, y, **small))
    out = str(tmp_path / "risk")
    jobs.score_risk(spark, SF, out)
    predictions, metrics = (P.read_published(spark, out, t) for t in ("risk_predictions", "risk_metrics"))
    models = {"majority", "logistic", "tree", "forest"}
    assert {(r.level, r.model) for r in metrics.collect()} == {(a, m) for a in ("entity", "group") for m in models}
    assert predictions.where("level = 'entity' AND (c_custkey IS NULL OR r_name IS NOT NULL)").count() == 0
    assert predictions.where("level = 'group' AND (r_name IS NULL OR c_custkey IS NOT NULL)").count() == 0
    of = {(r.level, r.model): r for r in metrics.collect()}
    for level in ("entity", "group"):
        assert {r.n for (a, _), r in of.items() if a == level} == {predictions.where(f"level = '{level}' AND model = 'tree'").count()}
        assert of[level, "majority"].auc is None and 0 <= of[level, "logistic"].auc <= 1
