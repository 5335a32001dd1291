"""Contract, key checks, profiles and the pattern scan."""

import pytest
from pyspark.sql import functions as F

from panelkit.operators import quality as Q

CONTRACT = {"columns": ["k", "y", "v"], "required": ["k", "y"], "types": {"k": "string", "y": "long", "v": "double"}}


def test_contract_passes_and_breaks(spark):
    ok = spark.createDataFrame([("a", 1, 1.0)], "k string, y long, v double")
    Q.validate_contract(ok, CONTRACT)
    with pytest.raises(Q.ContractError):
        Q.validate_contract(ok.select("y", "k", "v"), CONTRACT)
    with pytest.raises(Q.ContractError):
        Q.validate_contract(ok.drop("y"), CONTRACT)
    with pytest.raises(Q.ContractError):
        Q.validate_contract(ok.withColumn("y", F.col("y").cast("string")), CONTRACT)


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, y long")
    with pytest.raises(Q.ContractError):
        Q.assert_unique(df, ["k", "y"])
    Q.assert_unique(df.dropDuplicates(), ["k", "y"])
    assert Q.duplicate_rows(df).first().duplicate_rows == 1


def test_profile_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("c", 1.0)], "s string, v double")
    got = {r.column: (r.null_count, r.null_pct) for r in Q.profile_nulls(df).collect()}
    assert got == {"s": (1, 33.33), "v": (2, 66.67)}


def test_pattern_scan_lines(spark):
    text = "ok line\n  print(request.headers)  \r\nDELETE FROM t WHERE id=1\ndelete from t\nAKIA" + "A" * 16 + "\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lines = Q.split_lines(docs, "text", "doc_id")
    assert lines.count() == 5
    hits = sorted((r.line_no, r.reason, r.content) for r in Q.pattern_scan(lines).collect())
    assert hits == [(2, "logging headers/cookies/tokens", "print(request.headers)"),
                    (4, "DELETE FROM without WHERE", "delete from t"),
                    (5, "aws_access_key", "AKIA" + "A" * 16)]
    assert Q.scan_gate(Q.pattern_scan(lines)).first().blocked


def test_text_sources_and_sinks(spark, tmp_path):
    from panelkit.sources import readers, sinks
    p = tmp_path / "a.csv"
    p.write_bytes("name,val\nZürich,1\n".encode("latin-1"))
    df, enc = readers.read_csv_with_fallback(spark, str(p), "name string, val long")
    assert enc == "ISO-8859-1" and df.first().name == "Zürich"
    r = readers.resolve_column(df, ["value", "val"], "v")
    assert "v" in r.columns
    with pytest.raises(ValueError):
        readers.resolve_column(df, ["nope"])
    out = tmp_path / "out"
    sinks.write_table(r, str(out / "t"), partition_by="v")
    assert spark.read.parquet(str(out / "t")).count() == 1
    h = readers.file_hashes(spark, str(p)).first()
    import hashlib
    assert h.sha256 == hashlib.sha256(p.read_bytes()).hexdigest()
    sinks.append_ledger(spark, str(out / "ledger"), "build", [str(p)], h.sha256, {"t": "x"})
    sinks.append_ledger(spark, str(out / "ledger"), "build", [str(p)], h.sha256, {"t": "y"})
    assert spark.read.json(str(out / "ledger")).count() == 2


def test_nonfinite_lookup_and_csv(spark, tmp_path):
    from panelkit.operators.clean import nonfinite_to_null, filter_with_report
    from panelkit.operators.harmonize import lookup
    from panelkit.sources.sinks import write_csv
    df = spark.createDataFrame([("a", float("inf")), ("b", float("nan")), ("c", 1.0)], "k string, v double")
    assert [r.v for r in nonfinite_to_null(df, ["v"]).orderBy("k").collect()] == [None, None, 1.0]
    kept, rep = filter_with_report(nonfinite_to_null(df, ["v"]), F.col("v").isNotNull(), "k")
    r = rep.first()
    assert (kept.count(), r.rows_before, r.rows_removed, r.entities_touched) == (1, 3, 2, 2)
    dim = spark.createDataFrame([("a", "R1")], "key string, grp string")
    got = {r.k: r.grp for r in lookup(df.withColumnRenamed("k", "key"), dim, "key", "grp").withColumnRenamed("key", "k").collect()}
    assert got == {"a": "R1", "b": "Unknown", "c": "Unknown"}
    write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 3 and back.columns == ["k", "v"]
