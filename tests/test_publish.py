"""Digests, published versions, the ledger, text lines over splits, malformed CSV rows."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from panelkit.sources import publish as P
from panelkit.sources import readers as RD
from panelkit.sources import sinks as SK


def tree(hashes, fan):
    while len(hashes) > 1:
        hashes = [hashlib.sha256("".join(hashes[k:k + fan]).encode()).hexdigest() for k in range(0, len(hashes), fan)]
    return hashes[0] if hashes else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 17, 64, 65])
def test_merkle_digest_equals_a_tree_whatever_the_partitions(spark, n):
    rows = [(f"p{i:03d}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]
    df = spark.createDataFrame(rows, "path string, sha256 string")
    want = tree([h for _, h in sorted(rows)], 4)
    for parts in (1, 7):
        got = P.merkle_digest(df.orderBy(F.desc("path")).repartition(parts), "path", "sha256", fan=4).first()
        assert (got.digest, got.n) == (want, n)
    assert SK.hash_of_hashes(df).first().input_hash == tree([h for _, h in sorted(rows)], 1024)


def test_table_digest_ignores_order_and_sees_every_value(spark):
    rows = [(i, None if i == 3 else f"t{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "a long, b string")
    assert P.table_digest(df) == P.table_digest(df.select("b", "a").repartition(3).orderBy(F.desc("a")))
    assert P.table_digest(df) != P.table_digest(df.fillna("t3"))


def test_published_versions_blocked_runs_and_ledger(spark, tmp_path):
    root = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, root, "panel")
    panel = spark.createDataFrame([(1, 2000, "x"), (2, 2000, "y")], "k long, year long, name string")
    one = P.publish(spark, root, {"panel": panel, "report": panel.limit(1)}, "build", ["in.csv"], "abc", csv=["panel"], json_copies=["report"],
                    partition_by={"panel": "year"}, actor="tester")
    assert sorted(r.k for r in P.read_published(spark, root, "panel").collect()) == [1, 2]
    assert spark.read.option("header", True).csv(f"{root}/versions/{one}/panel_csv").count() == 2
    assert spark.read.json(f"{root}/versions/{one}/report_json").count() == 1
    # a check with findings publishes nothing and keeps the findings
    bad = panel.withColumn("k", F.col("k") + 5)
    with pytest.raises(P.Blocked):
        P.publish(spark, root, {"panel": bad}, "build", checks={"scan": lambda t: t["panel"].where("k = 6"), "never": lambda t: 1 / 0})
    assert P.versions(spark, root) == [one] and sorted(r.k for r in P.read_published(spark, root, "panel").collect()) == [1, 2]
    assert len(os.listdir(f"{root}/blocked")) == 1
    # a job that dies half way leaves no version; the next run removes its folder
    with pytest.raises(ZeroDivisionError):
        P.publish(spark, root, {"panel": bad}, "build", checks={"fails": lambda t: 1 / 0})
    assert P.versions(spark, root) == [one]
    two = P.publish(spark, root, {"panel": bad}, "build", checks={"none": lambda t: None, "empty": lambda t: t["panel"].where("k < 0")})
    assert P.versions(spark, root) == [one, two] and len(os.listdir(f"{root}/versions")) == 2
    assert sorted(r.k for r in P.read_published(spark, root, "panel").collect()) == [6, 7]
    assert sorted(r.k for r in P.read_published(spark, root, "panel", one).collect()) == [1, 2]
    ledger = spark.read.schema(SK.LEDGER_SCHEMA).json(f"{root}/ledger").collect()
    assert sorted(x for r in ledger for x in r.inputs) == ["in.csv", f"version:{one}", f"version:{two}"]
    first = next(r for r in ledger if "in.csv" in r.inputs)
    assert first.input_hash == "abc" and first.actor == "tester" and first.output_hashes["panel"] == P.table_digest(panel)


def test_ledger_row_cut_off_by_a_crash_is_added_by_the_next_run(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([(1,)], "k long")
    real = P.append_ledger
    monkeypatch.setattr(P, "append_ledger", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        P.publish(spark, root, {"t": df}, "build")
    monkeypatch.setattr(P, "append_ledger", real)
    assert len(P.versions(spark, root)) == 1
    P.publish(spark, root, {"t": df}, "build")
    assert spark.read.schema(SK.LEDGER_SCHEMA).json(f"{root}/ledger").count() == 2


TEXTS = {"a.txt": "one\ntwo\r\n\nfour\x0bfive\nlast", "b.txt": "x\n" * 40 + "tail\x1c", "c.txt": "", "d.txt": "\n", "e.txt": "only",
         "f.txt": "é漢 zwei\r\ndrei\x0b\n\x0b\n", "g.txt": "q\r\n" * 30, "h.txt": "m\rn\r"}


@pytest.mark.parametrize("split", ["16b", "64b", "128m"])
def test_line_numbers_over_splits_equal_splitlines(spark, tmp_path, split):
    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = RD.read_text_lines(spark, str(tmp_path))
        got = {}
        for r in df.collect():
            got.setdefault(os.path.basename(r.file), []).append((r.line_no, r.line))
        if split == "16b":
            raw = spark.read.option("lineSep", "\n").text(str(tmp_path / "b.txt"))
            assert raw.select("_metadata.file_block_start").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(t.splitlines(), 1)) for k, t in TEXTS.items() if t}


def test_malformed_csv_rows_are_counted_and_limited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,name,v\n1,"x, y",2.5\n2,short\n3,z,notanumber\n4,"say ""hi""",1\n')
    (tmp_path / "b.csv").write_text("k,name,v\n5,w,\n")
    schema = "k long, name string, v double"
    good, report = RD.read_csv_counted(spark, str(tmp_path), schema)
    assert sorted((r.k, r.name, r.v) for r in good.collect()) == [(1, "x, y", 2.5), (4, 'say "hi"', 1.0), (5, "w", None)]
    assert sorted((os.path.basename(r.file), r.n_rows, r.n_bad, r.example) for r in report.collect()) == [("a.csv", 4, 2, "2,short"), ("b.csv", 1, 0, None)]
    with pytest.raises(RD.MalformedRows):
        RD.read_csv_counted(spark, str(tmp_path), schema, max_bad=1)
    assert good.select("v").count() == 3


def test_files_without_breaks_in_quotes_are_split(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("k,t\n" + "".join(f'{i},"t{i}"\n' for i in range(400)))
    (tmp_path / "breaks.csv").write_text('k,t\n1,"a\nb"\n')
    plain, breaks = str(tmp_path / "plain.csv"), str(tmp_path / "breaks.csv")
    assert not RD.quotes_hold_breaks(spark, plain) and RD.quotes_hold_breaks(spark, breaks)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        df = RD.read_csv(spark, plain, "k long, t string", multi_line=None)
        assert df.rdd.getNumPartitions() > 2 and df.count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.k, r.t) for r in RD.read_csv(spark, breaks, "k long, t string", multi_line=None).collect()] == [(1, "a\nb")]
