"""Publishing a job's outputs as one step (K1-K5, Q7, Q8).

All tables of a run are written to a version folder of their own, read back and
checked there; a version counts only once its commit marker exists, and the marker
is one file, written last. A run that fails or is blocked leaves a folder without a
marker, which readers never see and the next run removes. The ledger gets one row
for each committed version; a row that a crash cut off is added by the next run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import row_numbers
from .sinks import append_ledger, write_csv, write_json, write_table

#: Digests that go into one digest of the next level.
FAN = 1024
MARKER = "COMMITTED.json"


class Blocked(RuntimeError):
    """A check stopped the publication; nothing was published."""


# ---- digests ----------------------------------------------------------------

def merkle_digest(df: DataFrame, order, hash_col: str, fan: int = FAN) -> DataFrame:
    """One row (``digest``, ``n``): a tree of SHA-256 digests over the rows in
    ``order`` (names; ties by the hash). Rows get their numbers from range
    partitions; ``fan`` neighbours make one digest, and so on up to the root, so
    that no task holds more than ``fan`` digests and the result depends on rows
    and order alone, not on partitions. Without rows: the digest of nothing, 0."""
    order = [order] if isinstance(order, str) else list(order)
    rows = row_numbers(df.select(*order, F.col(hash_col).alias("__h")), [*order, "__h"], "__rn").select(
        (F.col("__rn") - 1).alias("at"), F.col("__h").alias("hash"))
    n = left = df.count()
    while left > 1:
        near = F.array_sort(F.collect_list(F.struct("at", "hash")))  # at most ``fan``
        rows = rows.groupBy(F.floor(F.col("at") / fan).alias("up")).agg(
            F.sha2(F.concat_ws("", F.transform(near, lambda x: x["hash"])), 256).alias("hash")).select(F.col("up").alias("at"), "hash")
        left = -(-left // fan)
    top = rows.agg(F.coalesce(F.max("hash"), F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))
    return top.withColumn("n", F.lit(n).cast("long"))


def table_digest(df: DataFrame) -> str:
    """The digest of a table's rows, whatever their order and partitions."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    return merkle_digest(df.select(row.alias("h")), "h", "h").first()["digest"]


# ---- files ----------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def _write_file(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, False)  # fails where the file exists
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_file(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def versions(spark: SparkSession, root: str) -> list[str]:
    """Committed versions, oldest first."""
    return sorted(v for v in _names(spark, f"{root}/versions") if MARKER in _names(spark, f"{root}/versions/{v}"))


def read_published(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a committed version (default: the latest)."""
    known = versions(spark, root)
    if version is None and not known:
        raise FileNotFoundError(f"nothing is published in {root}")
    if version is not None and version not in known:
        raise FileNotFoundError(f"version {version} is not published in {root}")
    return spark.read.parquet(f"{root}/versions/{version or known[-1]}/{name}")


# ---- the step -----------------------------------------------------------------

def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], action: str, inputs=(), input_hash: str = "",
            checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame | None]] | None = None, csv=(), json_copies=(),
            partition_by: dict | None = None, actor: str | None = None) -> str:
    """Write ``tables`` as a new version and return its name.

    Each check is called with the tables as read back and returns findings (or
    None; it may also raise, as ``validate_contract`` does). With findings nothing
    is published: they are kept as ``{root}/blocked/{version}/{check}`` and
    ``Blocked`` is raised. Tables named in ``csv`` or ``json_copies`` are written
    in that form as well. Publishing is one writer's task: two runs into one root
    at a time would remove each other's unfinished version."""
    _drop_unfinished(spark, root)
    _complete_ledger(spark, root)
    known = versions(spark, root)
    number = int(known[-1].split("-")[0]) + 1 if known else 1
    version = f"{number:012d}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/versions/{version}"
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", (partition_by or {}).get(name))
    written = {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
    for check, run in (checks or {}).items():
        findings = run(written)
        if findings is not None and findings.limit(1).count():
            write_json(findings, f"{root}/blocked/{version}/{check}")
            raise Blocked(f"{check}: see {root}/blocked/{version}/{check}")
    for name in csv:
        write_csv(written[name], f"{folder}/{name}_csv")
    for name in json_copies:
        write_json(written[name], f"{folder}/{name}_json")
    told = {"action": action, "inputs": list(inputs), "input_hash": input_hash, "actor": actor,
            "output_hashes": {name: table_digest(df) for name, df in written.items()}}
    _write_file(spark, f"{folder}/{MARKER}", json.dumps(told))
    _complete_ledger(spark, root)
    return version


def _drop_unfinished(spark: SparkSession, root: str) -> None:
    done = set(versions(spark, root))
    for v in _names(spark, f"{root}/versions"):
        if v not in done:
            fs, at = _fs(spark, f"{root}/versions/{v}")
            fs.delete(at, True)


def _complete_ledger(spark: SparkSession, root: str) -> None:
    """A ledger row for each committed version that has none."""
    ledger = f"{root}/ledger"
    have = set()
    if any(not x.startswith(("_", ".")) for x in _names(spark, ledger)):
        rows = spark.read.schema("inputs array<string>").json(ledger)
        have = {r[0] for r in rows.select(F.explode("inputs").alias("x")).where("x LIKE 'version:%'").distinct().collect()}
    for v in versions(spark, root):
        if f"version:{v}" not in have:
            told = json.loads(_read_file(spark, f"{root}/versions/{v}/{MARKER}"))
            append_ledger(spark, ledger, told["action"], [*told["inputs"], f"version:{v}"], told["input_hash"], told["output_hashes"], told["actor"])
