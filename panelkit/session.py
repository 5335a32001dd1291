"""Spark session and cluster-facing settings.

Library code never creates its own session: every operator takes a
DataFrame (or a session handed in by the caller).  This module only
builds a session for tests, the bench and command-line runs, and
resolves the shared checkpoint folder the cluster names.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins and partition counts at
# runtime, splits skewed shuffle partitions and converts sort-merge joins to
# broadcast joins only when the measured side is below the threshold.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files are removed once their DataFrame is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "panelkit",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, spark-submit supplies master and
    resources; only the scale settings above are added."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("PANELKIT_DRIVER_MEM", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is only read here.
    A private folder is created only when the setting is unset and the master
    is local (tests, local runs); elsewhere an unset folder is an error, since
    executors do not share a local one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set; master {master} needs a shared folder there")
        d = tempfile.mkdtemp(prefix="panelkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and return a DataFrame reading it.

    Used on *aggregated* intermediates that several branches of a plan read
    (a panel is orders of magnitude smaller than its events): the plan runs
    once (a single pass - ``Dataset.checkpoint`` would run it twice without
    a cache), later branches read the written copy with column pruning and
    filter pushdown, and Catalyst plans a short lineage. The folder is the
    cluster's ``spark.checkpoint.dir`` (shared storage), so the copy
    survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_drop_at_exit, spark)
    _WRITTEN.append(path)
    df.write.mode("overwrite").parquet(path)
    copy = spark.read.parquet(path)
    _PATHS[copy] = path
    return copy


#: Copies that this application has written, and the frames that were returned for them.
_WRITTEN: list[str] = []
_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def copy_path(copy) -> str:
    """Where ``cut_lineage`` wrote ``copy``."""
    return _PATHS[copy]


def reading_session(spark: SparkSession, task_bytes: int) -> SparkSession:
    """A session on the same application that reads ``task_bytes`` of files in a
    task, and removes the shuffle files of a query when it ends; ``spark`` keeps its settings."""
    own = spark.newSession()
    for k, v in {"spark.sql.files.maxPartitionBytes": task_bytes, "spark.sql.files.openCostInBytes": 0,
                 "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}.items():
        own.conf.set(k, str(v))
    return own


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def drop_copy(*copies) -> None:
    """Delete copies that ``cut_lineage`` returned, once all that reads them has
    run; frames that read them are no longer usable."""
    for copy in copies:
        path = _PATHS.pop(copy)
        _WRITTEN.remove(path)
        delete(copy.sparkSession, path)


def drop_copies(spark: SparkSession) -> int:
    """Delete every copy that ``cut_lineage`` wrote; frames that read them are
    no longer usable. Returns how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())
    _BUILT.clear()
    return n


def _drop_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped yet
        drop_copies(spark)


_BUILT: dict = {}


def built_once(spark, key: tuple, build):
    """Return the materialised result of ``build()`` for ``key`` within this
    Spark application: a panel is built (and written) once and every later
    analysis in the session reads the written table, as a panel file is
    built once and then analysed many times."""
    k = (spark.sparkContext.applicationId,) + tuple(key)
    if k not in _BUILT:
        _BUILT[k] = cut_lineage(build())
    return _BUILT[k]
