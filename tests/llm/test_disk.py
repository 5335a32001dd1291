"""What the operators leave on disk: copies and shuffle files go once nothing reads them."""

import os
import tempfile
import time
from glob import glob

from pyspark.sql import functions as F

from panelkit import session
from panelkit.llm import jaccard_join
from panelkit.llm._common import CLEANUP, materialise

from .test_llm import near_copies


def shuffle_files(spark):
    root = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    return set(glob(f"{root}/**/blockmgr-*/*/shuffle_*.data", recursive=True))


def test_shuffle_files_go_when_the_copy_is_written(spark):
    df = spark.range(200_000).groupBy((F.col("id") % 1009).alias("k")).agg(F.sum("id").alias("s"))
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    copy, late = materialise(df), time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < late:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP) == setting
    assert copy.agg(F.sum("s")).first()[0] == sum(range(200_000)) == df.agg(F.sum("s")).first()[0]


def test_jaccard_join_leaves_the_copies_that_its_result_reads(spark, monkeypatch):
    most, write = [], session.cut_lineage
    monkeypatch.setattr("panelkit.llm._common.cut_lineage", lambda df: (write(df), most.append(len(session._WRITTEN)))[0])
    df = spark.createDataFrame(near_copies(), "doc_id long, text string")
    for search in (jaccard_join.jaccard_components, jaccard_join.jaccard_links):
        start = len(session._WRITTEN)
        most.clear()
        got = search(df)
        paths = session._WRITTEN[start:]
        # components: members and components; links: pairs and whole sets
        assert len(paths) == 2 and all(os.path.isdir(p.removeprefix("file://")) for p in paths)
        assert len(most) > 8 and max(most) - start <= 7  # not one for each step
        assert got.count() and got.count() == len(got.collect())
