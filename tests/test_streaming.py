"""The streaming panel equals the batch aggregate of the same events."""

import os

import pytest
from pyspark.sql import functions as F

from panelkit.streaming import stream_event_panel

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_stream_panel_matches_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    src = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    panel = stream_event_panel(src, "user_id", "ts", "1 day", "365 days", sums={"value_sum": "value"})
    q = (panel.writeStream.outputMode("complete").format("memory").queryName("panel_stream_test")
              .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.period_start.date()): (r.n_events, round(r.value_sum, 6))
           for r in spark.sql("SELECT * FROM panel_stream_test").collect()}
    exp = {(r.user_id, r.d): (r.n, round(r.s, 6)) for r in
           ev.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"),
                                                                 F.sum("value").alias("s")).collect()}
    assert got == exp
