"""Structured Streaming panel build.

Events arrive as files; each micro-batch is folded into the (entity, period)
aggregate kept in Spark's state store. With an event-time watermark, a
period's state is dropped once the watermark passes its end, so state stays
bounded by the number of open periods x active entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_event_panel(events: DataFrame, entity: str, ts: str, period: str = "1 day",
                       watermark: str = "2 days", sums: dict | None = None,
                       maxes: dict | None = None) -> DataFrame:
    """Streaming A1: per (entity, event-time window) count, sums and maxima.
    ``events`` is a streaming DataFrame; rows with NULL keys are dropped."""
    # watermarks need an instant type; wall-clock timestamps are read in the
    # session time zone
    e = (events.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull())
               .withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark))
    aggs = [F.count(F.lit(1)).alias("n_events")]
    aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(o) for o, c in (sums or {}).items()]
    aggs += [F.max(c).alias(o) for o, c in (maxes or {}).items()]
    g = e.groupBy(F.col(entity), F.window(F.col(ts), period).alias("w")).agg(*aggs)
    return g.select(entity, F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"),
                    *[c for c in g.columns if c not in (entity, "w")])


def start_panel_query(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                      entity: str = "user_id", ts: str = "ts", **kw):
    """Run the streaming panel from Parquet files in ``source_dir`` into a
    Parquet sink (append mode: a period is written once the watermark closes
    it). The checkpoint folder must be on shared storage."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source_dir)
    panel = stream_event_panel(src, entity, ts, **kw)
    return (panel.writeStream.outputMode("append").format("parquet")
                 .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).start())
