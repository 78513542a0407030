"""Evidence as a stream: analysed on arrival, deduplicated, counted per time window and per session.

The flows use the same operators as the batch queries. Sinks are files with Spark's own sink log, so a
restart neither loses nor repeats rows. Running state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vestigia.operators import indicators, rollups
from vestigia.operators.common import count_where

SESSION_GAP = "5 minutes"


def arriving(spark: SparkSession, folder: str, pattern: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """Parquet files that appear in a folder. What fits the pattern is a file or, as a table of several files, a folder. The braces make it a
    pattern in any case: Spark takes a path without one for a folder."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{folder.rstrip('/')}/{{{pattern}}}")


def closing(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and what arrives in `folder`: a last row with a late time there moves the watermark past all data, so that every
    window and session is closed and written."""
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(folder))


def analysed(stream: DataFrame, text: str, max_bytes: int) -> DataFrame:
    """Status, indicator counts and risk per item; too large items are kept with an error and no analysis."""
    sized = stream.withColumn("size_bytes", F.octet_length(text).cast("long"))
    fits = F.col("size_bytes") <= max_bytes
    found = indicators.with_indicators(sized.withColumn("_text", F.when(fits, F.col(text)).otherwise("")), "_text")
    counted = rollups.local_severity_counts(found, indicators.indicator_rules())
    return counted.withColumns({
        "status": F.when(fits, "ok").otherwise("error"), "error": F.when(~fits, "too large"),
        "risk_level": F.when(fits, F.col("risk_level")).otherwise("UNKNOWN"),
    })


def once_per_digest(stream: DataFrame, digest: str, ts: str, lateness: str) -> DataFrame:
    """The first arrival of each digest within the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([digest])


def severity_windows(stream: DataFrame, ts: str, lateness: str, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Finding counts per tumbling or sliding window."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = stream.withWatermark(ts, lateness).groupBy(window.alias("w")).agg(*rollups.severity_aggs())
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "high", "medium", "low")


def actor_sessions(stream: DataFrame, actor: str, ts: str, lateness: str, gap: str = SESSION_GAP) -> DataFrame:
    """Bursts of one actor: no pause as long as the gap. Sessions are merged within each task before the shuffle, so that a busy
    actor sends few rows."""
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    sessions = stream.withWatermark(ts, lateness).groupBy(actor, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), count_where(F.col("severity") == "HIGH").alias("high"))
    return sessions.select(actor, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "high")


def run_to_files(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> None:
    """Process everything that is there, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(partition)
    writer.trigger(availableNow=True).start().awaitTermination()
