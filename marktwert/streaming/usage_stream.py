"""Structured Streaming forms of the usage counters.

Sources are file streams over the request log; sinks are Parquet tables in
the shared folder with checkpoints next to them, so a restarted query (or a
lost executor) resumes exactly where the last committed batch ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.usage import PREDICT_ENDPOINT

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def events_stream(spark: SparkSession, sf_dir: str, max_files: int = 16) -> DataFrame:
    """The ``events`` table as a file stream (new files are new requests); a
    micro-batch takes at most ``max_files`` files, which bounds what one key can
    bring into memory after a backlog."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{sf_dir.rstrip('/')}/events.parq*")


def usage_stream(events: DataFrame) -> DataFrame:
    """Request-log projection of the stream (same rules as the batch view).

    Watermarks need a TIMESTAMP column, so the NTZ time is cast (session
    time zone UTC)."""
    return events.select(
        F.col("event_id").alias("id"), "user_id",
        (F.col("user_id") % 4 + 1).cast("int").alias("subscription_plan_id"),
        F.col("ts").cast("timestamp").alias("request_timestamp"),
        F.when(F.col("event_type") == "view", "GET /cached-predictions")
         .otherwise("POST /predict").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("response_time_ms"))


#: User of heartbeat rows; their windows are left out when the sink is read.
HEARTBEAT_USER = -1


def heartbeat(spark: SparkSession, path: str, at: str) -> None:
    """Add a heartbeat (a request of no real user at time ``at``) to the
    heartbeat files in ``path``."""
    row = spark.range(1).select(
        F.lit(-1).cast("long").alias("event_id"), F.to_timestamp_ntz(F.lit(at)).alias("ts"),
        F.lit(HEARTBEAT_USER).cast("long").alias("user_id"), F.lit("click").alias("event_type"),
        F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    row.write.mode("append").parquet(path)


def with_heartbeats(events: DataFrame, path: str) -> DataFrame:
    """The stream with heartbeats: in quiet times they alone push the watermark
    past the last request, so its window closes.  ``path`` must hold files (a
    first heartbeat at the epoch closes nothing)."""
    beats = events.sparkSession.readStream.schema(EVENTS_SCHEMA).parquet(path)
    return events.unionByName(beats)


def without_heartbeats(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("user_id") != HEARTBEAT_USER)


def minute_windows_stream(usage: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """U4: per-user fixed one-minute windows; a window is emitted once the
    watermark passes its end (append mode)."""
    rows = usage.where(F.col("endpoint").startswith(PREDICT_ENDPOINT) & F.col("user_id").isNotNull())
    return (rows.withWatermark("request_timestamp", watermark)
                .groupBy("user_id", F.window("request_timestamp", "1 minute").alias("w"))
                .agg(F.count(F.lit(1)).alias("requests"))
                .select("user_id", F.col("w.start").alias("window_start"),
                        F.col("w.end").alias("window_end"), "requests"))


def daily_usage_stream(usage: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Per-user daily counts, meant for update mode."""
    rows = usage.where(F.col("endpoint").startswith(PREDICT_ENDPOINT) & F.col("user_id").isNotNull())
    return (rows.withWatermark("request_timestamp", watermark)
                .groupBy("user_id", F.window("request_timestamp", "1 day").alias("w"))
                .agg(F.count(F.lit(1)).alias("requests"))
                .select("user_id", F.col("w.start").alias("day"), "requests"))


def run_append(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain the available input into a Parquet sink (append mode)."""
    q = (df.writeStream.format("parquet").outputMode("append")
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))
    q.awaitTermination()


def run_upserts(df: DataFrame, path: str, checkpoint: str) -> None:
    """Update-mode sink: every micro-batch writes its changed rows to a folder
    of its own batch id, so a batch that is replayed after a failure replaces
    its rows; ``latest_rows`` reads the newest version per key."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    q = (df.writeStream.outputMode("update").foreachBatch(write)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version per key of an upsert log (a grouped max, no window)."""
    log = spark.read.parquet(path)
    newest = log.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return log.join(newest, [*keys, "_batch"]).drop("_batch")
