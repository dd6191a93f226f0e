"""Structured Streaming jobs over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry import schemas
from basketry.operators.asof import latest_features


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as they arrive as Parquet files; ``ts`` as an instant."""
    reader = spark.readStream.schema(schemas.EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_metrics(recorded: DataFrame, lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """n, sum and sum of squares per test, metric, group and time window.

    ``recorded``: test_id, group, ts, metrics. State is one row per window and
    test cell; windows close ``lateness`` after their end.
    """
    values = recorded.withWatermark("ts", lateness).select(
        "ts", "test_id", "group", F.explode("metrics").alias("metric", "value"))
    return values.groupBy(F.window("ts", width), "test_id", "metric", "group").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"),
        F.sum(F.col("value") * F.col("value")).alias("squares")).select(
        F.col("window.start").alias("window_start"), "test_id", "metric", "group",
        "n", "total", "squares")


def activity_per_user(events: DataFrame) -> DataFrame:
    """Running activity of each user, updated with every batch."""
    return events.groupBy("user_id").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def with_activity_features(activity: DataFrame, as_of: Column) -> DataFrame:
    """Activity level and days since the last event, at ``as_of``."""
    span = F.timestamp_diff("DAY", F.col("first_ts"), F.col("last_ts")) + 1
    return activity.select(
        "user_id", "event_count", (F.col("event_count") / span).alias("activity_level"),
        F.timestamp_diff("DAY", F.col("last_ts"), as_of).alias("days_since_last"))


def session_stream(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Closed sessions per user."""
    return events.withWatermark("ts", lateness).groupBy(
        "user_id", F.session_window("ts", gap).alias("session")).agg(
        F.count("*").alias("event_count"), F.max("ts").alias("session_end"),
        F.sum("value").alias("total_value")).select(
        "user_id", F.col("session.start").alias("session_start"), "session_end", "event_count",
        "total_value")


def distinct_updates(updates: DataFrame, key: str, lateness: str = "1 hour") -> DataFrame:
    """Feature updates, each (key, event time) once even if delivered twice."""
    return updates.withWatermark("event_timestamp", lateness).dropDuplicatesWithinWatermark(
        [key, "event_timestamp"])


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append closed results as Parquet, then stop."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def run_updates_to_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there; each batch's changed rows become one folder.

    A batch that is tried again overwrites its own folder, so nothing doubles.
    """
    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/b={batch}")

    query = (stream.writeStream.outputMode("update").foreachBatch(save)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def push_features(updates: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append streamed feature updates to the history, once each."""
    return run_to_files(distinct_updates(updates, key), out, checkpoint)


def latest_of_batches(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """The last emitted row of each key from ``run_updates_to_files``."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch", "b")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def run_to_end(spark: SparkSession, path: str, make, out: str, checkpoint: str, beyond: str = "1 day") -> None:
    """Replay a log that has ended through ``make``, and append what is still open at its end, too.

    After the log, a copy of its last event follows ``beyond`` later, which has to be more than the
    lateness and the width or gap together: it moves the watermark past everything that is open. Its
    own window or session stays open and is never given out.
    """
    log = spark.read.schema(schemas.EVENTS).parquet(path)
    log.limit(0).write.parquet(f"{checkpoint}-end")

    def run() -> None:
        events = event_stream(spark, path).unionByName(event_stream(spark, f"{checkpoint}-end"))
        run_to_files(make(events), out, checkpoint)
    run()
    last = log.where("ts IS NOT NULL").orderBy(F.desc("ts")).limit(1)
    last.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {beyond}")).write.mode("append").parquet(f"{checkpoint}-end")
    run()


def upsert_latest(updates: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Refresh the latest table with every batch of feature updates: per key the newest row, of equally
    new ones the highest.

    Two versions take turns, so a batch that is tried again finds the one before it as it was. Updates that
    come twice or late change nothing that is newer, so no watermark leaves any out.
    """
    rest = [c for c in updates.columns if c not in (key, "event_timestamp")]

    def save(rows: DataFrame, batch: int) -> None:
        if batch:
            before = rows.sparkSession.read.parquet(f"{out}/v={(batch - 1) % 2}").drop("batch")
            rows = rows.unionByName(before)
        rows.groupBy(key).agg(F.max(F.struct("event_timestamp", *rest)).alias("_r")).select(
            key, "_r.*", F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{out}/v={batch % 2}")

    query = (updates.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def latest_upserted(spark: SparkSession, out: str) -> DataFrame:
    """The table that ``upsert_latest`` keeps."""
    rows = spark.read.parquet(out)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch", "v")


def latest_pushed(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The current feature row of each key from the pushed history."""
    return latest_features(spark.read.parquet(out), key)
