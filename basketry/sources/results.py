"""Stored result tables: recommendations, features, predictions, test results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.scalars import result_key
from basketry.operators.asof import latest_features
from basketry.session import cut_lineage

# Seconds a stored result stays valid.
TTL_SECONDS = {
    "recommendations": 3600,
    "features": 1800,
    "predictions": 7200,
    "ab_test": 86400,
}

LATEST_BUCKETS = 64  # folders of a latest table


def still_valid(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows younger than their own time to live; one exactly at it has expired."""
    age = F.timestamp_diff("MICROSECOND", F.col("cached_at"), as_of)
    return rows.where(age < F.col("ttl_seconds").cast("bigint") * 1_000_000)


def stamped(rows: DataFrame, kind: str, cached_at: Column, ttl_seconds: int | None = None) -> DataFrame:
    """Rows with the time they were stored and how long they stay valid."""
    return rows.withColumn("cached_at", cached_at).withColumn(
        "ttl_seconds", F.lit(ttl_seconds if ttl_seconds is not None else TTL_SECONDS[kind]))


def recommendation_rows(lists: DataFrame) -> DataFrame:
    """One row per user and model: its key and the ranked list."""
    entry = F.struct("rank", "item_id", "score")
    grouped = lists.groupBy("user_id", "model").agg(
        F.array_sort(F.collect_list(entry)).alias("recommendations"))
    key = result_key("recs", F.col("user_id"), {"model": F.col("model")})
    return grouped.withColumn("key", key)


def _gathered(rows: DataFrame, split_by: str) -> DataFrame:
    """Rows of a partition together, so that it gets few files; large ones are split."""
    return rows.hint("rebalance", F.col(split_by))


class ResultStore:
    """Parquet tables below one folder, each split by one column."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def write(self, table: str, rows: DataFrame, split_by: str) -> None:
        """Replace the partitions that ``rows`` has; leave the others alone."""
        (_gathered(rows, split_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(split_by).parquet(self.path(table)))

    def append(self, table: str, rows: DataFrame, split_by: str) -> None:
        _gathered(rows, split_by).write.mode("append").partitionBy(split_by).parquet(self.path(table))

    def read(self, table: str, as_of: Column | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path(table))
        return rows if as_of is None else still_valid(rows, as_of)

    def read_if_present(self, table: str) -> DataFrame | None:
        try:
            return self.read(table)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def drop_rows(self, table: str, split_by: str, doomed: DataFrame, on: str) -> None:
        """Remove rows whose ``on`` is in ``doomed``; only touched partitions are rewritten.

        The rows to keep go to a file next to the table first, because a table
        cannot be read and overwritten in one job.
        """
        rows = self.read(table)
        marked = rows.join(doomed.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left")
        touched = marked.where("_hit").select(split_by).distinct()
        kept = marked.join(touched, split_by, "left_semi").where(F.col("_hit").isNull()).drop("_hit")
        names = {r[0] for r in touched.collect()}  # one per partition folder
        left = cut_lineage(kept.select(rows.columns))
        remaining = {r[0] for r in left.select(split_by).distinct().collect()}
        if remaining:
            self.write(table, left, split_by)
        for name in names - remaining:
            self._remove_partition(table, split_by, name)

    def drop_partition(self, table: str, split_by: str, value: str) -> None:
        """Remove everything stored for one value of the split column."""
        self._remove_partition(table, split_by, value)

    def _remove_partition(self, table: str, split_by: str, value) -> None:
        """Delete the folder that holds the value, as the files there name it."""
        rows = self.read(table)
        mine = rows.where(F.col(split_by).eqNullSafe(F.lit(value).cast(rows.schema[split_by].dataType)))
        folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
        found = [r[0] for r in mine.select(folder).distinct().collect()]  # one folder holds a value
        if not found:
            raise KeyError(f"{table} has nothing for {split_by} = {value}")
        jvm = self.spark.sparkContext._jvm
        for name in found:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            if not system.delete(path, True):
                raise OSError(f"could not delete {name}")


def ingest_features(
    store: ResultStore, view: str, key: str, rows: DataFrame,
) -> DataFrame:
    """Append feature rows to the history by day and refresh the latest rows.

    The latest rows come from the previous latest rows and the new ones; the
    history, which only grows, is not read again, and of the latest rows only buckets
    that new rows fall into are read and written.
    """
    fresh = cut_lineage(rows)
    store.append(f"{view}_history", fresh.withColumn("event_date", F.to_date("event_timestamp")),
                 "event_date")
    bucket = F.pmod(F.xxhash64(key), F.lit(LATEST_BUCKETS))
    touched = [r[0] for r in fresh.select(bucket).distinct().collect()]  # a number per bucket at most
    known = store.read_if_present(f"{view}_latest")
    candidates = fresh if known is None else fresh.unionByName(
        known.where(F.col("bucket").isin(touched)).drop("bucket"))
    merged = cut_lineage(latest_features(candidates, key).withColumn("bucket", bucket))
    store.write(f"{view}_latest", merged, "bucket")
    return store.read(f"{view}_latest").drop("bucket")


def retire_features(store: ResultStore, view: str, cutoff_day: str) -> None:
    """Delete history partitions of days before the cutoff; nothing is rewritten."""
    days = store.read(f"{view}_history").select("event_date").distinct().where(
        F.col("event_date") < F.lit(cutoff_day).cast("date")).collect()
    for row in days:
        store.drop_partition(f"{view}_history", "event_date", row[0].isoformat())


def warm(features: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Feature rows (or lists) of the wanted ids, ready to be stored."""
    return features.join(wanted.select(key).distinct(), key, "left_semi")
