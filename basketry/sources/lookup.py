"""Lookup tables: bucketed and sorted by key, in partitions by the day of expiry.

A read by key opens the buckets of these keys only, a join by key shuffles neither side, and days that have expired are not
listed. Invalidations are rows of a second table in the same buckets, so nothing stored is rewritten for them.
Files are below one folder; the session's catalog knows the tables by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


class LookupStore:
    """Tables of rows with a key, cached_at and ttl_seconds."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.prefix, self.buckets = spark, folder.rstrip("/"), prefix, buckets

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def _save(self, table: str, rows: DataFrame, key: str, *days: str) -> None:
        # one file per bucket and day, not one per task
        spread = rows.repartition(self.buckets, *[F.col(f"`{c}`") for c in (key, *days)])
        writer = spread.write.mode("append").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder}/{table}")
        (writer.partitionBy(*days) if days else writer).saveAsTable(self.name(table))

    def put(self, table: str, rows: DataFrame, key: str) -> None:
        """Add rows; a row expires ``ttl_seconds`` after ``cached_at``."""
        expires = F.col("cached_at") + F.make_dt_interval(secs=F.col("ttl_seconds"))
        self._save(table, rows.withColumn("expires_at", expires).withColumn("expiry_day", F.to_date("expires_at")),
                   key, "expiry_day")

    def invalidate(self, table: str, keys: DataFrame, key: str, at: Column) -> None:
        """Rows of these keys stored up to ``at`` count no more."""
        gone = keys.select(key).distinct().withColumn("gone_at", at)
        self._save(f"{table}_gone", gone, key)

    def get(self, table: str, key: str, as_of: Column, wanted: list | None = None) -> DataFrame:
        """Rows that are valid, of the wanted keys if given; a row exactly at its expiry has expired."""
        rows = self.spark.table(self.name(table)).where(
            (F.col("expiry_day") >= F.to_date(as_of)) & (F.col("expires_at") > as_of) & (F.col("cached_at") <= as_of))
        if wanted is not None:
            rows = rows.where(F.col(key).isin(wanted))
        if self.spark.catalog.tableExists(self.name(f"{table}_gone")):
            gone = self.spark.table(self.name(f"{table}_gone")).where(F.col("gone_at") <= as_of).groupBy(key).agg(
                F.max("gone_at").alias("gone_at"))
            rows = rows.join(gone, key, "left").where(F.col("gone_at").isNull() | (F.col("cached_at") > F.col("gone_at")))
        return rows.drop("gone_at", "expiry_day")
