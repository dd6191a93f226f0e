"""Point-in-time feature retrieval and latest feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def historical_features(
    entities: DataFrame,
    features: DataFrame,
    key: str,
    columns: list[str],
    ttl_days: int,
    bucket_days: int = 7,
    heavy: int = 1_000_000,
) -> DataFrame:
    """For each entity row, the newest feature row not later than its time.

    Both frames carry ``key`` and ``event_timestamp``, features also
    ``created_timestamp``. A feature row counts from its own time up to and
    including ``ttl_days`` later; among rows of the same time the one created
    last wins. Entity rows without a match keep nulls; a null key matches nothing.

    Time is cut into buckets and the work is spread by key and bucket, so a key
    with very many rows is shared by many tasks. Within a bucket a running
    window finds the match. The newest row of a bucket is also handed to the
    buckets after it, as far as the time to live reaches, so every bucket has
    all it needs: no pair of rows is ever formed. Entity rows of buckets with
    more than ``heavy`` of them are dealt over several tasks, each of which gets
    the bucket's features; so are those without a key.
    """
    payload = F.struct(
        F.col("event_timestamp").alias("feature_ts"), F.col("created_timestamp"),
        *[F.col(c) for c in columns])
    given = features.where(F.col("event_timestamp").isNotNull() & F.col(key).isNotNull()).select(
        key, "event_timestamp", payload.alias("_feature"), _bucket(bucket_days))
    newest = given.groupBy(key, "_bucket").agg(
        F.max(F.struct("_feature.feature_ts", "_feature.created_timestamp", "_feature")).alias("_n"))
    reach = -(-ttl_days // bucket_days)
    later = F.sequence(F.col("_bucket") + 1, F.col("_bucket") + reach)
    handed = newest.select(
        key, F.col("_n.feature_ts").alias("event_timestamp"), F.col("_n._feature").alias("_feature"),
        F.explode(later).alias("_bucket"))

    extra = [c for c in entities.columns if c not in (key, "event_timestamp")]
    asked = entities.select(
        key, "event_timestamp", F.lit(None).cast(given.schema["_feature"].dataType).alias("_feature"),
        _bucket(bucket_days), F.struct(F.lit(1).alias("_asked"), *extra).alias("_entity"))
    # few: at most one per ``heavy`` entity rows
    parts = asked.where(F.col(key).isNotNull()).groupBy(key, "_bucket").count().where(
        F.col("count") > heavy).select(key, "_bucket", F.ceil(F.col("count") / heavy).cast("int").alias("_parts"))
    known = given.unionByName(handed).join(parts, [key, "_bucket"], "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    asked = asked.join(parts, [key, "_bucket"], "left").withColumn("_part", F.pmod(
        F.xxhash64("event_timestamp", "_entity"),
        F.coalesce("_parts", F.when(F.col(key).isNull(), 64), F.lit(1))).cast("int")).drop("_parts")
    rows = asked.unionByName(known, allowMissingColumns=True)
    so_far = (W.partitionBy(key, "_bucket", "_part")
              .orderBy("event_timestamp", F.col("_entity").isNotNull(), "_feature.created_timestamp")
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    matched = rows.withColumn("_match", F.last("_feature", ignorenulls=True).over(so_far)).where(
        F.col("_entity").isNotNull())
    fresh = (F.col("_match.feature_ts")
             >= F.col("event_timestamp") - F.make_dt_interval(F.lit(ttl_days)))
    match = F.when(fresh, F.col("_match"))
    return matched.select(
        key, "event_timestamp", *[F.col(f"_entity.{c}").alias(c) for c in extra],
        match["feature_ts"].alias("feature_timestamp"),
        *[match[c].alias(c) for c in columns])


def _bucket(days: int) -> Column:
    since = F.datediff("event_timestamp", F.to_date(F.lit("1970-01-01")))
    return F.floor(since / days).alias("_bucket")


def latest_features(features: DataFrame, key: str, as_of: Column | None = None) -> DataFrame:
    """The newest row of each key (not later than ``as_of``), all columns.

    An aggregate, not a window: each task keeps one row per key, so a key with
    very many versions costs no more than the others.
    """
    if as_of is not None:
        features = features.where(F.col("event_timestamp") <= as_of)
    rest = [c for c in features.columns if c not in (key, "event_timestamp", "created_timestamp")]
    newest = F.max(F.struct("event_timestamp", "created_timestamp", *rest))
    return features.groupBy(key).agg(newest.alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in features.columns if c != key])


def online_features(
    entities: DataFrame, latest: DataFrame, key: str, refs: list[str],
) -> DataFrame:
    """Requested features of the requested keys; unknown keys keep nulls.

    A reference is ``view:feature`` or just ``feature``.
    """
    columns = [ref.rsplit(":", 1)[-1] for ref in refs]
    return entities.select(key).join(latest.select(key, *columns), key, "left")


def expire_features(features: DataFrame, as_of: Column, days_to_keep: int = 90) -> DataFrame:
    """Feature rows whose event time is within the retention period."""
    return features.where(
        F.col("event_timestamp") >= as_of - F.make_dt_interval(F.lit(days_to_keep)))
