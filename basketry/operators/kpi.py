"""Business and service indicators from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100 * part, whole), F.lit(0.0))


def _rates(views: Column, clicks: Column, purchases: Column) -> list[Column]:
    return [
        _percent(clicks, views).alias("ctr"),
        _percent(purchases, clicks).alias("conversion_rate"),
        _percent(clicks + purchases, views).alias("engagement_rate"),
    ]


def business_kpis(events: DataFrame) -> DataFrame:
    """Views, clicks, purchases and the rates between them, one row.

    Counted per user first, so active and known users are plain counts.
    """
    per_user = events.groupBy("user_id").agg(
        F.count_if(_is("view")).alias("v"), F.count_if(_is("click")).alias("c"),
        F.count_if(_is("purchase")).alias("p"))
    totals = per_user.agg(
        F.sum("v").alias("views"), F.sum("c").alias("clicks"), F.sum("p").alias("purchases"),
        F.count("user_id").alias("known_users"),
        F.count_if((F.col("p") > 0) & F.col("user_id").isNotNull()).alias("active_users"))
    return totals.select(
        "*", *_rates(F.col("views"), F.col("clicks"), F.col("purchases")),
        _percent(F.col("active_users"), F.col("known_users")).alias("retention_rate"))


def daily_trend(events: DataFrame, days: int = 30) -> DataFrame:
    """Counts and rates per day for the last ``days`` days, idle days included."""
    per_day = events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("activity"), F.count_if(_is("view")).alias("views"),
        F.count_if(_is("click")).alias("clicks"), F.count_if(_is("purchase")).alias("purchases"))
    last = F.max(F.to_date("ts"))
    spine = events.agg(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    filled = spine.join(per_day, "day", "left").fillna(0)
    return filled.select("*", *_rates(F.col("views"), F.col("clicks"), F.col("purchases")))


def service_metrics(requests: DataFrame, width: str = "1 day") -> DataFrame:
    """Latency, hit rate, throughput and errors per time window.

    ``requests``: ts, latency_ms, cached, failed. Percentiles are approximate
    beyond 10000 requests per window, so that no window is held whole.
    """
    tail = F.percentile_approx("latency_ms", F.lit([0.95, 0.99]), F.lit(10000))
    grouped = requests.groupBy(F.window("ts", width).alias("window")).agg(
        F.count("*").alias("requests"), F.avg("latency_ms").alias("latency_avg"), tail.alias("tail"),
        F.count_if("cached").alias("hits"), F.count_if("failed").alias("errors"))
    seconds = F.timestamp_diff("SECOND", F.col("window.start"), F.col("window.end"))
    return grouped.select(
        F.col("window.start").alias("window_start"), "requests", "latency_avg",
        F.col("tail")[0].alias("latency_p95"), F.col("tail")[1].alias("latency_p99"),
        F.try_divide(F.col("hits"), F.col("requests")).alias("hit_rate"),
        (F.col("requests") / seconds).alias("requests_per_second"),
        F.try_divide(F.col("errors"), F.col("requests")).alias("error_rate"))


def hit_rate(requests: DataFrame) -> DataFrame:
    """Share of requests answered from stored results; 0 without requests."""
    return requests.agg(
        F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses")
    ).select("hits", "misses", F.coalesce(
        F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)).alias("hit_rate"))


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions per user: events less than the gap apart.

    Events in the same slot of one gap's length are always in one session, so
    they are first summed per user and slot. A user then has at most one row per
    slot of time, however many events there are.
    """
    gap = gap_minutes * 60_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = events.where(F.col("ts").isNotNull()).groupBy(
        "user_id", F.floor(micros / gap).alias("slot")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"),
        F.sum("value").alias("value"))
    by_time = W.partitionBy("user_id").orderBy("slot")
    quiet = (F.unix_micros(F.col("first_ts").cast("timestamp"))
             - F.unix_micros(F.lag("last_ts").over(by_time).cast("timestamp")))
    starts = F.coalesce(quiet >= gap, F.lit(True)).cast("int")
    marked = slots.withColumn("starts", starts).withColumn("session", F.sum("starts").over(by_time))
    return marked.groupBy("user_id", "session").agg(
        F.min("first_ts").alias("session_start"), F.max("last_ts").alias("session_end"),
        F.sum("n").alias("event_count"), F.sum("value").alias("total_value")).select(
        "user_id", "session_start", "session_end", "event_count", "total_value",
        (F.timestamp_diff("MICROSECOND", F.col("session_start"), F.col("session_end")) / 1e6)
        .alias("duration_seconds"))


def session_metrics(user_sessions: DataFrame) -> DataFrame:
    """Session count, mean duration and bounce rate (sessions of one event)."""
    return user_sessions.agg(
        F.count("*").alias("session_count"),
        F.avg("duration_seconds").alias("session_duration"),
        F.try_divide(F.count_if(F.col("event_count") == 1), F.count("*")).alias("bounce_rate"))
