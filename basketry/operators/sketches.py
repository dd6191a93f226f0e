"""Summaries that merge: stored by hour or day once, longer periods added up from them without the rows.

Quantiles come from KLL sketches, distinct users from HyperLogLog sketches; counts and sums stay exact. Sketches
are Spark's own aggregates, so partial ones are made before the shuffle. A stored period is a partition: to refresh one,
only its rows are read and only its partition is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.features import TREND_WINDOWS
from basketry.sources.results import ResultStore

LATENCY_K = 400  # size of a KLL sketch: ranks are off by less than a hundredth
RANK_ERROR = 0.01
USERS_LG = 12  # HyperLogLog sketches have 2 ** 12 registers at most
USERS_ERROR = 5 * 1.04 / 2 ** (USERS_LG / 2)  # five standard errors


# --------------------------------------------------------------------------
# service metrics


def service_sketches(requests: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per window: requests, latencies, hits, errors and a sketch of the latencies."""
    latency = F.col("latency_ms")
    return requests.where(F.col("ts").isNotNull()).groupBy(F.window("ts", width).alias("window")).agg(
        F.count("*").alias("requests"), F.count(latency).alias("measured"), F.sum(latency).alias("latency_sum"),
        F.count_if("cached").alias("hits"), F.count_if("failed").alias("errors"),
        F.kll_sketch_agg_double(latency, LATENCY_K).alias("latency")).select(
        F.col("window.start").alias("window_start"), F.to_date("window.start").alias("day"),
        "requests", "measured", "latency_sum", "hits", "errors", "latency")


def rolled_up(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Days from the sketches of their hours: mean, quantiles, rates."""
    days = sketches.groupBy("day").agg(
        *[F.sum(c).alias(c) for c in ("requests", "measured", "latency_sum", "hits", "errors")],
        F.kll_merge_agg_double("latency", LATENCY_K).alias("latency"))

    def quantile(q: float) -> Column:
        return F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_double("latency", F.lit(q)))
    return days.select(
        "day", "requests", F.try_divide("latency_sum", "measured").alias("latency_avg"),
        *[quantile(q).alias(f"latency_p{round(100 * q)}") for q in quantiles],
        F.try_divide("hits", "requests").alias("hit_rate"), F.try_divide("errors", "requests").alias("error_rate"))


def rank_errors(requests: DataFrame, days: DataFrame, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per day: how far the true rank of each quantile is from the wanted one, from all requests."""
    names = [f"latency_p{round(100 * q)}" for q in quantiles]
    rows = requests.select(F.to_date("ts").alias("day"), "latency_ms").where("latency_ms IS NOT NULL").join(
        days.select("day", *names), "day")
    off = []
    for q, name in zip(quantiles, names):
        below, upto = (F.count_if(x) / F.count("*") for x in (F.col("latency_ms") < F.col(name), F.col("latency_ms") <= F.col(name)))
        off.append(F.greatest(below - q, q - upto, F.lit(0.0)).alias(f"off_p{round(100 * q)}"))
    return rows.groupBy("day").agg(*off)


# --------------------------------------------------------------------------
# items by day


def item_days(interactions: DataFrame) -> DataFrame:
    """Per item and day: sums of ratings and prices, and a sketch of the users."""
    return interactions.where(F.col("ts").isNotNull()).groupBy("item_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("interactions"), F.sum("rating").alias("rating_sum"), F.count("rating").alias("ratings"),
        F.sum("price").alias("price_sum"), F.count("price").alias("prices"),
        F.hll_sketch_agg(F.col("user_id"), USERS_LG).alias("users"))


def refresh_item_days(store: ResultStore, interactions: DataFrame, first_day: str, last_day: str) -> None:
    """Store the days from first to last anew. The bounds reach the scan, so other days are not read, and stay as they are."""
    begin, after = F.lit(first_day).cast("timestamp_ntz"), F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz")
    some = interactions.where((F.col("ts") >= begin) & (F.col("ts") < after))
    store.write("item_days", item_days(some), "day")


def item_trends_from_days(days: DataFrame, as_of_day: str, windows: Sequence[int] = TREND_WINDOWS) -> DataFrame:
    """Trends per item over the last days by merging stored days; users are estimates. Only the days of the widest
    window are read."""
    today = F.lit(as_of_day).cast("date")
    recent = days.where(F.col("day") >= F.date_sub(today, max(windows)))
    trends = []
    for n in windows:
        inside = F.col("day") >= F.date_sub(today, n)

        def total(column: str) -> Column:
            return F.sum(F.when(inside, F.col(column)))
        trends += [
            F.try_divide(total("rating_sum"), total("ratings")).alias(f"avg_rating_{n}d"),
            F.coalesce(total("ratings"), F.lit(0)).alias(f"review_count_{n}d"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(inside, F.col("users")))), F.lit(0)).alias(f"unique_users_{n}d"),
            F.try_divide(total("price_sum"), total("prices")).alias(f"avg_price_{n}d")]
    return recent.groupBy("item_id").agg(*trends)


def overview_from_days(days: DataFrame) -> DataFrame:
    """Interactions, their users (an estimate) and mean rating of all stored days, in one row."""
    return days.agg(
        F.coalesce(F.sum("interactions"), F.lit(0)).alias("interaction_count"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users")), F.lit(0)).alias("user_count"),
        F.try_divide(F.sum("rating_sum"), F.sum("ratings")).alias("avg_rating"))


def near(estimate: Column, exact: Column) -> Column:
    """Whether an estimate of distinct users is within its bound."""
    return F.abs(estimate - exact) <= exact * F.lit(USERS_ERROR)
