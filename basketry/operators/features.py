"""User, item, behaviour and trend features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.sources.tables import whole_days

TREND_WINDOWS = (7, 30, 90)


def favorite_category(interactions: DataFrame) -> DataFrame:
    """Most frequent category per user; the first by name among equals.

    Interactions without a category don't count; who has only those is 'unknown'.
    """
    counts = interactions.groupBy("user_id", "category").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("category").isNotNull(), F.struct((-F.col("n")).alias("rank"), "category")))
    return counts.groupBy("user_id").agg(best.alias("best")).select(
        "user_id", F.coalesce("best.category", F.lit("unknown")).alias("favorite_category"),
        (-F.col("best.rank")).alias("category_count"))


def user_stats(interactions: DataFrame) -> DataFrame:
    """Mean and count of ratings, first and last time, mean and std of price."""
    return interactions.groupBy("user_id").agg(
        F.avg("rating").alias("avg_rating"),
        F.count("rating").alias("rating_count"),
        F.min("ts").alias("first_interaction"),
        F.max("ts").alias("last_interaction"),
        F.avg("price").alias("avg_price"),
        F.stddev_samp("price").alias("std_price"),
    )


def user_features(interactions: DataFrame, as_of: Column) -> DataFrame:
    """The user feature view at ``as_of``.

    Interactions are read and shuffled once, by user and category; a heavy
    user's rows shrink to one per category before they meet. The price spread
    is put together from the per-category means and spreads.
    """
    per_category = interactions.groupBy("user_id", "category").agg(
        F.count("*").alias("rows"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("ratings"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("price").alias("n"),
        F.avg("price").alias("mean"),
        F.var_pop("price").alias("var"),
    )
    favorite = F.min(F.when(
        F.col("category").isNotNull(), F.struct((-F.col("rows")).alias("rank"), "category")))
    per_user = per_category.groupBy("user_id").agg(
        F.try_divide(F.sum("rating_sum"), F.sum("ratings")).alias("avg_rating"),
        F.sum("ratings").alias("rating_count"),
        F.min("first_ts").alias("first_interaction"),
        F.max("last_ts").alias("last_interaction"),
        F.sum("n").alias("price_count"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("avg_price"),
        # bounded by the number of categories
        F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "var"))).alias("parts"),
        favorite.alias("favorite"),
    )
    squares = F.aggregate(
        "parts", F.lit(0.0),
        lambda s, p: s + p["n"] * (p["var"] + F.pow(p["mean"] - F.col("avg_price"), 2)))
    std_price = F.when(F.col("price_count") > 1, F.sqrt(squares / (F.col("price_count") - 1)))
    first, last = F.col("first_interaction"), F.col("last_interaction")
    return per_user.select(
        "user_id",
        "avg_rating",
        "rating_count",
        F.coalesce("favorite.category", F.lit("unknown")).alias("favorite_category"),
        (1 / (std_price + 1)).alias("price_sensitivity"),
        (F.col("rating_count") / (whole_days(first, last) + 1)).alias("activity_level"),
        whole_days(first, as_of).alias("account_age_days"),
        whole_days(last, as_of).alias("last_purchase_days_ago"),
        as_of.alias("event_timestamp"),
        as_of.alias("created_timestamp"),
    )


def item_stats(interactions: DataFrame) -> DataFrame:
    """Mean and count of ratings, distinct users, popularity per item; of interactions with a discount also its mean."""
    more = [(100 * F.avg("discount")).alias("discount_percentage")] if "discount" in interactions.columns else []
    stats = interactions.groupBy("item_id").agg(
        F.avg("rating").alias("avg_rating"),
        F.count("rating").alias("review_count"),
        F.countDistinct("user_id").alias("unique_users"), *more,
    )
    return stats.withColumn("popularity_score", F.col("avg_rating") * F.log1p("review_count"))


def item_features(items: DataFrame, interactions: DataFrame, as_of: Column) -> DataFrame:
    """The item feature view at ``as_of``; items nobody rated get zeros. The mean discount is that of the
    interactions, if they have one, or the items' own; what neither knows is null."""
    zeros = {"avg_rating": 0.0, "review_count": 0, "popularity_score": 0.0, "unique_users": 0}
    found = items.join(item_stats(interactions), "item_id", "left").fillna(zeros)
    for name, kind in (("availability", "string"), ("discount_percentage", "double")):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(None).cast(kind))
    return found.select("item_id", "category", "brand", "price", "avg_rating", "review_count",
                        "unique_users", "popularity_score", "availability", "discount_percentage",
                        as_of.alias("event_timestamp"), as_of.alias("created_timestamp"))


def user_behavior(interactions: DataFrame, as_of: Column) -> DataFrame:
    """Preferred hour and weekday, rating and price spread, recency per user.

    Hours and weekdays have few values, so their counts are plain aggregate
    columns: the whole feature set needs no second pass and no join.
    """
    hour, day = F.hour("ts"), F.weekday("ts")
    hours = [F.count_if(hour == h).alias(f"h{h}") for h in range(24)]
    days = [F.count_if(day == d).alias(f"d{d}") for d in range(7)]
    stats = interactions.groupBy("user_id").agg(
        *hours, *days,
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("rating_std"),
        F.count("rating").alias("total_interactions"),
        F.avg("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.countDistinct("category").alias("category_diversity"),
        F.max("ts").alias("last_ts"),
    )
    return stats.select(
        "user_id",
        _first_peak("h", 24, 12).alias("preferred_hour"),
        _first_peak("d", 7, 0).alias("preferred_day"),
        "avg_rating", "rating_std", "total_interactions",
        "avg_price", "min_price", "max_price", "category_diversity",
        whole_days(F.col("last_ts"), as_of).alias("days_since_last_interaction"),
    )


def _first_peak(prefix: str, size: int, default: int) -> Column:
    counts = F.array(*[F.col(f"{prefix}{i}") for i in range(size)])
    peak = F.array_max(counts)
    return F.when(peak > 0, F.array_position(counts, peak) - 1).otherwise(F.lit(default))


def item_trends(
    interactions: DataFrame, as_of: Column, windows: tuple[int, ...] = TREND_WINDOWS,
) -> DataFrame:
    """Rating, count, users and price per item over the last days.

    Only the widest window is read. Rows meet first per item and user, so that
    distinct users become plain counts and all windows share one pass.
    """
    def inside(days: int) -> Column:
        return F.col("ts") >= as_of - F.make_dt_interval(F.lit(days))

    recent = interactions.where(inside(max(windows)))
    sums = []
    for days in windows:
        sums += [
            F.sum(F.when(inside(days), F.col("rating"))).alias(f"r{days}"),
            F.count(F.when(inside(days), F.col("rating"))).alias(f"n{days}"),
            F.sum(F.when(inside(days), F.col("price"))).alias(f"p{days}"),
            F.count(F.when(inside(days), F.col("price"))).alias(f"m{days}"),
            F.count_if(inside(days)).alias(f"k{days}"),
        ]
    per_pair = recent.groupBy("item_id", "user_id").agg(*sums)
    trends = []
    for days in windows:
        trends += [
            F.try_divide(F.sum(f"r{days}"), F.sum(f"n{days}")).alias(f"avg_rating_{days}d"),
            F.sum(f"n{days}").alias(f"review_count_{days}d"),
            F.count_if((F.col(f"k{days}") > 0) & F.col("user_id").isNotNull())
            .alias(f"unique_users_{days}d"),
            F.try_divide(F.sum(f"p{days}"), F.sum(f"m{days}")).alias(f"avg_price_{days}d"),
        ]
    return per_pair.groupBy("item_id").agg(*trends)


def user_item_ratings(interactions: DataFrame) -> DataFrame:
    """The user-item matrix in sparse form: mean rating of each seen pair."""
    return interactions.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))


def user_item_matrix(interactions: DataFrame, item_ids: list) -> DataFrame:
    """The matrix with one column per listed item, 0 where unseen."""
    wide = (interactions.groupBy("user_id").pivot("item_id", item_ids).agg(F.avg("rating")))
    return wide.fillna(0.0)
