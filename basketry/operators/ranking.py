"""Top-n selections and seeded samples.

Per-group top-n is written as ``row_number() <= n``: Spark then keeps only n
rows of a group in every task before the shuffle, so a group with very many
rows reaches its final task already cut to n rows per upstream task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions.scalars import seeded_order


def top_n_per_group(
    df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group in the given order, with their rank."""
    window = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def top_items_per_user(scores: DataFrame, n: int) -> DataFrame:
    """Best ``n`` items per user; the lower item id first among equal scores."""
    return top_n_per_group(scores, ["user_id"], [F.desc("score"), F.asc("item_id")], n)


def popular_items(catalog: DataFrame, n: int) -> DataFrame:
    """Items by rating, then by number of reviews, then by id."""
    return catalog.orderBy(F.desc("rating"), F.desc("review_count"), F.asc("item_id")).limit(n)


def similar_top_k(similarities: DataFrame, k: int) -> DataFrame:
    """Best ``k`` neighbours per source."""
    return top_n_per_group(
        similarities, ["source_id"], [F.desc("similarity"), F.asc("neighbor_id")], k)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded random order; the same seed gives the same rows."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def sample_with_images_first(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` items in seeded order, topped up from those without an image."""
    has_image = F.coalesce(F.size("valid_image_urls") > 0, F.lit(False))
    return items.orderBy(
        F.desc(has_image), seeded_order(seed, F.col("item_id")), "item_id").limit(n)
