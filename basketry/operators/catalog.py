"""Catalog search, filter options, counts and page projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions.scalars import image_or_icon, price_label, seeded_order, shorten, stars
from basketry.operators.ranking import seeded_sample, top_n_per_group
from basketry.session import cut_lineage

DEFAULT_RATING = 4.0
PAGE_SIZE = 20


def matches_text(query: str, columns: list[str]) -> Column:
    """Any column holds the trimmed query, letter case and regex signs aside."""
    wanted = query.strip().lower()
    found = F.lit(False)
    for column in columns:
        text = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
        found = found | text.contains(wanted)
    return found


def search(
    items: DataFrame, query: str, columns: list[str], category: str | None = None,
    brand: str | None = None, min_price: float = 0, max_price: float = 0,
) -> DataFrame:
    """Items that match the text and the set filters; 0 leaves a price bound out."""
    hits = items
    if category:
        hits = hits.where(F.col("category") == category)
    if brand:
        hits = hits.where(F.col("brand") == brand)
    if min_price > 0:
        hits = hits.where(F.col("price") >= min_price)
    if max_price > 0:
        hits = hits.where(F.col("price") <= max_price)
    return hits.where(matches_text(query, columns))


def search_page(hits: DataFrame, size: int = PAGE_SIZE, seed: int = 42) -> DataFrame:
    """A seeded sample of the hits as one page, each row with the total count."""
    total = hits.agg(F.count("*")).scalar()
    return seeded_sample(hits, "item_id", size, seed).select("*", total.alias("total_count"))


def filter_options(items: DataFrame, brands: int = 20) -> DataFrame:
    """All categories and the first brands by name, as (kind, value)."""
    def distinct(column: str) -> DataFrame:
        return items.select(F.lit(column).alias("kind"), F.col(column).alias("value")).distinct()
    return distinct("category").unionByName(distinct("brand").orderBy("value").limit(brands))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; optionally the top values only."""
    counts = (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count("*").alias("n")).orderBy(F.desc("n"), column))
    return counts.limit(top) if top else counts


def dataset_overview(items: DataFrame, interactions: DataFrame) -> DataFrame:
    """Products, categories, interactions, users and mean rating in one row."""
    products = items.agg(
        F.count("*").alias("product_count"), F.countDistinct("category").alias("category_count"))
    activity = interactions.agg(F.struct(
        F.count("*").alias("interaction_count"), F.countDistinct("user_id").alias("user_count"),
        F.avg("rating").alias("avg_rating")))
    return products.select("*", activity.scalar().alias("_activity")).select(
        "product_count", "category_count", "_activity.*")


def category_brand_rollup(items: DataFrame) -> DataFrame:
    """Item count and mean price per category and brand, with subtotals."""
    return items.rollup("category", "brand").agg(
        F.count("*").alias("item_count"), F.avg("price").alias("avg_price"))


def with_review_summary(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mean rating and count of reviews per item; 4.0 and 0 without reviews."""
    summary = reviews.groupBy("item_id").agg(
        F.avg("rating").alias("rating"), F.count("*").alias("review_count"))
    return items.join(summary, "item_id", "left").fillna(
        {"rating": DEFAULT_RATING, "review_count": 0})


def display_cards(items: DataFrame, title_limit: int = 100) -> DataFrame:
    """What a result card shows: cut title, stars, price, image or icon."""
    return items.select(
        "item_id", shorten(F.col("title"), title_limit).alias("title"),
        stars(F.col("rating")).alias("stars"), price_label(F.col("price")).alias("price_label"),
        image_or_icon(F.col("valid_image_urls"), F.col("category")).alias("picture"))


def items_for_categories(
    targets: DataFrame, items: DataFrame, n: int, seed: int = 42,
) -> DataFrame:
    """``n`` sampled items per user from the user's categories.

    ``targets`` has user_id and the array ``categories``. Users whose categories
    are empty or unknown to the catalog draw from the whole catalog. The order
    is the same for all users, so only the first ``n`` items of each category
    (and of the catalog) can ever be chosen; users meet that short list only.
    """
    order = [F.desc(F.size("valid_image_urls") > 0),
             F.asc(seeded_order(seed, F.col("item_id"))), F.asc("item_id")]
    # n items per category: small beside the catalog, and read three times
    shortlist = cut_lineage(top_n_per_group(items, ["category"], order, n, "_r").drop("_r"), "shortlist")
    # items without a category stand on the general list only
    lists = shortlist.where("category IS NOT NULL").withColumn("_key", F.col("category")).withColumn("targeted", F.lit(True))
    general = shortlist.orderBy(*order).limit(n).withColumn("_key", F.lit("")).withColumn("targeted", F.lit(False))

    known = lists.select(F.col("category").alias("_known")).distinct()
    wanted = targets.select("user_id", F.explode_outer(F.array_distinct("categories")).alias("_wanted"))
    matched = (wanted.join(known, F.col("_wanted") == F.col("_known"), "left")
               .groupBy("user_id").agg(F.collect_set("_known").alias("_keys")))
    chosen = F.transform("_keys", lambda c: F.struct(c.alias("_key"), F.lit(True).alias("targeted")))
    whole = F.array(F.struct(F.lit("").alias("_key"), F.lit(False).alias("targeted")))
    keys = matched.select("user_id", F.inline(F.when(F.size("_keys") > 0, chosen).otherwise(whole)))
    drawn = keys.join(lists.unionByName(general), ["_key", "targeted"])
    return top_n_per_group(drawn, ["user_id"], order, n).select("user_id", "item_id", "category", "targeted", "rank")


def category_share(interactions: DataFrame) -> DataFrame:
    """Share of each category in all interactions."""
    counts = interactions.groupBy("category").agg(F.count("*").alias("n"))
    # one row per category, so the window over all of them is small
    return counts.select("category", "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))
