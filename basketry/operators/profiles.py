"""Purchases, wishlists and carts of users, in long form.

Entries are rows (user_id, kind, item_id, title, category, brand, price,
added_at) with kind purchase, wishlist or cart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import cut_lineage

KINDS = ("purchase", "wishlist", "cart")


def activity_totals(users: DataFrame, entries: DataFrame) -> DataFrame:
    """Registered and active users, entries per kind and money spent, one row."""
    per_user = entries.groupBy("user_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS],
        F.sum(F.when(F.col("kind") == "purchase", F.col("price"))).alias("spent"))
    joined = users.select("user_id").join(per_user, "user_id", "left")
    active = (F.coalesce("purchase", F.lit(0)) + F.coalesce("wishlist", F.lit(0))) > 0
    return joined.agg(
        F.count("*").alias("registered_users"),
        F.count_if(active).alias("active_users"),
        F.coalesce(F.sum("purchase"), F.lit(0)).alias("total_purchases"),
        F.coalesce(F.sum("wishlist"), F.lit(0)).alias("total_wishlist"),
        F.coalesce(F.sum("cart"), F.lit(0)).alias("total_cart"),
        F.coalesce(F.sum("spent"), F.lit(0.0)).alias("total_spent"),
    )


def user_detail_rows(users: DataFrame, entries: DataFrame) -> DataFrame:
    """Per user: email and registration (or 'N/A') and entries per kind."""
    per_user = entries.groupBy("user_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_items") for k in KINDS])
    return (users.join(per_user, "user_id", "left")
            .fillna(0, [f"{k}_items" for k in KINDS])
            .select("user_id", F.coalesce("email", F.lit("N/A")).alias("email"),
                    F.coalesce("registered", F.lit("N/A")).alias("registered"),
                    *[f"{k}_items" for k in KINDS]))


def list_summaries(entries: DataFrame) -> DataFrame:
    """Entries, total price and distinct categories per user and kind."""
    return entries.groupBy("user_id", "kind").agg(
        F.count("*").alias("entry_count"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("total_price"),
        F.countDistinct("category").alias("category_count"))


def purchase_list(entries: DataFrame) -> DataFrame:
    """Purchases, the newest of each user first; users stay together but in no order."""
    return entries.where(F.col("kind") == "purchase").repartition("user_id").sortWithinPartitions(
        "user_id", F.desc("added_at"), "item_id").select(
        "user_id", "item_id", "title", "category", "brand", "price", "added_at")


def checkout(entries: DataFrame, as_of) -> DataFrame:
    """Move every cart entry to the purchases of its user."""
    bought = F.col("kind") == "cart"
    return entries.withColumn(
        "added_at", F.when(bought, as_of).otherwise(F.col("added_at"))).withColumn(
        "kind", F.when(bought, "purchase").otherwise(F.col("kind")))


def new_entries(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests not yet on the list of their user, each wanted item once.

    Both have user_id, asin, title and price. A request with an asin is a
    duplicate if the list holds that asin; one without, if the list holds the
    same title at a price less than 0.01 away. The price test joins on cells of
    0.01 and their neighbours, so equal titles are not all compared.

    Requests are taken by price, then title, and count against later ones: of
    several with an asin the cheapest is added, of several without, those at
    least 0.01 above the last one added.
    """
    has_asin = F.coalesce(F.col("asin") != "", F.lit(False))
    columns = ["user_id", "asin", "title", "price"]
    # each is read twice, and often the result of a join
    requested, existing = (cut_lineage(df.select(columns).distinct(), "entries") for df in (requested, existing))
    first = requested.where(has_asin).groupBy("user_id", "asin").agg(
        F.min(F.struct("price", "title")).alias("_first"))
    by_asin = first.select("user_id", "asin", "_first.title", "_first.price").join(
        existing.where(has_asin).select("user_id", "asin").distinct(), ["user_id", "asin"], "left_anti")

    cell = F.floor(F.col("price") / 0.01)
    listed = existing.select(
        "user_id", F.col("title").alias("_title"), F.col("price").alias("_price"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell")).distinct()
    loose = requested.where(~has_asin).groupBy("user_id", "title", "price").agg(
        F.min("asin").alias("asin"))
    by_title = loose.withColumn("_c", cell).join(
        listed.withColumnRenamed("user_id", "_user"),
        (F.col("user_id") == F.col("_user")) & (F.col("title") == F.col("_title"))
        & (F.col("_c") == F.col("_cell")) & (F.abs(F.col("price") - F.col("_price")) < 0.01),
        "left_anti").drop("_c")
    # the distinct prices of one title on one user's list of requests
    nothing = F.array().cast("array<struct<price:double,asin:string>>")
    entry = F.struct(F.col("price").cast("double").alias("price"), "asin")
    spaced = F.aggregate("_all", nothing, lambda kept, e: F.when(
        F.coalesce(e["price"] - F.try_element_at(kept, F.lit(-1))["price"] < 0.01, F.lit(False)), kept)
        .otherwise(F.concat(kept, F.array(e))))
    added = by_title.groupBy("user_id", "title").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    added = added.select("user_id", "title", F.inline(spaced))
    return by_asin.select(columns).unionByName(added.select(columns))


def target_categories(
    users: DataFrame, entries: DataFrame, registered: DataFrame, items: DataFrame,
) -> DataFrame:
    """Categories to recommend from, and what they are based on.

    Purchases come first (with the wishlist added), then the wishlist alone,
    then the categories named at registration (``registered``: user_id,
    category). Categories the catalog does not have are left out.
    """
    listed = entries.where(F.col("kind").isin("purchase", "wishlist")).select(
        "user_id", "category", F.when(F.col("kind") == "purchase", "p").otherwise("w").alias("_from"))
    labelled = listed.unionByName(registered.select("user_id", "category", F.lit("r").alias("_from")))
    known = labelled.distinct().join(items.select("category").distinct(), "category", "left_semi")

    def gather(label: str):
        return F.collect_set(F.when(F.col("_from") == label, F.col("category")))

    sets = known.groupBy("user_id").agg(
        gather("p").alias("p"), gather("w").alias("w"), gather("r").alias("r"))
    bought, wished, named = F.size("p") > 0, F.size("w") > 0, F.size("r") > 0
    joined = users.select("user_id").join(sets, "user_id", "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        "user_id",
        F.array_sort(F.when(bought, F.array_union("p", "w")).when(wished, F.col("w"))
                     .when(named, F.col("r")).otherwise(empty)).alias("categories"),
        F.when(bought, "purchase history").when(wished, "wishlist")
        .when(named, "registration preferences").otherwise("general").alias("source"))
