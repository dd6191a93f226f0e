"""The driver tables, and the retail views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy access to ``<root>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def orders_and_lines(self) -> DataFrame:
        """One row per order line with its buyer; no catalog columns."""
        orders = self.read("orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        lines = self.read("lineitem")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            (1 + 4 * (F.col("l_quantity") - 1) / 49).alias("rating"),
            F.col("o_orderdate").alias("ts"),
            F.try_divide("l_extendedprice", "l_quantity").alias("price"),
            F.col("o_orderstatus").alias("status"),
            F.col("l_discount").alias("discount"),
        )

    def interactions(self, catalog: bool = True, discount: bool = False) -> DataFrame:
        """user_id, item_id, rating, ts, price and, if asked, discount, category, brand.

        Callers that need no catalog column pass ``catalog=False`` and save a
        join. The join side is chosen by Spark from the size of ``part``.
        """
        lines = self.orders_and_lines().drop("status", *([] if discount else ["discount"]))
        if not catalog:
            return lines
        return enrich_from_items(lines, self.catalog())

    def catalog(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("p_retailprice").alias("price"),
        )

    def items(self) -> DataFrame:
        """Catalog plus the mean discount seen on its order lines."""
        discount = self.read("lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(
            (100 * F.avg("l_discount")).alias("discount_percentage"))
        return self.catalog().join(discount, "item_id", "left").select(
            "*", F.lit(None).cast("string").alias("availability"))

    def items_with_images(self) -> DataFrame:
        """Catalog with an image list: the page whose number the item bears."""
        pages = self.read("pages").select(F.col("page_id").alias("item_id"), "url")
        return self.catalog().join(pages, "item_id", "left").select(
            "item_id", "title", "category", "brand", "price",
            F.when(F.col("url").isNull(), F.array().cast("array<string>"))
            .otherwise(F.array("url")).alias("valid_image_urls"))

    def profile_entries(self) -> DataFrame:
        """Purchases, wishlist and cart in long form, by order status."""
        kind = (F.when(F.col("status") == "F", "purchase")
                .when(F.col("status") == "O", "wishlist")
                .otherwise("cart"))
        lines = self.orders_and_lines().select(
            "user_id", kind.alias("kind"), "item_id", "price", F.col("ts").alias("added_at"))
        return enrich_from_items(lines, self.catalog(), ["title", "category", "brand"])

    def events(self) -> DataFrame:
        return self.read("events")

    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("item_id"),
            F.col("embedding").cast("array<double>").alias("vector"), "label")


def enrich_from_items(
    rows: DataFrame, items: DataFrame, columns: list[str] | None = None,
) -> DataFrame:
    """Look up catalog columns by item_id; rows without a catalog item go."""
    return rows.join(items.select("item_id", *(columns or ["category", "brand"])), "item_id")


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole days, rounded down."""
    return F.timestamp_diff("DAY", start, end)
