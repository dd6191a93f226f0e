"""Catalog files, search, counts, samples and page projections."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from basketry.operators import catalog, ranking
from basketry.operators.profiles import target_categories
from basketry.plans.registry import ENTRIES, HALF, INTERACTIONS, REVIEWED, query, rounded
from basketry.session import scratch_path
from basketry.sources import catalog_files, checks
from basketry.sources.tables import Tables

COLUMNS = ["title", "description", "brand", "category"]


def reviewed(t: Tables) -> DataFrame:
    return catalog.with_review_summary(t.catalog(), t.interactions(catalog=False))


@query("W3 A4 J1 J7", f"""
WITH {INTERACTIONS}, {REVIEWED}
SELECT item_id, title, category, brand, price, round(round(rating, 9) + {HALF}, 6) AS rating, review_count
FROM reviewed ORDER BY round(rating, 9) DESC, review_count DESC, item_id LIMIT 20""")
def popular_items(t: Tables) -> DataFrame:
    ranked = reviewed(t).withColumn("rating", F.round("rating", 9))
    return rounded(ranking.popular_items(ranked, 20), lift=HALF)


@query("J7", f"""
WITH {INTERACTIONS}, {REVIEWED}
SELECT item_id, title, category, brand, price, round(rating, 6) AS rating, review_count FROM reviewed""")
def review_summary(t: Tables) -> DataFrame:
    return rounded(reviewed(t))


@query("P1", """
SELECT doc_id, lang, source FROM documents
WHERE contains(lower(coalesce(text, '')), 'the ou') OR contains(lower(coalesce(lang, '')), 'the ou')
   OR contains(lower(coalesce(source, '')), 'the ou')""")
def search_documents(t: Tables) -> DataFrame:
    hits = catalog.search(t.read("documents"), "  The Ou ", ["text", "lang", "source"])
    return hits.select("doc_id", "lang", "source")


SEARCH_HITS = """
hits AS (
  SELECT p_partkey AS item_id, p_name AS title, p_type AS category, p_brand AS brand,
         p_retailprice AS price
  FROM part
  WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')
         OR contains(lower(p_type), 'ring'))
    AND p_retailprice >= 905 AND p_retailprice <= 1500)"""


@query("P1 P2", f"""
WITH {SEARCH_HITS} SELECT * FROM hits WHERE category = 'PROMO' AND brand = 'Brand#2'""")
def search_catalog(t: Tables) -> DataFrame:
    return catalog.search(t.catalog(), "RING", ["title", "brand", "category"], category="PROMO",
                          brand="Brand#2", min_price=905, max_price=1500)


@query("P3 W8", f"""
WITH {SEARCH_HITS}
SELECT *, (SELECT count(*) FROM hits) AS total_count FROM hits
ORDER BY md5('42:' || item_id), item_id LIMIT 20""")
def search_page(t: Tables) -> DataFrame:
    hits = catalog.search(t.catalog(), "ring", ["title", "brand", "category"],
                          min_price=905, max_price=1500)
    return catalog.search_page(hits)


@query("P4", """
SELECT 'category' AS kind, p_type AS value FROM part GROUP BY ALL
UNION ALL
SELECT 'brand', p_brand FROM (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 20)""")
def filter_options(t: Tables) -> DataFrame:
    return catalog.filter_options(t.catalog())


@query("A8", "SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1")
def category_counts(t: Tables) -> DataFrame:
    return catalog.value_counts(t.catalog(), "category")


@query("A8", "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_brands(t: Tables) -> DataFrame:
    return catalog.value_counts(t.catalog(), "brand", top=10)


@query("A8", f"""
WITH {INTERACTIONS} SELECT round(rating, 6) AS rating, count(*) AS n FROM interactions GROUP BY 1""")
def rating_distribution(t: Tables) -> DataFrame:
    rows = t.orders_and_lines().select(F.round("rating", 6).alias("rating"))
    return catalog.value_counts(rows, "rating")


@query("A9", f"""
WITH {INTERACTIONS}
SELECT (SELECT count(*) FROM part) AS product_count,
       (SELECT count(DISTINCT p_type) FROM part) AS category_count,
       count(*) AS interaction_count, count(DISTINCT user_id) AS user_count,
       round(avg(rating), 6) AS avg_rating FROM interactions""")
def dataset_overview(t: Tables) -> DataFrame:
    return rounded(catalog.dataset_overview(t.catalog(), t.interactions(catalog=False)))


@query("A8", """
SELECT p_type AS category, p_brand AS brand, count(*) AS item_count,
       round(avg(p_retailprice), 6) AS avg_price
FROM part GROUP BY ROLLUP (p_type, p_brand)""")
def category_brand_rollup(t: Tables) -> DataFrame:
    return rounded(catalog.category_brand_rollup(t.catalog()))


IMAGES = """
pictured AS (
  SELECT p_partkey AS item_id, p_name AS title, p_type AS category, p_brand AS brand,
         p_retailprice AS price, url, url IS NOT NULL AS has_image
  FROM part LEFT JOIN pages ON page_id = p_partkey)"""


@query("W6 U2", f"""
WITH {IMAGES}
SELECT item_id, title, has_image FROM pictured
ORDER BY has_image DESC, md5('7:' || item_id), item_id LIMIT 40""")
def sample_with_images_first(t: Tables) -> DataFrame:
    rows = ranking.sample_with_images_first(t.items_with_images(), 40, seed=7)
    return rows.select("item_id", "title", (F.size("valid_image_urls") > 0).alias("has_image"))


@query("W8", """
SELECT p_partkey AS item_id, p_name AS title FROM part
ORDER BY md5('43:' || p_partkey), p_partkey LIMIT 25""")
def seeded_sample(t: Tables) -> DataFrame:
    return ranking.seeded_sample(t.catalog(), "item_id", 25, seed=43).select("item_id", "title")


@query("P9 P10 J7", f"""
WITH {INTERACTIONS}, {REVIEWED}
SELECT item_id, CASE WHEN length(title) > 8 THEN substr(title, 1, 8) || '...' ELSE title END AS title,
       repeat('⭐', trunc(rating)::INTEGER) AS stars, printf('$%.2f', price) AS price_label,
       CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE '📦' END AS picture
FROM reviewed LEFT JOIN pages ON page_id = item_id""")
def display_cards(t: Tables) -> DataFrame:
    items = t.items_with_images().join(reviewed(t).select("item_id", "rating"), "item_id")
    return catalog.display_cards(items, title_limit=8)


@query("S12", """
SELECT count(*) AS item_count, count(url) AS with_images, count(*) - count(url) AS without_images,
       count(CASE WHEN url <> '' THEN 1 END) AS non_empty_urls,
       count(CASE WHEN regexp_matches(url, '^https?://') THEN 1 END) AS web_urls
FROM part LEFT JOIN pages ON page_id = p_partkey""")
def image_coverage(t: Tables) -> DataFrame:
    return checks.image_coverage(t.items_with_images())


@query("S11", """
SELECT 0 AS position, 'o_orderkey' AS column_name, 'bigint' AS data_type, count(*) AS row_count,
       count(o_orderkey) AS filled_count FROM orders
UNION ALL SELECT 1, 'o_custkey', 'bigint', count(*), count(o_custkey) FROM orders
UNION ALL SELECT 2, 'o_orderstatus', 'string', count(*), count(o_orderstatus) FROM orders
UNION ALL SELECT 3, 'o_totalprice', 'double', count(*), count(o_totalprice) FROM orders
UNION ALL SELECT 4, 'o_orderdate', 'timestamp_ntz', count(*), count(o_orderdate) FROM orders
UNION ALL SELECT 5, 'o_orderpriority', 'string', count(*), count(o_orderpriority) FROM orders""")
def table_shape(t: Tables) -> DataFrame:
    return checks.table_shape(t.read("orders"))


@query("S11", """
SELECT p_partkey AS item_id, p_name AS title, p_type AS category, p_brand AS brand,
       p_retailprice AS price FROM part ORDER BY 1 LIMIT 5""")
def sample_rows(t: Tables) -> DataFrame:
    return checks.sample_rows(t.catalog(), "item_id")


def _category_paths(t: Tables, kind: str, rows: DataFrame, rename: dict) -> list[str]:
    """Write one ``<kind>_<category>_cleaned.parquet`` per category.

    Every file gets its own spelling of the columns, as the sources have.
    """
    folder = scratch_path(t.spark, kind)
    # worked out once, not once per category; a hash, because folder names cannot tell an empty category from null
    share = F.pmod(F.xxhash64("category"), F.lit(1024)).cast("int")
    rows.withColumn("_share", share).write.partitionBy("_share").parquet(f"{folder}/all")
    schema = StructType([*rows.schema.fields, StructField("_share", IntegerType())])
    stored = t.spark.read.schema(schema).parquet(f"{folder}/all")
    paths = []
    for (category,) in t.catalog().select("category").distinct().orderBy("category").collect():
        mine = F.pmod(F.xxhash64(F.lit(category).cast("string")), F.lit(1024)).cast("int")
        part = stored.where((F.col("_share") == mine) & (F.col("category") == category)).drop("category", "_share")
        for old, new in rename.get(category, {}).items():
            part = part.drop(old) if new is None else part.withColumnRenamed(old, new)
        paths.append(f"{folder}/{kind}_{category}_cleaned.parquet")
        part.write.parquet(paths[-1])
    return [*paths, f"{folder}/{kind}_Nothing_cleaned.parquet"]


@query("S1 S2 S3 S5 U1", """
SELECT p_partkey::VARCHAR AS item_id, p_name AS title, p_type AS category,
       CASE WHEN p_type = 'SMALL' THEN 'Unknown' ELSE p_brand END AS brand,
       CASE WHEN p_type = 'LARGE' THEN 0.0 ELSE p_retailprice END AS price,
       url AS first_image, CASE WHEN url IS NULL THEN 0 ELSE 1 END AS image_count
FROM part LEFT JOIN pages ON page_id = p_partkey""")
def catalog_files_combined(t: Tables) -> DataFrame:
    rows = t.items_with_images().select(
        F.col("item_id").cast("string").alias("asin"), "title", "category", "brand", "price",
        F.to_json("valid_image_urls").alias("valid_image_urls"))
    paths = _category_paths(t, "products", rows, {
        "SMALL": {"brand": None}, "LARGE": {"price": None}, "PROMO": {"title": "product_title"},
        "MEDIUM": {"title": "name"}})
    products = catalog_files.load_products(t.spark, paths)
    folder = scratch_path(t.spark, "combined")
    catalog_files.save_combined(products, products.select("asin", "category"), folder)
    saved = t.spark.read.parquet(f"{folder}/real_items.parquet")
    return saved.select("item_id", "title", "category", "brand", "price",
                        F.get("valid_image_urls", F.lit(0)).alias("first_image"),
                        F.size("valid_image_urls").alias("image_count"))


@query("S2 S1 U1", """
SELECT p_type || '_' || (row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_brand, p_retailprice) - 1) AS item_id,
       p_name AS title, p_type AS category, p_brand AS brand, p_retailprice AS price FROM part""")
def catalog_files_without_ids(t: Tables) -> DataFrame:
    """Files that have no id of their own: items are numbered within their category, in the order of their columns."""
    rows = t.catalog().select("title", "brand", "price", "category")
    products = catalog_files.load_products(t.spark, _category_paths(t, "products", rows, {}))
    return products.select("item_id", "title", "category", "brand", "price")


@query("S4 U1", f"""
WITH {INTERACTIONS}
SELECT category, item_id AS asin, count(*) AS reviews, round(avg(rating), 6) AS overall
FROM interactions GROUP BY ALL""")
def review_files_combined(t: Tables) -> DataFrame:
    rows = t.interactions().select(
        F.col("item_id").alias("asin"), F.col("rating").alias("overall"),
        F.col("user_id").alias("reviewerID"), "category")
    paths = _category_paths(t, "reviews", rows, {
        "SMALL": {"asin": "item_id"}, "LARGE": {"asin": "product_id", "overall": "rating"},
        "PROMO": {"overall": "star_rating"}})
    reviews = catalog_files.load_reviews(t.spark, paths)
    return rounded(reviews.groupBy("category", "asin").agg(
        F.count("*").alias("reviews"), F.avg("overall").alias("overall")))


def registered_categories(t: Tables) -> DataFrame:
    """The category each customer named: that of the item with the same number."""
    return t.read("customer").where("c_acctbal > 0").join(
        t.catalog(), F.col("c_custkey") == F.col("item_id")).select(
        F.col("c_custkey").alias("user_id"), "category")


def targets(t: Tables) -> DataFrame:
    users = t.read("customer").select(F.col("c_custkey").alias("user_id"))
    return target_categories(users, t.profile_entries(), registered_categories(t), t.catalog())


TARGETS = f"""
{ENTRIES},
named AS (SELECT c_custkey AS user_id, p_type AS category FROM customer JOIN part ON c_custkey = p_partkey
          WHERE c_acctbal > 0),
bought AS (SELECT DISTINCT user_id, category FROM entries WHERE kind = 'purchase'),
wished AS (SELECT DISTINCT user_id, category FROM entries WHERE kind = 'wishlist'),
labelled AS (
  SELECT user_id, category, 'purchase history' AS source FROM
    (SELECT * FROM bought UNION
     SELECT * FROM wished WHERE user_id IN (SELECT user_id FROM bought))
  UNION ALL SELECT user_id, category, 'wishlist' FROM wished
    WHERE user_id NOT IN (SELECT user_id FROM bought)
  UNION ALL SELECT user_id, category, 'registration preferences' FROM named
    WHERE user_id NOT IN (SELECT user_id FROM bought) AND user_id NOT IN (SELECT user_id FROM wished)),
targets AS (
  SELECT c_custkey AS user_id, coalesce(string_agg(category, ',' ORDER BY category), '') AS categories,
         coalesce(any_value(source), 'general') AS source
  FROM customer LEFT JOIN labelled ON c_custkey = user_id GROUP BY 1)"""


@query("M16 U3", f"""
WITH {INTERACTIONS}, {TARGETS} SELECT user_id, categories, source FROM targets""")
def user_target_categories(t: Tables) -> DataFrame:
    return targets(t).select("user_id", F.array_join("categories", ",").alias("categories"), "source")


@query("P5 W6 M16", f"""
WITH {INTERACTIONS}, {TARGETS}, {IMAGES},
ranked AS (
  SELECT t.user_id, p.item_id, p.category, t.categories <> '' AS targeted,
         row_number() OVER (PARTITION BY t.user_id
           ORDER BY has_image DESC, md5('42:' || p.item_id), p.item_id) AS rank
  FROM targets t JOIN pictured p
    ON t.categories = '' OR list_contains(string_split(t.categories, ','), p.category))
SELECT user_id, item_id, category, targeted, rank::INTEGER AS rank FROM ranked WHERE rank <= 10""")
def items_for_target_categories(t: Tables) -> DataFrame:
    return catalog.items_for_categories(
        targets(t).select("user_id", "categories"), t.items_with_images(), 10)


@query("P5 W6 M16", f"""
WITH {INTERACTIONS}, {TARGETS}, {IMAGES},
gaps AS (SELECT * REPLACE (CASE WHEN item_id % 5 = 0 THEN NULL ELSE category END AS category) FROM pictured),
ranked AS (
  SELECT t.user_id, p.item_id, p.category, t.categories <> '' AS targeted,
         row_number() OVER (PARTITION BY t.user_id
           ORDER BY has_image DESC, md5('42:' || p.item_id), p.item_id) AS rank
  FROM targets t JOIN gaps p
    ON t.categories = '' OR list_contains(string_split(t.categories, ','), p.category))
SELECT user_id, item_id, category, targeted, rank::INTEGER AS rank FROM ranked WHERE rank <= 10""")
def items_beside_uncategorised_ones(t: Tables) -> DataFrame:
    """A catalog in which a fifth of the items has no category: those stand on the general list only, and once."""
    category = F.when(F.col("item_id") % 5 != 0, F.col("category"))
    return catalog.items_for_categories(
        targets(t).select("user_id", "categories"), t.items_with_images().withColumn("category", category), 10)
