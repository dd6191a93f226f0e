"""Recommendations for users without history, from their stated preferences."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.ranking import popular_items, top_n_per_group
from basketry.session import cut_lineage, spread

ANY = "\u0000any"  # stands for "no constraint" in a join key

# Parts of the score and its upper bound.
RATING_SHARE, CATEGORY_BONUS, BRAND_BONUS, TOP_SCORE = 0.5, 0.3, 0.2, 5.0


def cold_start_score(rating: Column, category: Column, brand: Column,
                     categories: Column, brands: Column) -> Column:
    """Half the rating plus a bonus per matched preference, at most 5."""
    return _score(rating, F.array_contains(categories, category), F.array_contains(brands, brand))


def _score(rating: Column, category_fits: Column, brand_fits: Column) -> Column:
    score = (F.coalesce(rating, F.lit(0.0)) * RATING_SHARE
             + F.when(category_fits, CATEGORY_BONUS).otherwise(0.0)
             + F.when(brand_fits, BRAND_BONUS).otherwise(0.0))
    return F.least(score, F.lit(TOP_SCORE))


def cold_start_recommendations(
    profiles: DataFrame, catalog: DataFrame, n: int = 10, price_edges: int = 1024,
) -> DataFrame:
    """Top ``n`` items per profile by rating, reviews and id, with their score.

    ``profiles``: user_id, categories, brands (arrays; empty means any),
    min_price, max_price (null means open). ``catalog``: item_id, category,
    brand, price, rating, review_count.

    A profile never meets all items it allows. Prices are cut into bands, bands
    are grouped two by two into ever wider nodes, and every node keeps its best
    ``n`` items per category and brand. A price range is made of a few whole
    nodes plus the bands at its two ends, where every item is checked. So each
    profile meets at most ``n`` items per node, and the result is still exact.

    A shelf is a category and a brand that items have, either of which may be any.
    Whole nodes are met once for all profiles that ask for the same bands of a
    shelf, and rows bear the shelf's number, not the preferences: an item of a
    shelf fits every preference the shelf stands for.
    """
    # read several times below, and often the result of a long aggregation
    priced = cut_lineage(catalog.where(F.col("price").isNotNull()).select(
        "item_id", "category", "brand", F.col("price").cast("double").alias("price"),
        "rating", "review_count"))
    bands = _Bands(_price_edges(priced, price_edges))
    levels = bands.levels
    order = [F.desc("rating"), F.desc("review_count"), F.asc("item_id")]

    banded = bands.number(spread(priced, "item_id"), "price", "band")
    keyed = banded.withColumn("category_key", F.explode(_key_options("category"))).withColumn(
        "brand_key", F.explode(_key_options("brand")))
    keys = ["category_key", "brand_key"]
    shelves = cut_lineage(priced.select(
        F.explode(_key_options("category")).alias("category_key"), "brand").select(
        "category_key", F.explode(_key_options("brand")).alias("brand_key")).distinct().withColumn(
        "shelf", F.monotonically_increasing_id()), "shelves")
    item = ["item_id", "rating", "review_count"]
    stock = keyed.join(shelves, keys).select("shelf", "band", "price", *item)
    # whole nodes: the best n of each (shelf, level, node)
    nodes = stock.select("shelf", *item, F.posexplode(F.expr(
        f"transform(sequence(0, {levels}), l -> shiftright(band, l))")).alias("level", "node"))
    node_best = top_n_per_group(nodes, ["shelf", "level", "node"], order, n, "_r").drop("_r")
    # gaps between edges: all items, for the ends of a range
    gaps = stock.where(F.col("band") % 2 == 0).withColumnRenamed("band", "_gap")

    low = F.coalesce(F.col("min_price").cast("double"), F.lit(float("-inf")))
    high = F.coalesce(F.col("max_price").cast("double"), F.lit(float("inf")))
    ranged = profiles.select(
        "user_id", "categories", "brands", low.alias("_low"), high.alias("_high"),
    ).where("_low <= _high")
    ranged = bands.number(bands.number(ranged, "_low", "_a"), "_high", "_b")
    asked = cut_lineage(ranged.withColumn("category_key", F.explode(_wanted("categories"))).withColumn(
        "brand_key", F.explode(_wanted("brands"))).join(shelves, keys).select(
        "user_id", (F.col("category_key") != ANY).alias("_category_fits"), (F.col("brand_key") != ANY).alias("_brand_fits"),
        "shelf", "_a", "_b", "_low", "_high"), "asked")
    own = ["user_id", "_category_fits", "_brand_fits", *item]

    spans = ["shelf", "_a", "_b"]
    inside = asked.select(*spans).distinct().select(
        *spans, F.inline(F.expr(_RANGE_NODES.format(levels=levels)))).join(node_best, ["shelf", "level", "node"])
    lists = top_n_per_group(inside, spans, order, n, "_r").groupBy(*spans).agg(
        F.collect_list(F.struct(*item)).alias("_best"))
    of_nodes = asked.join(lists, spans).select(*own[:3], F.inline("_best"))
    ends = asked.withColumn("_gap", F.explode(F.filter(F.array_distinct(F.array("_a", "_b")), lambda x: x % 2 == 0)))
    of_gaps = ends.join(gaps, ["shelf", "_gap"]).where(F.col("price").between(F.col("_low"), F.col("_high"))).select(*own)

    best = top_n_per_group(of_nodes.unionByName(of_gaps), ["user_id"], order, n)
    score = _score(F.col("rating"), F.col("_category_fits"), F.col("_brand_fits"))
    return best.select("user_id", "item_id", "rating", "review_count", score.alias("score"), "rank")


def recommend_new_users(
    requests: DataFrame, profiles: DataFrame, catalog: DataFrame, n: int = 10,
) -> DataFrame:
    """Cold-start lists for users with a profile, popular items for the others."""
    ranked = cold_start_recommendations(
        profiles.join(requests.select("user_id"), "user_id", "left_semi"), catalog, n)
    unknown = requests.select("user_id").join(profiles.select("user_id"), "user_id", "left_anti")
    # one array of at most n items, attached to every user without a profile
    popular = popular_items(catalog, n).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("rating")).alias("_rating"), (-F.col("review_count")).alias("_reviews"), "item_id"))))
    listed = unknown.select("user_id", popular.scalar().alias("_popular"))
    general = listed.select("user_id", F.posexplode("_popular").alias("_position", "_item")).select(
        "user_id", "_item.item_id", (-F.col("_item._rating")).alias("rating"),
        (-F.col("_item._reviews")).alias("review_count"), (-F.col("_item._rating")).alias("score"),
        (F.col("_position") + 1).alias("rank"))
    return (ranked.withColumn("source", F.lit("profile"))
            .unionByName(general.withColumn("source", F.lit("popular"))))


# The nodes of a price range whose ends lie in bands _a and _b. An odd band is
# one price, so it is inside as a whole; an even band at an end is checked item
# by item instead. The whole bands between are covered by the fewest nodes:
# per level, the first and the last node inside whose parent is not inside.
_RANGE_NODES = """
flatten(transform(sequence(0, {levels}), l -> transform(
    filter(
      array_distinct(array(
        shiftright(_a + 1 - _a % 2 + shiftleft(1, l) - 1, l),
        shiftright(_b + _b % 2, l) - 1)),
      j -> shiftleft(j, l) >= _a + 1 - _a % 2
           AND shiftleft(j + 1, l) <= _b + _b % 2
           AND NOT (shiftleft(shiftright(j, 1), l + 1) >= _a + 1 - _a % 2
                    AND shiftleft(shiftright(j, 1) + 1, l + 1) <= _b + _b % 2)),
    j -> named_struct('level', l, 'node', j))))
"""


def _price_edges(catalog: DataFrame, count: int) -> list[float]:
    """Distinct price quantiles: a fixed, small number of values."""
    shares = [i / count for i in range(count + 1)]
    row = catalog.agg(
        F.percentile_approx("price", shares, 10 * count).alias("edges")).first()
    return sorted(set(row["edges"] or [0.0]))


class _Bands:
    """Odd bands are single edge prices, even bands the gaps between them.

    A price that very many items share is an edge, so it has a band of its own
    and never has to be checked item by item.
    """

    def __init__(self, edges: list[float]):
        self.slicer = Bucketizer(splits=[float("-inf"), *edges, float("inf")], outputCol="_slice")
        self.edges = F.expr("array(" + ", ".join(f"{e!r}D" for e in edges) + ")")
        self.levels = (2 * len(edges)).bit_length()

    def number(self, df: DataFrame, price: str, name: str) -> DataFrame:
        slot = F.col("_slice").cast("int")  # number of edges not above the price
        on_edge = F.coalesce(F.get(self.edges, slot - 1) == F.col(price), F.lit(False))
        sliced = self.slicer.setInputCol(price).transform(df)
        return sliced.withColumn(name, 2 * slot - on_edge.cast("int")).drop("_slice")


def _key_options(column: str) -> Column:
    return F.array_compact(F.array(F.lit(ANY), F.col(column).cast("string")))


def _wanted(column: str) -> Column:
    listed = F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<string>")))
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(ANY)))
