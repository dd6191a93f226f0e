"""Profiles, cold start, similarity, merged lists and evaluation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import coldstart, evaluation, features, models, profiles, recommend
from basketry.operators import hashed_search, shared_ratings, similarity
from basketry.operators.ranking import top_items_per_user, top_n_per_group
from basketry.plans.catalog_queries import reviewed
from basketry.plans.feature_queries import AS_OF, USER_FEATURES
from basketry.plans.registry import (
    ENTRIES, HALF, INTERACTIONS, ITEM_STATS, REVIEWED, moment, query, rounded)
from basketry.session import cut_lineage, scratch_path
from basketry.sources.profiles import (
    entries_from_profiles, load_profile_files, load_saved_profiles, save_profile_files, save_profiles)
from basketry.sources.tables import Tables


def customers(t: Tables) -> DataFrame:
    return t.read("customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("email"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("registered"))


@query("A10", f"""
WITH {INTERACTIONS}, {ENTRIES}
SELECT (SELECT count(*) FROM customer) AS registered_users,
       count(DISTINCT CASE WHEN kind IN ('purchase', 'wishlist') THEN user_id END) AS active_users,
       count(CASE WHEN kind = 'purchase' THEN 1 END) AS total_purchases,
       count(CASE WHEN kind = 'wishlist' THEN 1 END) AS total_wishlist,
       count(CASE WHEN kind = 'cart' THEN 1 END) AS total_cart,
       round(sum(CASE WHEN kind = 'purchase' THEN price END), 2) AS total_spent FROM entries""")
def activity_totals(t: Tables) -> DataFrame:
    return rounded(profiles.activity_totals(customers(t), t.profile_entries()), 2)


@query("A11", f"""
WITH {INTERACTIONS}, {ENTRIES}
SELECT c_custkey AS user_id,
       CASE WHEN c_acctbal > 0 THEN lower(c_name) || '@example.com' ELSE 'N/A' END AS email,
       CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'N/A' END AS registered,
       count(CASE WHEN kind = 'purchase' THEN 1 END) AS purchase_items,
       count(CASE WHEN kind = 'wishlist' THEN 1 END) AS wishlist_items,
       count(CASE WHEN kind = 'cart' THEN 1 END) AS cart_items
FROM customer LEFT JOIN entries ON c_custkey = user_id GROUP BY ALL""")
def user_details(t: Tables) -> DataFrame:
    return profiles.user_detail_rows(customers(t), t.profile_entries())


@query("A13", f"""
WITH {INTERACTIONS}, {ENTRIES}
SELECT user_id, kind, count(*) AS entry_count, round(sum(price) + {HALF}, 3) AS total_price,
       count(DISTINCT category) AS category_count FROM entries GROUP BY user_id, kind""")
def list_summaries(t: Tables) -> DataFrame:
    return rounded(profiles.list_summaries(t.profile_entries()), 3, lift=HALF)


@query("W7", f"""
WITH {INTERACTIONS}, {ENTRIES}
SELECT user_id, item_id, title, category, brand, price, added_at
FROM entries WHERE kind = 'purchase'""")
def purchase_list(t: Tables) -> DataFrame:
    return profiles.purchase_list(t.profile_entries())


@query("A13 W7", f"""
WITH {INTERACTIONS}, {ENTRIES},
moved AS (SELECT user_id, item_id, CASE WHEN kind = 'cart' THEN 'purchase' ELSE kind END AS kind,
                 CASE WHEN kind = 'cart' THEN TIMESTAMP '{AS_OF}' ELSE added_at END AS added_at, price
          FROM entries)
SELECT user_id, kind, count(*) AS entry_count, max(added_at) AS newest FROM moved GROUP BY ALL""")
def lists_after_checkout(t: Tables) -> DataFrame:
    moved = profiles.checkout(t.profile_entries(), moment(AS_OF))
    return moved.groupBy("user_id", "kind").agg(
        F.count("*").alias("entry_count"), F.max("added_at").alias("newest"))


# Large items have an asin; the others are told apart by title and price.
@query("J10", f"""
WITH {INTERACTIONS}, {ENTRIES},
marked AS (SELECT user_id, kind, CASE WHEN p_size > 25 THEN item_id::VARCHAR END AS asin, title,
                  p_retailprice AS price
           FROM entries JOIN part ON item_id = p_partkey),
wish AS (SELECT DISTINCT * FROM marked WHERE kind = 'wishlist'),
cart AS (SELECT DISTINCT user_id, asin, title, price FROM marked WHERE kind = 'cart')
SELECT user_id, asin, title, price FROM cart c
WHERE NOT EXISTS (SELECT 1 FROM wish w WHERE w.user_id = c.user_id AND (
  w.asin = c.asin OR (c.asin IS NULL AND w.title = c.title AND abs(w.price - c.price) < 0.01)))""")
def new_wishlist_entries(t: Tables) -> DataFrame:
    part = t.read("part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"),
        F.when(F.col("p_size") > 25, F.col("p_partkey").cast("string")).alias("asin"))
    lines = t.orders_and_lines().where("status <> 'F'").select(
        "user_id", "item_id", F.when(F.col("status") == "O", "wishlist").otherwise("cart").alias("kind"))
    marked = cut_lineage(lines.join(part, "item_id").select("user_id", "kind", "asin", "title", "price").distinct(), "marked")
    fields = ["user_id", "asin", "title", "price"]
    return profiles.new_entries(marked.where("kind = 'cart'").select(fields),
                                marked.where("kind = 'wishlist'").select(fields))


@query("S6 S7", f"""
WITH {INTERACTIONS}, {ENTRIES},
listed AS (SELECT DISTINCT user_id, kind, item_id, title, category FROM entries)
SELECT user_id::VARCHAR AS user_id, kind, item_id::VARCHAR AS item_id, title, category FROM listed""")
def profile_documents(t: Tables) -> DataFrame:
    """Write each user's lists as profiles, read them back."""
    distinct = t.profile_entries().select("user_id", "kind", "item_id", "title", "category").distinct()
    entry = F.struct(F.col("item_id").cast("string").alias("item_id"), "title", "category")

    def listed(kind: str):
        return F.collect_list(F.when(F.col("kind") == kind, entry))

    documents = distinct.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(
        listed("purchase").alias("purchase_history"), listed("wishlist").alias("wishlist"),
        listed("cart").alias("cart"))
    folder = scratch_path(t.spark, "profiles")
    save_profiles(documents, folder)
    loaded = entries_from_profiles(load_saved_profiles(t.spark, folder))
    return loaded.select("user_id", "kind", "item_id", "title", "category")


@query("S6 A13", f"""
WITH {INTERACTIONS}, {ENTRIES},
listed AS (SELECT DISTINCT user_id, kind, item_id, title, category FROM entries WHERE user_id % 13 <> 4)
SELECT user_id::VARCHAR AS user_id, count(*) FILTER (kind = 'purchase') AS purchases,
       count(*) FILTER (kind = 'wishlist') AS wished, count(*) FILTER (kind = 'cart') AS in_cart
FROM listed GROUP BY 1""")
def profiles_one_file_each(t: Tables) -> DataFrame:
    """One file per user; every thirteenth breaks off in the middle, and is passed over."""
    entry = F.struct(F.col("item_id").cast("string").alias("item_id"), "title", "category")
    distinct = t.profile_entries().select("user_id", "kind", "item_id", "title", "category").distinct()
    listed = [F.collect_list(F.when(F.col("kind") == k, entry)).alias(n) for k, n in (
        ("purchase", "purchase_history"), ("wishlist", "wishlist"), ("cart", "cart"))]
    text = F.to_json(F.struct("purchase_history", "wishlist", "cart"))
    whole = F.when(F.col("user_id") % 13 == 4, F.left(text, F.lit(30))).otherwise(text)
    folder = scratch_path(t.spark, "profiles")
    save_profile_files(distinct.groupBy("user_id").agg(*listed).select("user_id", whole.alias("value")), folder)
    return load_profile_files(t.spark, folder).select(
        "user_id", *[F.size(c).cast("long").alias(n) for c, n in (
            ("purchase_history", "purchases"), ("wishlist", "wished"), ("cart", "in_cart"))])


def stated_preferences(t: Tables) -> DataFrame:
    """Preferences by customer: some name categories, brands or prices, some not.

    Customers who owe money were not asked and have no profile.
    """
    named = t.read("customer").where("c_acctbal >= 0").join(
        t.catalog(), F.col("c_custkey") == F.col("item_id"), "left")
    none = F.array().cast("array<string>")
    return named.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.array("category", F.lit("PROMO"))).otherwise(none)
        .alias("categories"),
        F.when(F.col("c_nationkey") < 12, F.array("brand", F.lit("Brand#1"), F.lit("Brand#2")))
        .otherwise(none).alias("brands"),
        F.when(F.col("c_acctbal") > 1000, 900 + F.col("c_acctbal") / 100).alias("min_price"),
        F.when(F.col("c_acctbal") > 2000, 950 + F.col("c_acctbal") / 50).alias("max_price"))


PREFERENCES = """
preferences AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN [p_type, 'PROMO'] ELSE [] END AS categories,
         CASE WHEN c_nationkey < 12 THEN [p_brand, 'Brand#1', 'Brand#2'] ELSE [] END AS brands,
         CASE WHEN c_acctbal > 1000 THEN 900 + c_acctbal / 100 END AS min_price,
         CASE WHEN c_acctbal > 2000 THEN 950 + c_acctbal / 50 END AS max_price
  FROM customer LEFT JOIN part ON c_custkey = p_partkey WHERE c_acctbal >= 0),
allowed AS (
  SELECT user_id, item_id, round(rating, 9) AS rating, review_count,
         least(round(rating, 9) * 0.5 + CASE WHEN list_contains(categories, category) THEN 0.3 ELSE 0 END
               + CASE WHEN list_contains(brands, brand) THEN 0.2 ELSE 0 END, 5.0) AS score,
         row_number() OVER (PARTITION BY user_id
           ORDER BY round(rating, 9) DESC, review_count DESC, item_id) AS rank
  FROM preferences JOIN reviewed
    ON (len(categories) = 0 OR list_contains(categories, category))
   AND (len(brands) = 0 OR list_contains(brands, brand))
   AND price >= coalesce(min_price, '-inf'::DOUBLE) AND price <= coalesce(max_price, 'inf'::DOUBLE))"""


def _priced_catalog(t: Tables) -> DataFrame:
    return reviewed(t).withColumn("rating", F.round("rating", 9))


@query("P6 M15 W4", f"""
WITH {INTERACTIONS}, {REVIEWED}, {PREFERENCES}
SELECT user_id, item_id, round(rating + {HALF}, 6) AS rating, review_count, round(score + {HALF}, 6) AS score,
       rank::INTEGER AS rank FROM allowed WHERE rank <= 10""")
def cold_start(t: Tables) -> DataFrame:
    return rounded(coldstart.cold_start_recommendations(
        stated_preferences(t), _priced_catalog(t), 10), lift=HALF)


@query("M15 W3", f"""
WITH {INTERACTIONS}, {REVIEWED}, {PREFERENCES},
popular AS (SELECT item_id, round(rating, 9) AS rating, review_count, row_number() OVER (
              ORDER BY round(rating, 9) DESC, review_count DESC, item_id) AS rank
            FROM reviewed QUALIFY rank <= 10)
SELECT user_id, item_id, round(rating + {HALF}, 6) AS rating, review_count, round(score + {HALF}, 6) AS score,
       rank::INTEGER AS rank, 'profile' AS source FROM allowed WHERE rank <= 10
UNION ALL
SELECT c_custkey, item_id, round(rating + {HALF}, 6), review_count, round(rating + {HALF}, 6), rank::INTEGER, 'popular'
FROM customer, popular WHERE c_custkey NOT IN (SELECT user_id FROM preferences)""")
def new_user_recommendations(t: Tables) -> DataFrame:
    return rounded(coldstart.recommend_new_users(
        customers(t), stated_preferences(t), _priced_catalog(t), 10), lift=HALF)


# --------------------------------------------------------------------------
# similarity


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings().select(F.col("item_id").alias("id"), "vector")


@query("M8 W5 J10", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (
  SELECT a.vec_id AS source_id, b.vec_id AS neighbor_id,
         list_inner_product(a.e, b.e)
           / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS similarity
  FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT source_id, neighbor_id, round(round(similarity, 9) + {HALF}, 6) AS similarity,
       (row_number() OVER (PARTITION BY source_id
          ORDER BY round(similarity, 9) DESC, neighbor_id))::INTEGER AS rank
FROM pairs QUALIFY rank <= 10""")
def similar_items(t: Tables) -> DataFrame:
    return rounded(similarity.similar_items(_vectors(t), 10), lift=HALF)


@query("M8 W5", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 7 <> 3),
pairs AS (
  SELECT a.vec_id AS source_id, b.vec_id AS neighbor_id,
         list_inner_product(a.e, b.e)
           / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS similarity
  FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT source_id, neighbor_id, round(round(similarity, 9) + {HALF}, 6) AS similarity,
       (row_number() OVER (PARTITION BY source_id
          ORDER BY round(similarity, 9) DESC, neighbor_id))::INTEGER AS rank
FROM pairs QUALIFY rank <= 5""")
def similar_items_beside_broken_ones(t: Tables) -> DataFrame:
    """Every seventh vector has a component that is no number, is infinite or unknown, and takes no part."""
    broken = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, F.lit(float("inf")))
    damaged = F.concat(F.array(broken), F.slice("vector", 2, 1_000_000))
    vectors = _vectors(t).withColumn("vector", F.when(F.col("id") % 7 == 3, damaged).otherwise(F.col("vector")))
    return rounded(similarity.similar_items(vectors, 5), lift=HALF)


@query("M8", """
SELECT count(*) AS sources, 10 * count(*) AS entries, 0::BIGINT AS wrong, TRUE AS recall_reached FROM embeddings""")
def hashed_search_recall(t: Tables) -> DataFrame:
    """The lists of the hashed search against the exact ones: nine in ten entries at least, with their true similarity."""
    hashed = hashed_search.hash_vectors(_vectors(t), 10)
    found = hashed_search.recall_of(hashed_search.hashed_neighbors(hashed, 10), similarity.similar_items(_vectors(t), 10))
    return found.select("sources", "entries", "wrong", (F.col("found") >= 0.9 * F.col("entries")).alias("recall_reached"))


@query("M7", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS a, a.vec_id + 1 AS b,
       round(coalesce(list_inner_product(a.e, b.e)
         / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 0), 6) AS similarity
FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 1""")
def pair_similarity(t: Tables) -> DataFrame:
    vectors = _vectors(t)
    pairs = vectors.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return rounded(similarity.pair_similarity(pairs, vectors))


def _neighbors_sql(entity: str, feature: str) -> str:
    return f"""
WITH {INTERACTIONS},
ratings AS (SELECT {entity} AS e, {feature} AS f, avg(rating) AS r FROM interactions GROUP BY ALL),
lengths AS (SELECT e, sqrt(sum(r * r)) AS l FROM ratings GROUP BY e),
pairs AS (
  SELECT a.e AS source_id, b.e AS neighbor_id, sum(a.r * b.r) AS d
  FROM ratings a JOIN ratings b ON a.f = b.f AND a.e <> b.e GROUP BY ALL),
scored AS (
  SELECT source_id, neighbor_id, d / (x.l * y.l) AS similarity
  FROM pairs JOIN lengths x ON source_id = x.e JOIN lengths y ON neighbor_id = y.e)
SELECT source_id, neighbor_id, round(round(similarity, 9) + {HALF}, 6) AS similarity,
       (row_number() OVER (PARTITION BY source_id
          ORDER BY round(similarity, 9) DESC, neighbor_id))::INTEGER AS rank
FROM scored QUALIFY rank <= 10"""


@query("M9", _neighbors_sql("user_id", "item_id"))
def similar_users_by_ratings(t: Tables) -> DataFrame:
    ratings = features.user_item_ratings(t.interactions(catalog=False))
    return rounded(shared_ratings.rating_neighbors(ratings, "user_id", "item_id", 10), lift=HALF)


@query("M9", _neighbors_sql("item_id", "user_id"))
def similar_items_by_ratings(t: Tables) -> DataFrame:
    ratings = features.user_item_ratings(t.interactions(catalog=False))
    return rounded(shared_ratings.rating_neighbors(ratings, "item_id", "user_id", 10), lift=HALF)


# --------------------------------------------------------------------------
# merged lists and explanations


def two_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two scores per user and item: how well rated, and how recent."""
    return lists_of(t.interactions(catalog=False))


def lists_of(interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    # both lists need it, each with other columns: aggregate once
    per_pair = cut_lineage(interactions.groupBy("user_id", "item_id").agg(
        F.round(F.avg("rating"), 9).alias("rated"), F.max("ts").alias("last")))
    days = F.timestamp_diff("DAY", F.col("last"), moment(AS_OF))
    rated = per_pair.select("user_id", "item_id", F.col("rated").alias("score"))
    recent = per_pair.select(
        "user_id", "item_id", F.round(5 / (1 + days / 365), 9).alias("score"))
    return rated, recent


def merged_lists(t: Tables, n: int = 10) -> DataFrame:
    rated, recent = two_lists(t)
    merged = recommend.merge_scores(rated, recent, n)
    return merged.withColumn("score", F.round("score", 9))


MERGED = f"""
per_pair AS (
  SELECT user_id, item_id, round(avg(rating), 9) AS rated,
         round(5 / (1 + date_sub('day', max(ts), TIMESTAMP '{AS_OF}') / 365), 9) AS recent
  FROM interactions GROUP BY ALL),
sides AS (
  SELECT user_id, item_id, rated * 0.6 AS part FROM per_pair
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rated DESC, item_id) <= 20
  UNION ALL
  SELECT user_id, item_id, recent * 0.4 FROM per_pair
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY recent DESC, item_id) <= 20),
merged AS (
  SELECT user_id, item_id, round(score, 9) AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT user_id, item_id, sum(part) AS score FROM sides GROUP BY user_id, item_id)
  QUALIFY rank <= 10)"""


@query("J8 W1", f"""
WITH {INTERACTIONS}, {MERGED}
SELECT user_id, item_id, round(score + {HALF}, 6) AS score, rank::INTEGER AS rank FROM merged""")
def hybrid_lists(t: Tables) -> DataFrame:
    return rounded(merged_lists(t), lift=HALF)


@query("W1", f"""
WITH {INTERACTIONS},
pairs AS (SELECT user_id, item_id, round(avg(rating), 9) AS score FROM interactions GROUP BY ALL)
SELECT user_id, item_id, round(score + {HALF}, 6) AS score,
       (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id))::INTEGER AS rank
FROM pairs QUALIFY rank <= 10""")
def top_items_of_users(t: Tables) -> DataFrame:
    return rounded(top_items_per_user(two_lists(t)[0], 10), lift=HALF)


@query("J11 P11 J8", f"""
WITH {INTERACTIONS}, {MERGED}, {USER_FEATURES}, {ITEM_STATS}
SELECT m.user_id, m.item_id, round(score + {HALF}, 6) AS score, m.rank::INTEGER AS rank,
       CASE WHEN parts = '' THEN 'Recommended based on your preferences' ELSE parts END AS explanation
FROM (
  SELECT merged.*, concat_ws(' | ',
    CASE WHEN favorite_category = p_type THEN 'Matches your interest in ' || p_type END,
    CASE WHEN price_sensitivity > 0.7 AND p_retailprice < 50 THEN 'Good value for money'
         WHEN price_sensitivity < 0.3 AND p_retailprice > 200 THEN 'Premium quality product' END,
    CASE WHEN i.avg_rating > 4.0 THEN printf('Highly rated (%.1f/5.0)', i.avg_rating) END,
    CASE WHEN popularity_score > 10 THEN 'Popular among customers' END) AS parts
  FROM merged JOIN user_features u USING (user_id) JOIN item_stats i USING (item_id)
              JOIN part ON p_partkey = merged.item_id) m""")
def explained_lists(t: Tables) -> DataFrame:
    rows = cut_lineage(t.interactions(discount=True), "interactions")  # read by three of the steps
    rated, recent = lists_of(rows)
    return rounded(recommend.explain(
        recommend.merge_scores(rated, recent, 10).withColumn("score", F.round("score", 9)),
        features.user_features(rows, moment(AS_OF)),
        features.item_features(t.catalog(), rows, moment(AS_OF))), lift=HALF)


# --------------------------------------------------------------------------
# evaluation

SPLIT = """
ratings AS (
  SELECT user_id, item_id, avg(rating) AS rating,
         ('0x' || substr(md5(user_id || ':' || item_id), 1, 8))::BIGINT % 100 < 20 AS held_out
  FROM interactions GROUP BY ALL)"""


def split_ratings(t: Tables) -> DataFrame:
    return evaluation.with_split(features.user_item_ratings(t.interactions(catalog=False)))


def _metrics_sql(k: int) -> str:
    return f"""
SELECT count(*) AS users, {k} AS k, round(avg(hits{k} / {k}), 6) AS precision,
       round(avg(hits{k} / relevant), 6) AS recall,
       round(avg(dcg{k} / (SELECT sum(1 / log2(i + 1)) FROM range(1, least({k}, relevant) + 1) r(i))), 6)
         AS ndcg
FROM per_user"""


@query("M18", f"""
WITH {INTERACTIONS}, {SPLIT},
top AS (
  SELECT item_id, row_number() OVER (ORDER BY round(avg(rating) * ln(1 + count(*)), 9) DESC, item_id) AS rank
  FROM ratings WHERE NOT held_out GROUP BY item_id QUALIFY rank <= 20),
per_user AS (
  SELECT user_id, count(*) AS relevant,
         count(CASE WHEN rank <= 5 THEN 1 END) AS hits5, count(CASE WHEN rank <= 10 THEN 1 END) AS hits10,
         count(rank) AS hits20,
         coalesce(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END), 0) AS dcg5,
         coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END), 0) AS dcg10,
         coalesce(sum(1 / log2(rank + 1)), 0) AS dcg20
  FROM ratings LEFT JOIN top USING (item_id) WHERE held_out AND rating >= 3 GROUP BY user_id)
{_metrics_sql(5)} UNION ALL {_metrics_sql(10)} UNION ALL {_metrics_sql(20)}""")
def popularity_ranking_metrics(t: Tables) -> DataFrame:
    ratings = cut_lineage(split_ratings(t), "split")
    top = evaluation.popularity_ranking(ratings.where("NOT held_out"), 20)
    relevant = ratings.where("held_out AND rating >= 3")
    return rounded(evaluation.ranking_metrics(evaluation.hits_of_shared_list(relevant, top)))


BASELINE = """
mean AS (SELECT avg(rating) AS m FROM ratings WHERE NOT held_out),
items AS (SELECT item_id, sum(rating - m) / (count(*) + 5) AS b FROM ratings, mean
          WHERE NOT held_out GROUP BY 1),
users AS (SELECT user_id, sum(rating - m - b) / (count(*) + 5) AS c
          FROM ratings JOIN items USING (item_id), mean WHERE NOT held_out GROUP BY 1),
predicted AS (
  SELECT user_id, item_id, rating, m + coalesce(b, 0) + coalesce(c, 0) AS prediction
  FROM ratings LEFT JOIN items USING (item_id) LEFT JOIN users USING (user_id), mean WHERE held_out)"""


def baseline(t: Tables) -> DataFrame:
    ratings = cut_lineage(split_ratings(t), "split")
    terms = models.bias_terms(ratings.where("NOT held_out"))
    held = ratings.where("held_out").drop("held_out")
    return models.baseline_prediction(held, *terms).withColumnRenamed("baseline", "prediction")


@query("M10 M14", f"""
WITH {INTERACTIONS}, {SPLIT}, {BASELINE}
SELECT user_id, item_id, round(rating, 6) AS rating, round(prediction, 6) AS prediction FROM predicted""")
def bias_predictions(t: Tables) -> DataFrame:
    return rounded(baseline(t))


@query("M18 M2", f"""
WITH {INTERACTIONS}, {SPLIT}, {BASELINE}
SELECT count(*) AS pairs, round(sqrt(avg((prediction - rating) ** 2)), 6) AS rmse,
       round(avg(abs(prediction - rating)), 6) AS mae FROM predicted""")
def bias_prediction_errors(t: Tables) -> DataFrame:
    return rounded(evaluation.rating_errors(baseline(t)))
