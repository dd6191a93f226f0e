"""Feature engineering and point-in-time retrieval."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import asof, features
from basketry.operators.evaluation import popularity_ranking
from basketry.operators.ids import id_map
from basketry.plans.registry import HALF, INTERACTIONS, ITEM_STATS, moment, query, rounded
from basketry.schemas import ITEM_FEATURE_TTL_DAYS, USER_FEATURE_TTL_DAYS
from basketry.sources.tables import Tables

AS_OF = "2001-09-01 00:00:00"
LAST_ORDERS = "2001-08-01 00:00:00"


@query("J4 S5", f"""
WITH {INTERACTIONS}
SELECT user_id, item_id, rating, ts, price, category, brand FROM interactions""")
def enriched_interactions(t: Tables) -> DataFrame:
    return t.interactions()


@query("A1", f"""
WITH {INTERACTIONS}
SELECT user_id, round(avg(rating), 6) AS avg_rating, count(rating) AS rating_count,
       min(ts) AS first_interaction, max(ts) AS last_interaction,
       round(avg(price), 4) AS avg_price, round(stddev_samp(price), 4) AS std_price
FROM interactions GROUP BY user_id""")
def user_stats(t: Tables) -> DataFrame:
    return rounded(features.user_stats(t.interactions(catalog=False)), avg_price=4, std_price=4)


@query("A2", f"""
WITH {INTERACTIONS},
counts AS (SELECT user_id, category, count(*) AS n FROM interactions GROUP BY ALL)
SELECT user_id, category AS favorite_category, n AS category_count FROM counts
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) = 1""")
def favorite_category(t: Tables) -> DataFrame:
    return features.favorite_category(t.interactions())


USER_FEATURES = f"""
favorites AS (
  SELECT user_id, category FROM (SELECT user_id, category, count(*) AS n FROM interactions GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) = 1),
user_features AS (
  SELECT user_id, avg(rating) AS avg_rating, count(rating) AS rating_count,
         any_value(f.category) AS favorite_category,
         1 / (stddev_samp(price) + 1) AS price_sensitivity,
         count(rating) / (date_sub('day', min(ts), max(ts)) + 1) AS activity_level,
         date_sub('day', min(ts), TIMESTAMP '{AS_OF}') AS account_age_days,
         date_sub('day', max(ts), TIMESTAMP '{AS_OF}') AS last_purchase_days_ago
  FROM interactions JOIN favorites f USING (user_id) GROUP BY user_id)"""


@query("A3 A1 A2 J2", f"""
WITH {INTERACTIONS}, {USER_FEATURES}
SELECT user_id, round(avg_rating, 6) AS avg_rating, rating_count, favorite_category,
       round(price_sensitivity, 8) AS price_sensitivity, round(activity_level, 6) AS activity_level,
       account_age_days, last_purchase_days_ago,
       TIMESTAMP '{AS_OF}' AS event_timestamp, TIMESTAMP '{AS_OF}' AS created_timestamp
FROM user_features""")
def user_features(t: Tables) -> DataFrame:
    return rounded(features.user_features(t.interactions(), moment(AS_OF)), price_sensitivity=8)


@query("A4", f"""
WITH {INTERACTIONS}, {ITEM_STATS}
SELECT item_id, round(avg_rating, 6) AS avg_rating, review_count, unique_users,
       round(popularity_score, 6) AS popularity_score FROM item_stats""")
def item_stats(t: Tables) -> DataFrame:
    return rounded(features.item_stats(t.interactions(catalog=False)))


@query("J1 A4", f"""
WITH {INTERACTIONS}, {ITEM_STATS},
discounts AS (SELECT l_partkey AS item_id, 100 * avg(l_discount) AS d FROM lineitem GROUP BY 1)
SELECT p.p_partkey AS item_id, p_type AS category, p_brand AS brand, p_retailprice AS price,
       round(coalesce(avg_rating, 0), 6) AS avg_rating, coalesce(review_count, 0) AS review_count,
       coalesce(unique_users, 0) AS unique_users,
       round(coalesce(popularity_score, 0), 6) AS popularity_score,
       round(d, 6) AS discount_percentage
FROM part p LEFT JOIN item_stats s ON p.p_partkey = s.item_id
            LEFT JOIN discounts d ON p.p_partkey = d.item_id""")
def item_features(t: Tables) -> DataFrame:
    found = features.item_features(t.catalog(), t.interactions(catalog=False, discount=True), moment(AS_OF))
    return rounded(found.drop("availability", "event_timestamp", "created_timestamp"))


@query("A5 J2", f"""
WITH {INTERACTIONS},
hours AS (SELECT user_id, h FROM (SELECT user_id, hour(ts) AS h, count(*) AS n FROM interactions GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) = 1),
days AS (SELECT user_id, d FROM (SELECT user_id, isodow(ts) - 1 AS d, count(*) AS n FROM interactions GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, d) = 1)
SELECT user_id, any_value(h) AS preferred_hour, any_value(d) AS preferred_day,
       round(avg(rating) + {HALF}, 6) AS avg_rating, round(stddev_samp(rating) + {HALF}, 6) AS rating_std,
       count(rating) AS total_interactions, round(avg(price) + {HALF}, 4) AS avg_price,
       round(min(price) + {HALF}, 4) AS min_price, round(max(price) + {HALF}, 4) AS max_price,
       count(DISTINCT category) AS category_diversity,
       date_sub('day', max(ts), TIMESTAMP '{AS_OF}') AS days_since_last_interaction
FROM interactions JOIN hours USING (user_id) JOIN days USING (user_id) GROUP BY user_id""")
def user_behavior(t: Tables) -> DataFrame:
    return rounded(features.user_behavior(t.interactions(), moment(AS_OF)), lift=HALF,
                   avg_price=4, min_price=4, max_price=4)


@query("A5", f"""
WITH hours AS (SELECT user_id, h FROM (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL)
               QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) = 1),
days AS (SELECT user_id, d FROM (SELECT user_id, isodow(ts) - 1 AS d, count(*) AS n FROM events GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, d) = 1)
SELECT user_id, any_value(h) AS preferred_hour, any_value(d) AS preferred_day,
       count(*) AS total_interactions, count(DISTINCT event_type) AS category_diversity
FROM events JOIN hours USING (user_id) JOIN days USING (user_id) WHERE user_id IS NOT NULL GROUP BY user_id""")
def user_event_hours(t: Tables) -> DataFrame:
    """Preferred hours over events, which unlike orders happen at all times of a day."""
    rows = t.events().where(F.col("user_id").isNotNull()).select(
        "user_id", F.lit(1.0).alias("rating"), F.col("value").alias("price"),
        F.col("event_type").alias("category"), "ts")
    return features.user_behavior(rows, moment(AS_OF)).select(
        "user_id", "preferred_hour", "preferred_day", "total_interactions", "category_diversity")


def _trend_sql(days: int) -> str:
    inside = f"ts >= TIMESTAMP '{LAST_ORDERS}' - INTERVAL {days} DAY"
    return f"""
       round(avg(CASE WHEN {inside} THEN rating END) + {HALF}, 6) AS avg_rating_{days}d,
       count(CASE WHEN {inside} THEN rating END) AS review_count_{days}d,
       count(DISTINCT CASE WHEN {inside} THEN user_id END) AS unique_users_{days}d,
       round(avg(CASE WHEN {inside} THEN price END) + {HALF}, 4) AS avg_price_{days}d"""


@query("A6 J3 P7", f"""
WITH {INTERACTIONS}
SELECT item_id, {_trend_sql(7)}, {_trend_sql(30)}, {_trend_sql(90)}
FROM interactions WHERE ts >= TIMESTAMP '{LAST_ORDERS}' - INTERVAL 90 DAY GROUP BY item_id""")
def item_trends(t: Tables) -> DataFrame:
    return rounded(features.item_trends(t.interactions(catalog=False), moment(LAST_ORDERS)),
                   lift=HALF, avg_price_7d=4, avg_price_30d=4, avg_price_90d=4)


@query("A7", f"""
WITH {INTERACTIONS}
SELECT user_id, item_id, round(avg(rating), 6) AS rating FROM interactions GROUP BY ALL""")
def user_item_ratings(t: Tables) -> DataFrame:
    return rounded(features.user_item_ratings(t.interactions(catalog=False)))


def user_snapshots(t: Tables) -> DataFrame:
    """Per user and month, what its orders looked like; known at month's end."""
    month = F.date_trunc("MONTH", "ts").cast("timestamp_ntz")
    end = (month + F.make_ym_interval(F.lit(0), F.lit(1))).alias("event_timestamp")
    return t.interactions(catalog=False).groupBy("user_id", end).agg(
        F.avg("rating").alias("avg_rating"), F.count("rating").alias("rating_count"),
    ).withColumn("created_timestamp", F.col("event_timestamp"))


USER_SNAPSHOTS = """
snapshots AS (
  SELECT user_id, date_trunc('month', ts) + INTERVAL 1 MONTH AS event_timestamp,
         avg(rating) AS avg_rating, count(rating) AS rating_count
  FROM interactions GROUP BY ALL)"""


@query("J5", f"""
WITH {INTERACTIONS}, {USER_SNAPSHOTS},
matched AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS event_timestamp,
         s.event_timestamp AS found, s.avg_rating, s.rating_count
  FROM orders ASOF LEFT JOIN snapshots s
    ON o_custkey = s.user_id AND o_orderdate >= s.event_timestamp),
fresh AS (SELECT *, found >= event_timestamp - INTERVAL {USER_FEATURE_TTL_DAYS} DAY AS ok FROM matched)
SELECT order_id, user_id, event_timestamp, CASE WHEN ok THEN found END AS feature_timestamp,
       round(CASE WHEN ok THEN avg_rating END, 6) AS avg_rating,
       CASE WHEN ok THEN rating_count END AS rating_count FROM fresh""")
def user_features_at_order_time(t: Tables) -> DataFrame:
    entities = t.read("orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("event_timestamp"),
        F.col("o_orderkey").alias("order_id"))
    return rounded(asof.historical_features(
        entities, user_snapshots(t), "user_id", ["avg_rating", "rating_count"],
        USER_FEATURE_TTL_DAYS))


@query("J5", f"""
WITH {INTERACTIONS},
snapshots AS (
  SELECT item_id, date_trunc('week', ts) + INTERVAL 7 DAY AS event_timestamp,
         avg(rating) AS avg_rating, count(rating) AS review_count
  FROM interactions GROUP BY ALL),
matched AS (
  SELECT l_partkey AS item_id, l_shipdate AS event_timestamp, l_orderkey AS order_id,
         s.event_timestamp AS found, s.avg_rating, s.review_count
  FROM lineitem ASOF LEFT JOIN snapshots s
    ON l_partkey = s.item_id AND l_shipdate >= s.event_timestamp),
fresh AS (SELECT *, found >= event_timestamp - INTERVAL {ITEM_FEATURE_TTL_DAYS} DAY AS ok FROM matched)
SELECT item_id, event_timestamp, order_id, CASE WHEN ok THEN found END AS feature_timestamp,
       round(CASE WHEN ok THEN avg_rating END, 6) AS avg_rating,
       CASE WHEN ok THEN review_count END AS review_count FROM fresh""")
def item_features_at_ship_time(t: Tables) -> DataFrame:
    entities = t.read("lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("event_timestamp"),
        F.col("l_orderkey").alias("order_id"))
    week = F.date_trunc("WEEK", "ts").cast("timestamp_ntz")
    snapshots = t.interactions(catalog=False).groupBy(
        "item_id", (week + F.make_dt_interval(F.lit(7))).alias("event_timestamp")).agg(
        F.avg("rating").alias("avg_rating"), F.count("rating").alias("review_count"),
    ).withColumn("created_timestamp", F.col("event_timestamp"))
    return rounded(asof.historical_features(
        entities, snapshots, "item_id", ["avg_rating", "review_count"], ITEM_FEATURE_TTL_DAYS))


@query("W2", f"""
WITH {INTERACTIONS}, {USER_SNAPSHOTS}
SELECT user_id, event_timestamp, event_timestamp AS created_timestamp,
       round(avg_rating, 6) AS avg_rating, rating_count FROM snapshots
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1""")
def latest_user_features(t: Tables) -> DataFrame:
    return rounded(asof.latest_features(user_snapshots(t), "user_id"))


@query("W2 P8", f"""
WITH {INTERACTIONS}, {USER_SNAPSHOTS},
latest AS (SELECT * FROM snapshots WHERE event_timestamp <= TIMESTAMP '2000-01-01'
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1)
SELECT c_custkey AS user_id, round(avg_rating, 6) AS avg_rating, rating_count
FROM customer LEFT JOIN latest ON c_custkey = user_id""")
def online_user_features(t: Tables) -> DataFrame:
    latest = asof.latest_features(user_snapshots(t), "user_id", moment("2000-01-01 00:00:00"))
    users = t.read("customer").select(F.col("c_custkey").alias("user_id"))
    return rounded(asof.online_features(
        users, latest, "user_id", ["user_features:avg_rating", "user_features:rating_count"]))


@query("T6", f"""
WITH {INTERACTIONS}, {USER_SNAPSHOTS}
SELECT user_id, event_timestamp, event_timestamp AS created_timestamp,
       round(avg_rating, 6) AS avg_rating, rating_count FROM snapshots
WHERE event_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY""")
def retained_user_features(t: Tables) -> DataFrame:
    return rounded(asof.expire_features(user_snapshots(t), moment(AS_OF)))


@query("J9", """
SELECT c_custkey AS user_id, (row_number() OVER (ORDER BY c_custkey) - 1)::INTEGER AS user_idx
FROM customer""")
def user_index(t: Tables) -> DataFrame:
    users = t.read("customer").select(F.col("c_custkey").alias("user_id"))
    return id_map(users, "user_id", "user_idx")


@query("P8", f"""
WITH {INTERACTIONS},
known AS (SELECT DISTINCT item_id FROM interactions WHERE ts < TIMESTAMP '1998-01-01')
SELECT user_id, count(*) AS n FROM interactions
WHERE ts >= TIMESTAMP '1998-01-01' AND item_id IN (SELECT item_id FROM known) GROUP BY 1""")
def interactions_with_known_items(t: Tables) -> DataFrame:
    """Later interactions whose item is in the id map of the earlier ones."""
    rows = t.interactions(catalog=False)
    known = id_map(rows.where(F.col("ts") < moment("1998-01-01 00:00:00")), "item_id", "item_idx")
    later = rows.where(F.col("ts") >= moment("1998-01-01 00:00:00"))
    return later.join(known, "item_id").groupBy("user_id").agg(F.count("*").alias("n"))
