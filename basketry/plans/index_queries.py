"""Stored indexes and summaries: sketches, text index, lookup tables, observed loads, variants."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import features, sketches, text_index
from basketry.operators.evaluation import popularity_ranking
from basketry.plans.catalog_queries import COLUMNS
from basketry.plans.event_queries import requests
from basketry.plans.feature_queries import LAST_ORDERS
from basketry.plans.registry import HALF, INTERACTIONS, moment, query, rounded
from basketry.session import scratch_path
from basketry.sources import checks, documents, results
from basketry.sources.lookup import LookupStore
from basketry.sources.tables import Tables

DAY = LAST_ORDERS[:10]


@query("A17", """
SELECT ts::DATE AS day, count(*) AS requests, round(avg(value), 6) AS latency_avg,
       round(count(CASE WHEN json_extract_string(props, '$.k')::INTEGER < 80 THEN 1 END) / count(*), 6) AS hit_rate,
       round(count(CASE WHEN event_type = 'error' THEN 1 END) / count(*), 6) AS error_rate,
       TRUE AS p50_near, TRUE AS p95_near, TRUE AS p99_near
FROM events GROUP BY 1""")
def service_days_from_hours(t: Tables) -> DataFrame:
    """Days from stored sketches of their hours, and whether the true ranks of their quantiles are near."""
    store = results.ResultStore(t.spark, scratch_path(t.spark, "sketches"))
    store.write("hours", sketches.service_sketches(requests(t)), "day")
    days = sketches.rolled_up(store.read("hours"))
    off = sketches.rank_errors(requests(t), days)
    return rounded(days.join(off, "day").select(
        "day", "requests", "latency_avg", "hit_rate", "error_rate",
        *[(F.col(f"off_{p}") <= sketches.RANK_ERROR).alias(f"{p}_near") for p in ("p50", "p95", "p99")]))


def _trends(days: int) -> str:
    inside = f"ts >= TIMESTAMP '{LAST_ORDERS}' - INTERVAL {days} DAY"
    return f"""
       round(avg(CASE WHEN {inside} THEN rating END) + {HALF}, 6) AS avg_rating_{days}d,
       count(CASE WHEN {inside} THEN rating END) AS review_count_{days}d, TRUE AS users_near_{days}d,
       round(avg(CASE WHEN {inside} THEN price END) + {HALF}, 4) AS avg_price_{days}d"""


def _stored_days(t: Tables, since: str) -> DataFrame:
    """Item days from ``since`` on, of which the last month was stored twice, the second time as a refresh."""
    store = results.ResultStore(t.spark, scratch_path(t.spark, "days"))
    rows = t.interactions(catalog=False)
    sketches.refresh_item_days(store, rows, since, "2100-01-01")
    sketches.refresh_item_days(store, rows, "2001-07-02", DAY)
    return store.read("item_days")


@query("A4 A6 P7", f"""
WITH {INTERACTIONS}
SELECT item_id, {_trends(7)}, {_trends(30)}, {_trends(90)}
FROM interactions WHERE ts >= TIMESTAMP '{LAST_ORDERS}' - INTERVAL 90 DAY GROUP BY item_id""")
def item_trends_from_days(t: Tables) -> DataFrame:
    """Trends merged from stored days; counts of users are estimates, held against the exact ones."""
    made = sketches.item_trends_from_days(_stored_days(t, "2001-05-03"), DAY)
    exact = features.item_trends(t.interactions(catalog=False), moment(LAST_ORDERS)).select(
        "item_id", *[F.col(f"unique_users_{n}d").alias(f"exact_{n}d") for n in features.TREND_WINDOWS])
    columns = []
    for n in features.TREND_WINDOWS:
        columns += [f"avg_rating_{n}d", f"review_count_{n}d", f"avg_price_{n}d",
                    sketches.near(F.col(f"unique_users_{n}d"), F.col(f"exact_{n}d")).alias(f"users_near_{n}d")]
    return rounded(made.join(exact, "item_id").select("item_id", *columns),
                   lift=HALF, avg_price_7d=4, avg_price_30d=4, avg_price_90d=4)


@query("A9", f"""
WITH {INTERACTIONS}
SELECT count(*) AS interaction_count, round(avg(rating), 6) AS avg_rating, TRUE AS users_near FROM interactions""")
def overview_from_days(t: Tables) -> DataFrame:
    """Totals of all stored days; users are merged from the items of every day."""
    exact = t.interactions(catalog=False).agg(F.countDistinct("user_id")).first()[0]
    told = sketches.overview_from_days(_stored_days(t, "1900-01-01"))
    return rounded(told.select("interaction_count", "avg_rating", sketches.near(F.col("user_count"), F.lit(exact)).alias("users_near")))


NEEDLES = ["  The Ou ", "e", "th", "BRAND#1", "on that ", "qq", "#", "zzzz", "small"]  # some are in no text


@query("P1", f"""
WITH needles AS (SELECT unnest({[n.strip().lower() for n in NEEDLES]}) AS needle),
items AS (
  SELECT p_partkey AS item_id, lower(coalesce(p_name, '')) AS title, lower(coalesce(text, '')) AS description,
         lower(coalesce(p_brand, '')) AS brand, lower(coalesce(p_type, '')) AS category
  FROM part LEFT JOIN documents ON doc_id = p_partkey)
SELECT needle, item_id FROM needles JOIN items
  ON contains(title, needle) OR contains(description, needle) OR contains(brand, needle) OR contains(category, needle)""")
def indexed_search(t: Tables) -> DataFrame:
    """Items whose texts hold each of several needles, found in a stored index. Descriptions are whole documents."""
    described = t.catalog().join(t.read("documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("description")), "item_id", "left")
    folder = scratch_path(t.spark, "text-index")
    text_index.build_index(described, "item_id", COLUMNS, folder)
    found = None
    for needle in NEEDLES:
        one = text_index.search_index(t.spark, folder, "item_id", COLUMNS, needle).select(
            F.lit(needle.strip().lower()).alias("needle"), "item_id")
        found = one if found is None else found.unionByName(one)
    return found


@query("R1 R3 T4", f"""
WITH {INTERACTIONS},
scored AS (SELECT user_id, item_id, avg(rating) AS score FROM interactions GROUP BY ALL),
ranked AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) <= 3)
SELECT user_id, item_id, round(score, 6) AS score FROM ranked WHERE user_id % 3 = 1 AND user_id % 5 <> 0""")
def looked_up_lists(t: Tables) -> DataFrame:
    """Lists from a lookup table: a third of users is stored in time, another has expired, and of all every fifth was
    invalidated; those of a third come in the future."""
    best = F.row_number().over(_by_score())
    lists = features.user_item_ratings(t.interactions(catalog=False)).withColumnRenamed("rating", "score").withColumn(
        "rank", best).where("rank <= 3").drop("rank")
    stored = F.when(F.col("user_id") % 3 == 0, moment("2001-08-30 12:00:00")).when(
        F.col("user_id") % 3 == 1, moment("2001-08-31 23:30:00")).otherwise(moment("2001-09-01 05:00:00"))
    store = LookupStore(t.spark, scratch_path(t.spark, "lookup"), f"lists_{uuid.uuid4().hex}")
    store.put("lists", results.stamped(lists, "recommendations", stored), "user_id")
    store.invalidate("lists", lists.where("user_id % 5 = 0").select("user_id"), "user_id", moment("2001-08-31 23:45:00"))
    return rounded(store.get("lists", "user_id", moment("2001-09-01 00:15:00")).select("user_id", "item_id", "score"))


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy(F.round("score", 9).desc(), "item_id")


@query("R4 R1", f"""
WITH {INTERACTIONS},
active AS (SELECT user_id FROM interactions GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 100),
top AS (SELECT item_id, row_number() OVER (ORDER BY round(avg(rating) * ln(1 + count(*)), 9) DESC, item_id)::INTEGER AS rank
        FROM interactions GROUP BY 1 QUALIFY rank <= 10)
SELECT user_id, item_id, rank, 3600 AS ttl_seconds FROM active, top""")
def warmed_lists(t: Tables) -> DataFrame:
    """Recommendation lists of the most active users, stored before anybody asks; those of other users are not."""
    interactions = t.interactions(catalog=False)
    top = popularity_ranking(interactions, 10).select("item_id", "rank")
    users = interactions.groupBy("user_id").agg(F.count("*").alias("n"))
    lists = users.select("user_id", F.lit(0).alias("_k")).join(top.withColumn("_k", F.lit(0)), "_k").drop("_k")
    active = users.orderBy(F.desc("n"), "user_id").limit(100)
    store = LookupStore(t.spark, scratch_path(t.spark, "lookup"), f"warm_{uuid.uuid4().hex}")
    store.put("lists", results.stamped(results.warm(lists, active, "user_id"), "recommendations",
                                       moment("2001-09-01 00:00:00")), "user_id")
    return store.get("lists", "user_id", moment("2001-09-01 00:20:00")).select("user_id", "item_id", "rank", "ttl_seconds")


@query("S11 S12", """
SELECT count(*) AS row_count, count(p_name) AS filled_title, count(CASE WHEN p_size > 25 THEN 1 END) AS filled_brand,
       count(url) AS with_images, count(*) - count(url) AS without_images,
       count(CASE WHEN url <> '' THEN 1 END) AS non_empty_urls,
       count(CASE WHEN regexp_matches(url, '^https?://') THEN 1 END) AS web_urls, max(p_retailprice) AS dearest
FROM part LEFT JOIN pages ON page_id = p_partkey""")
def observed_catalog_load(t: Tables) -> DataFrame:
    """Checks of a load, counted by the job that writes it. Some brands are unknown."""
    sizes = t.read("part").select(F.col("p_partkey").alias("item_id"), "p_size")
    rows = t.items_with_images().join(sizes, "item_id").withColumn("brand", F.when(F.col("p_size") > 25, F.col("brand")))
    told = checks.observed_load(rows.drop("p_size"), scratch_path(t.spark, "load"), images="valid_image_urls", dearest=F.max("price"))
    names = ["row_count", "filled_title", "filled_brand", "with_images", "without_images", "non_empty_urls", "web_urls"]
    return t.spark.createDataFrame(
        [(*[int(told[n]) for n in names], float(told["dearest"]))], ", ".join(f"{n} long" for n in names) + ", dearest double")


@query("S3 S6 A17", """
SELECT event_type, count(*) AS events,
       sum(CASE WHEN event_id % 11 <> 3 THEN json_extract_string(props, '$.k')::BIGINT END)::BIGINT AS k_sum,
       count(CASE WHEN event_id % 11 <> 3 AND json_extract_string(props, '$.k')::INTEGER < 80 THEN 1 END) AS hits,
       count(CASE WHEN event_id % 11 = 3 THEN 1 END) AS malformed
FROM events GROUP BY 1""")
def variant_events(t: Tables) -> DataFrame:
    """Properties of events parsed once into variants; those cut off in the middle are counted apart."""
    cut = F.expr("substring(props, 1, length(props) - 1)")
    rows = t.events().select("event_id", "event_type", F.when(F.col("event_id") % 11 == 3, cut).otherwise(F.col("props")).alias("props"))
    good, bad = documents.parsed(rows, "props", "facts")
    k = F.variant_get("facts", "$.k", "int")
    told = good.groupBy("event_type").agg(F.count("*").alias("good"), F.sum(k).alias("k_sum"), F.count_if(k < 80).alias("hits"))
    kept = bad.groupBy("event_type").agg(F.count("*").alias("malformed"))
    return told.join(kept, "event_type", "full").select(
        "event_type", (F.coalesce("good", F.lit(0)) + F.coalesce("malformed", F.lit(0))).alias("events"), "k_sum",
        F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("malformed", F.lit(0)).alias("malformed"))
