from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketry.operators import asof, features
from basketry.plans.registry import moment

INTERACTIONS = "user_id string, item_id string, rating double, ts timestamp_ntz, price double, category string"


def at(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def interactions(spark):
    return spark.createDataFrame([
        ("one", "a", 4.0, at("2024-01-10 08:00:00"), 10.0, "Books"),
        ("tie", "a", 2.0, at("2024-01-01 23:00:00"), 5.0, "Toys"),
        ("tie", "b", 4.0, at("2024-01-02 01:00:00"), 5.0, "Books"),
        ("two", "b", 5.0, at("2024-01-01 10:00:00"), 100.0, "Toys"),
        ("two", "b", 3.0, at("2024-01-03 09:00:00"), 200.0, "Toys"),
        ("two", "c", 1.0, at("2024-01-08 10:00:00"), 300.0, "Books"),
    ], INTERACTIONS)


def by_user(df):
    return {r["user_id"]: r for r in df.collect()}


def test_user_features(interactions):
    rows = by_user(features.user_features(interactions, moment("2024-01-20 00:00:00")))
    assert rows["one"]["price_sensitivity"] is None  # one price has no spread
    assert rows["one"]["activity_level"] == 1.0
    assert rows["one"]["account_age_days"] == 9
    assert rows["tie"]["favorite_category"] == "Books"  # equal counts: first by name
    assert rows["tie"]["price_sensitivity"] == 1.0  # equal prices
    assert rows["two"]["favorite_category"] == "Toys"
    assert rows["two"]["price_sensitivity"] == pytest.approx(1 / 101)
    assert rows["two"]["activity_level"] == pytest.approx(3 / 8)
    assert rows["two"]["last_purchase_days_ago"] == 11


def test_spread_put_together_from_categories(interactions):
    direct = by_user(features.user_stats(interactions))
    joined = by_user(features.user_features(interactions, moment("2024-01-20 00:00:00")))
    for user, row in direct.items():
        expected = None if row["std_price"] is None else 1 / (row["std_price"] + 1)
        assert joined[user]["price_sensitivity"] == (expected and pytest.approx(expected))


def test_item_features_of_unrated_items_are_zero(spark, interactions):
    items = spark.createDataFrame(
        [("a", "Books", "X", 1.0, "in_stock", 0.0), ("z", "Toys", "Y", 2.0, "out_of_stock", 5.0)],
        "item_id string, category string, brand string, price double, availability string, "
        "discount_percentage double")
    rows = {r["item_id"]: r for r in features.item_features(
        items, interactions, moment("2024-01-20 00:00:00")).collect()}
    assert (rows["z"]["avg_rating"], rows["z"]["review_count"], rows["z"]["popularity_score"]) == (0, 0, 0)
    assert rows["a"]["review_count"] == 2 and rows["a"]["unique_users"] == 2


def test_behavior_takes_the_smallest_mode(interactions):
    rows = by_user(features.user_behavior(interactions, moment("2024-01-20 00:00:00")))
    assert rows["tie"]["preferred_hour"] == 1
    assert rows["tie"]["preferred_day"] == 0  # Monday and Tuesday once each
    assert rows["two"]["preferred_hour"] == 10
    assert rows["two"]["category_diversity"] == 2


def test_trends_keep_items_idle_in_the_short_window(interactions):
    rows = {r["item_id"]: r for r in features.item_trends(
        interactions, moment("2024-01-15 00:00:00")).collect()}
    assert rows["b"]["review_count_7d"] == 0 and rows["b"]["avg_rating_7d"] is None
    assert rows["b"]["review_count_30d"] == 3 and rows["b"]["unique_users_30d"] == 2
    # the edge of the window belongs to it
    edge = features.item_trends(interactions, moment("2024-01-15 10:00:00"))
    assert {r["item_id"]: r["review_count_7d"] for r in edge.collect()}["c"] == 1


def test_matrix_has_zero_for_unseen(interactions):
    rows = by_user(features.user_item_matrix(interactions, ["a", "b"]))
    assert rows["one"].asDict() == {"user_id": "one", "a": 4.0, "b": 0.0}
    assert rows["two"]["b"] == 4.0


ROWS = "id string, event_timestamp timestamp_ntz, created_timestamp timestamp_ntz, value int"


def brute_asof(entities, rows, ttl):
    out = []
    for key, when, label in entities:
        fit = [r for r in rows if r[0] == key and when - timedelta(days=ttl) <= r[1] <= when]
        best = max(fit, key=lambda r: (r[1], r[2]), default=None)
        out.append((label, best and best[3]))
    return sorted(out)


@pytest.mark.parametrize("bucket_days", [1, 3, 7, 400])
def test_asof_edges_and_ties(spark, bucket_days):
    t0 = at("2024-03-01 12:00:00")
    rows = [
        ("u", t0, t0, 1),
        ("u", t0, t0 + timedelta(hours=1), 2),  # same time, created later
        ("u", t0 + timedelta(days=9), t0, 3),
        ("v", t0 - timedelta(days=2), t0, 4),
    ]
    entities = [
        ("u", t0, "at the row's time"),
        ("u", t0 - timedelta(seconds=1), "just before"),
        ("u", t0 + timedelta(days=7), "exactly at the limit"),
        ("u", t0 + timedelta(days=7, seconds=1), "just past the limit"),
        ("u", t0 + timedelta(days=9), "next row"),
        ("v", t0, "other key"), ("v", t0, "same question twice"), ("w", t0, "unknown key"),
    ]
    found = asof.historical_features(
        spark.createDataFrame(entities, "id string, event_timestamp timestamp_ntz, label string"),
        spark.createDataFrame(rows, ROWS), "id", ["value"], 7, bucket_days)
    got = sorted((r["label"], r["value"]) for r in found.collect())
    assert got == brute_asof(entities, rows, 7)


def test_asof_random(spark):
    import random

    pick = random.Random(5)
    t0 = at("2024-01-01 00:00:00")
    rows = [(pick.choice("ab"), t0 + timedelta(hours=pick.randrange(2000)), t0, i) for i in range(120)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    entities = [(pick.choice("abc"), t0 + timedelta(hours=pick.randrange(2000)), str(i)) for i in range(200)]
    found = asof.historical_features(
        spark.createDataFrame(entities, "id string, event_timestamp timestamp_ntz, label string"),
        spark.createDataFrame(rows, ROWS), "id", ["value"], 2, 5)
    assert sorted((r["label"], r["value"]) for r in found.collect()) == brute_asof(entities, rows, 2)


def test_latest_and_retention(spark):
    t0 = at("2024-03-01 12:00:00")
    rows = spark.createDataFrame([
        ("u", t0, t0, 1), ("u", t0, t0 + timedelta(hours=1), 2), ("u", t0 - timedelta(days=90), t0, 0),
        ("u", t0 + timedelta(days=1), t0, 3)], ROWS)
    assert asof.latest_features(rows, "id").first()["value"] == 3
    assert asof.latest_features(rows, "id", F.lit(t0).cast("timestamp_ntz")).first()["value"] == 2
    kept = asof.expire_features(rows, F.lit(t0).cast("timestamp_ntz"), 90)
    assert sorted(r["value"] for r in kept.collect()) == [0, 1, 2, 3]
    kept = asof.expire_features(rows, F.lit(t0 + timedelta(seconds=1)).cast("timestamp_ntz"), 90)
    assert sorted(r["value"] for r in kept.collect()) == [1, 2, 3]


def test_missing_categories_never_win(spark):
    rows = spark.createDataFrame(
        [("u", None), ("u", None), ("u", "A"), ("v", None)], "user_id string, category string").withColumn(
        "item_id", F.lit("i")).withColumn("rating", F.lit(3.0)).withColumn("price", F.lit(1.0)).withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.user_id: r.favorite_category for r in features.favorite_category(rows).collect()}
    assert got == {"u": "A", "v": "unknown"}
    view = features.user_features(rows, F.lit("2024-02-01").cast("timestamp_ntz"))
    assert {r.user_id: r.favorite_category for r in view.collect()} == got


def test_null_keys_and_heavy_buckets(spark):
    at = F.col("at").cast("timestamp_ntz").alias("event_timestamp")
    feats = spark.createDataFrame([(None, "2024-01-01", 9), ("k", "2024-01-02", 1), ("k", "2024-01-05", 2)], "id string, at string, v int")
    feats = feats.select("id", at, F.col("at").cast("timestamp_ntz").alias("created_timestamp"), "v")
    asked = spark.createDataFrame([(None, "2024-01-03", 0)] + [("k", f"2024-01-0{1 + i % 9}", i) for i in range(90)],
                                  "id string, at string, n int").select("id", at, "n")
    one, cut = (sorted(((r.n, r.id, r.v) for r in asof.historical_features(asked, feats, "id", ["v"], 30, heavy=h).collect()), key=str)
                for h in (1_000_000, 5))
    assert one == cut and len(one) == 91 and (0, None, None) in one
