"""Stored indexes and summaries: text index, lookup tables, sketches, observed loads, variants."""

import contextlib
import io
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import features, sketches, text_index
from basketry.operators.catalog import matches_text
from basketry.plans.registry import moment
from basketry.sources import checks, documents
from basketry.sources.lookup import LookupStore
from basketry.sources.results import ResultStore

TEXTS = ["title", "description"]


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = [(1, "Red Shoe", "a shoe, red\nand light"), (2, None, "RED"), (3, "", None), (4, "sh", "oe"), (5, "50% off_[x]", "é́ \U0001f600\U0001f600!"),
            (6, "aaa", "aaaa"), (7, "İstanbul", "ß"), (8, "long " * 3000 + "needle", "x")]
    items = spark.createDataFrame(rows, "item_id int, title string, description string")
    folder = str(tmp_path_factory.mktemp("index"))
    text_index.build_index(items, "item_id", TEXTS, folder, buckets=8)
    return items, folder


@pytest.mark.parametrize("needle", ["red", " RED ", "e", "sh", "shoe", "shoe, red\nand", "shoeoe", "%", "off_[", "\U0001f600", "\U0001f600!", "é",
                                    "aaa", "aaaa", "aaaaa", "ng lo", "needle", "zzz", "", "  ", "ß", "ista", "x"])
def test_index_finds_what_a_scan_finds(spark, indexed, needle):
    items, folder = indexed
    scan = {r.item_id for r in items.where(matches_text(needle, TEXTS)).collect()}
    found = [r.item_id for r in text_index.search_index(spark, folder, "item_id", TEXTS, needle, buckets=8).collect()]
    assert set(found) == scan and len(found) == len(scan)


def test_search_reads_the_partitions_of_its_runs_only(spark, indexed):
    text = plan(text_index.candidates(spark, indexed[1], "item_id", "needle", buckets=8))
    assert "PartitionFilters: [bucket#" in text and "IN (" in text.split("PartitionFilters")[1].split("\n")[0] + " IN ("
    assert "PushedFilters: [In(gram" in text


def test_lookup_opens_buckets_of_its_keys_and_valid_days(spark, tmp_path):
    store = LookupStore(spark, str(tmp_path), f"t_{uuid.uuid4().hex}", buckets=4)
    start = datetime(2024, 1, 1)
    rows = [(u, u * 10, start + timedelta(hours=h), 7200) for u in range(40) for h in (0, 30)]
    store.put("lists", spark.createDataFrame(rows, "user_id int, score int, cached_at timestamp_ntz, ttl_seconds int"), "user_id")
    at = moment("2024-01-01 01:00:00")
    got = store.get("lists", "user_id", at, [3, 7])
    assert {(r.user_id, r.score) for r in got.collect()} == {(3, 30), (7, 70)}
    # a plan names the buckets it opens only where it keeps them apart, which a plain read has no need for
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        text = plan(store.get("lists", "user_id", at, [3, 7]))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 2 out of 4" in text or "SelectedBucketsCount: 1 out of 4" in text
    assert "expiry_day" in text.split("PartitionFilters")[1].split("\n")[0] and "Exchange" not in text
    assert store.get("lists", "user_id", moment("2024-01-01 02:00:00")).count() == 0  # exactly at the end
    store.invalidate("lists", spark.createDataFrame([(3,), (5,)], "user_id int"), "user_id", moment("2024-01-01 00:30:00"))
    left = store.get("lists", "user_id", at)
    assert {r.user_id for r in left.collect()} == set(range(40)) - {3, 5}
    # joined with another table of the same buckets, the lists are not shuffled
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning" not in plan(store.get("lists", "user_id", at))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # stored again after the invalidation, a key is valid again
    store.put("lists", spark.createDataFrame([(3, 1, datetime(2024, 1, 1, 0, 45), 7200)],
                                             "user_id int, score int, cached_at timestamp_ntz, ttl_seconds int"), "user_id")
    assert {(r.user_id, r.score) for r in store.get("lists", "user_id", at, [3]).collect()} == {(3, 1)}


def interactions(spark, n, seed=1):
    rand = np.random.default_rng(seed)
    start = datetime(2024, 3, 1)
    rows = [(int(rand.integers(4)), None if rand.random() < 0.02 else int(rand.integers(3000)), float(rand.integers(1, 6)), float(rand.integers(100)),
             start + timedelta(days=int(rand.integers(60)))) for _ in range(n)]
    return spark.createDataFrame(rows, "item_id int, user_id long, rating double, price double, ts timestamp_ntz")


def test_days_merge_to_windows(spark, tmp_path):
    """Counts and means are exact, users within their bound, though there are more than a sketch holds one by one."""
    rows = interactions(spark, 20_000)
    store = ResultStore(spark, str(tmp_path))
    sketches.refresh_item_days(store, rows, "2024-03-01", "2024-04-30")
    made = {r.item_id: r for r in sketches.item_trends_from_days(store.read("item_days"), "2024-04-29", (7, 30)).collect()}
    for r in features.item_trends(rows, moment("2024-04-29 00:00:00"), (7, 30)).collect():
        mine = made[r.item_id]
        for n in (7, 30):
            assert mine[f"review_count_{n}d"] == r[f"review_count_{n}d"]
            assert mine[f"avg_rating_{n}d"] == pytest.approx(r[f"avg_rating_{n}d"])
            assert abs(mine[f"unique_users_{n}d"] - r[f"unique_users_{n}d"]) <= sketches.USERS_ERROR * r[f"unique_users_{n}d"]
    total = sketches.overview_from_days(store.read("item_days")).first()
    assert total.interaction_count == 20_000 and abs(total.user_count - 3000) <= sketches.USERS_ERROR * 3000


def test_refresh_reads_and_writes_one_day(spark, tmp_path):
    rows = interactions(spark, 3000)
    rows.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    store = ResultStore(spark, f"{tmp_path}/store")
    sketches.refresh_item_days(store, stored.where("day(ts) <> 5 OR rating > 3"), "2024-03-01", "2024-04-30")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("store/item_days/day=*/*.parquet")}
    sketches.refresh_item_days(store, stored, "2024-04-05", "2024-04-05")
    sketches.refresh_item_days(store, stored, "2024-03-05", "2024-03-05")
    after = {p: p.stat().st_mtime_ns for p in tmp_path.glob("store/item_days/day=*/*.parquet")}
    assert {p.parent.name for p, _ in set(before.items()) ^ set(after.items())} <= {"day=2024-04-05", "day=2024-03-05"}
    got = {(r.item_id, r.day): r.interactions for r in store.read("item_days").collect()}
    want = {(r.item_id, r.day): r["count"] for r in stored.groupBy("item_id", F.to_date("ts").alias("day")).count().collect()}
    assert got == want
    some = stored.where((F.col("ts") >= F.lit("2024-04-05").cast("timestamp_ntz")) & (
        F.col("ts") < F.date_add(F.lit("2024-04-05").cast("date"), 1).cast("timestamp_ntz")))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan(some)


def test_quantiles_of_merged_hours(spark):
    rand = np.random.default_rng(2)
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=int(m)), None if m % 97 == 0 else float(v), True, False)
            for m, v in zip(rand.integers(0, 2880, 30_000), rand.lognormal(3, 1, 30_000))]
    requests = spark.createDataFrame(rows, "ts timestamp_ntz, latency_ms double, cached boolean, failed boolean")
    days = sketches.rolled_up(sketches.service_sketches(requests))
    off = sketches.rank_errors(requests, days).collect()
    assert len(off) == 2 and all(0 <= r[c] <= sketches.RANK_ERROR for r in off for c in ("off_p50", "off_p95", "off_p99"))
    assert sum(r.requests for r in days.collect()) == 30_000
    assert sketches.rolled_up(sketches.service_sketches(requests.limit(0))).count() == 0


def test_observed_load_counts_what_it_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, ["http://x"]), (2, "b", []), (3, "c", None), (4, "d", ["", "https://y"])],
                                 "item_id int, brand string, valid_image_urls array<string>")
    told = checks.observed_load(rows, f"{tmp_path}/load", images="valid_image_urls", last=F.max("item_id"))
    assert told["row_count"] == 4 and told["filled_brand"] == 3 and told["last"] == 4
    own = checks.image_coverage(spark.read.parquet(f"{tmp_path}/load")).first()
    assert (told["with_images"], told["without_images"], told["non_empty_urls"], told["web_urls"]) == tuple(own)[1:]


def test_malformed_documents_are_kept_aside(spark):
    rows = spark.createDataFrame([(1, '{"k": 5, "a": [1, 2]}'), (2, '{"k": '), (3, None), (4, "null"), (5, "7"), (6, "")], "id int, doc string")
    good, bad = documents.parsed(rows, "doc", "v")
    assert {r.id for r in bad.collect()} == {2, 6}
    k = {r.id: r.k for r in good.select("id", F.try_variant_get("v", "$.k", "int").alias("k")).collect()}
    assert k == {1: 5, 3: None, 4: None, 5: None}


def test_index_lists_items_by_run_before_the_shuffle(spark, tmp_path):
    """A run has a row per chunk of items, not one per item."""
    rows = [(i, f"same words {i % 3}", None) for i in range(500)]
    items = spark.createDataFrame(rows, "item_id int, title string, description string").repartition(2)
    text_index.build_index(items, "item_id", TEXTS, str(tmp_path), buckets=4)
    grams = spark.read.parquet(f"{tmp_path}/grams")
    assert grams.count() <= grams.select("gram").distinct().count() * spark.sparkContext.defaultParallelism
    found = text_index.search_index(spark, str(tmp_path), "item_id", TEXTS, "words 1", buckets=4)
    assert sorted(r.item_id for r in found.collect()) == list(range(1, 500, 3))


def test_index_gathers_small_batches(spark, tmp_path):
    """A session whose batches hold few rows lists as many items by run at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        items = spark.createDataFrame([(i, f"same words {i % 3}", None) for i in range(500)], "item_id int, title string, description string")
        text_index.build_index(items, "item_id", TEXTS, str(tmp_path), buckets=4)
    finally:
        spark.conf.set(name, before)
    grams = spark.read.parquet(f"{tmp_path}/grams")
    assert grams.count() <= grams.select("gram").distinct().count() * max(8, spark.sparkContext.defaultParallelism)
    found = text_index.search_index(spark, str(tmp_path), "item_id", TEXTS, "words 1", buckets=4)
    assert sorted(r.item_id for r in found.collect()) == list(range(1, 500, 3))
