from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketry.operators import kpi
from basketry.plans.registry import moment
from basketry.schemas import EVENTS
from basketry.sources import results
from basketry.streaming import jobs

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    full = [(i, ts, user, kind, value, None) for i, (ts, user, kind, value) in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


def minutes(m):
    return T0 + timedelta(minutes=m)


def test_kpis_without_views_are_zero(spark):
    row = kpi.business_kpis(events(spark, [(T0, 1, "purchase", 5.0), (T0, 2, "error", 1.0)])).first()
    assert row["ctr"] == 0 and row["conversion_rate"] == 0 and row["retention_rate"] == 50.0


def test_trend_has_idle_days(spark):
    rows = kpi.daily_trend(events(spark, [
        (T0, 1, "view", 1.0), (T0 + timedelta(days=3), 1, "click", 1.0)]), days=5).orderBy("day").collect()
    assert [r["activity"] for r in rows] == [0, 1, 0, 0, 1]


def test_hit_rate_of_nothing_is_zero(spark):
    none = spark.createDataFrame([], "cached boolean")
    assert kpi.hit_rate(none).first()["hit_rate"] == 0.0


@pytest.mark.parametrize("offset", [0, 13, 29])
def test_sessions_at_the_gap(spark, offset):
    at = [0, 29, 58, 88, 100, 200]  # 88 - 58 is exactly the gap, so a new session
    found = kpi.sessions(events(spark, [(minutes(offset + m), 1, "view", 1.0) for m in at]))
    rows = found.orderBy("session_start").collect()
    assert [r["event_count"] for r in rows] == [3, 2, 1]
    assert rows[0]["duration_seconds"] == 58 * 60
    total = kpi.session_metrics(found).first()
    assert total["session_count"] == 3 and total["bounce_rate"] == pytest.approx(1 / 3)


def test_sessions_equal_the_built_in_window(spark):
    import random

    pick = random.Random(9)
    rows = [(minutes(pick.random() * 3000), pick.randrange(4), "view", 1.0) for _ in range(300)]
    df = events(spark, rows)
    mine = sorted((r["user_id"], r["session_start"], r["event_count"]) for r in kpi.sessions(df).collect())
    built_in = df.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    assert mine == sorted((r["user_id"], r["w"]["start"], r["n"]) for r in built_in.collect())


def test_time_to_live_edge(spark):
    rows = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(seconds=1))], "id string, at timestamp_ntz")
    stored = results.stamped(rows, "recommendations", F.col("at"))
    valid = results.still_valid(stored, F.lit(T0 + timedelta(seconds=3600)).cast("timestamp_ntz"))
    assert [r["id"] for r in valid.collect()] == ["b"]  # exactly at its limit, a row has expired


def test_store_replaces_and_drops(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("u1", "m1", 1), ("u2", "m1", 2), ("u1", "m2", 3)], "user_id string, model string, x int")
    store.write("recs", rows, "model")
    store.write("recs", rows.where("model = 'm2'").withColumn("x", F.lit(9)), "model")
    assert sorted(r["x"] for r in store.read("recs").collect()) == [1, 2, 9]
    store.drop_rows("recs", "model", spark.createDataFrame([("u1",)], "user_id string"), "user_id")
    assert [(r["user_id"], r["model"]) for r in store.read("recs").collect()] == [("u2", "m1")]
    store.drop_partition("recs", "model", "m1")
    store.append("recs", rows, "model")
    assert store.read("recs").count() == 3


def test_ingest_appends_and_refreshes(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path))
    schema = "user_id string, event_timestamp timestamp_ntz, created_timestamp timestamp_ntz, x int"
    old = spark.createDataFrame([("a", T0, T0, 1), ("b", T0, T0, 2)], schema)
    new = spark.createDataFrame([("a", T0 + timedelta(days=1), T0, 3)], schema)
    results.ingest_features(store, "users", "user_id", old)
    latest = results.ingest_features(store, "users", "user_id", new)
    assert {r["user_id"]: r["x"] for r in latest.collect()} == {"a": 3, "b": 2}
    assert store.read("users_history").count() == 3
    results.retire_features(store, "users", "2024-01-02")
    assert [r["x"] for r in store.read("users_history").collect()] == [3]


def test_warm_keeps_wanted(spark):
    features = spark.createDataFrame([("a", 1), ("b", 2)], "item_id string, x int")
    wanted = spark.createDataFrame([("a",), ("a",), ("z",)], "item_id string")
    assert [r["x"] for r in results.warm(features, wanted, "item_id").collect()] == [1]


def batches(spark, folder, *groups):
    for i, rows in enumerate(groups):
        events(spark, rows).coalesce(1).write.parquet(f"{folder}/part{i}")
    return f"{folder}/part*"


def test_late_rows_are_left_out(spark, tmp_path):
    path = batches(
        spark, tmp_path / "in",
        [(minutes(0), 1, "click", 1.0), (T0 + timedelta(days=1, hours=3), 1, "click", 1.0)],
        [(T0 + timedelta(days=1, hours=4), 1, "click", 1.0)],
        [(minutes(5), 1, "click", 1.0), (T0 + timedelta(days=3), 1, "click", 1.0)])
    stream = jobs.event_stream(spark, path, files_per_trigger=1)
    tagged = stream.select("ts", F.lit("t").alias("test_id"), F.lit("test").alias("group"),
                           F.create_map(F.lit("ctr"), F.lit(1.0)).alias("metrics"))
    jobs.run_to_files(jobs.windowed_metrics(tagged), f"{tmp_path}/out", f"{tmp_path}/state")
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    # day one closed with the second file, so its late row no longer counts
    assert [(r["window_start"].day, r["n"]) for r in rows] == [(1, 1), (2, 2)]


def test_activity_over_several_batches_equals_batch(spark, tmp_path):
    rows = [(minutes(i * 700), i % 3, "view", 1.0) for i in range(30)]
    path = batches(spark, tmp_path / "in", rows[:10], rows[10:20], rows[20:])
    stream = jobs.activity_per_user(jobs.event_stream(spark, path, files_per_trigger=1))
    jobs.run_updates_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    latest = jobs.latest_of_batches(spark, f"{tmp_path}/out", "user_id")
    got = {r["user_id"]: (r["event_count"], r["last_ts"]) for r in latest.collect()}
    expected = {u: (10, max(t for t, user, *_ in rows if user == u)) for u in range(3)}
    assert {u: (n, t.replace(tzinfo=None)) for u, (n, t) in got.items()} == expected


def test_pushed_twice_counts_once(spark, tmp_path):
    rows = [(minutes(i), 1, "view", float(i)) for i in range(5)]
    path = batches(spark, tmp_path / "in", rows, rows)
    stream = jobs.event_stream(spark, path, files_per_trigger=1).select(
        "user_id", F.col("ts").alias("event_timestamp"), F.col("ts").alias("created_timestamp"), "value")
    jobs.push_features(stream, "user_id", f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    assert jobs.latest_pushed(spark, f"{tmp_path}/out", "user_id").first()["value"] == 4.0


def test_every_type_and_late_updates_reach_the_latest_table(spark, tmp_path):
    path = batches(
        spark, tmp_path / "in",
        [(minutes(0), 1, "view", 1.0), (minutes(9), 1, "click", 2.0), (T0 + timedelta(days=3), 2, "view", 3.0)],
        [(minutes(5), 3, "purchase", 4.0), (minutes(4), 1, "view", 5.0)],
        [(minutes(5), 3, "purchase", 4.0), (minutes(10), 1, "view", 6.0)])
    stream = jobs.event_stream(spark, path, files_per_trigger=1).select(
        "user_id", F.col("ts").alias("event_timestamp"), "value")
    jobs.upsert_latest(stream, "user_id", f"{tmp_path}/out", f"{tmp_path}/state")
    rows = jobs.latest_upserted(spark, f"{tmp_path}/out").collect()
    assert sorted((r["user_id"], r["value"]) for r in rows) == [(1, 6.0), (2, 3.0), (3, 4.0)]


def test_replay_to_the_end_gives_open_sessions(spark, tmp_path):
    path = batches(spark, tmp_path / "in", [(minutes(0), 1, "view", 1.0), (minutes(300), 1, "view", 1.0),
                                            (minutes(310), 1, "view", 1.0)])
    jobs.run_to_end(spark, path, jobs.session_stream, f"{tmp_path}/out", f"{tmp_path}/state")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["event_count"] for r in rows) == [1, 2]


def test_scratch_follows_the_named_folder(spark):
    from basketry.session import scratch_path

    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert moment("2024-01-01 00:00:00") is not None


def test_ingest_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "user_id int, event_timestamp timestamp_ntz, created_timestamp timestamp_ntz, x double"
    start = datetime(2024, 1, 1)
    store = results.ResultStore(spark, str(tmp_path))
    many = spark.createDataFrame([(u, start, start, float(u)) for u in range(200)], schema)
    results.ingest_features(store, "users", "user_id", many)
    files = {p for p in tmp_path.glob("users_latest/bucket=*/*.parquet")}
    later = start + timedelta(days=1)
    latest = results.ingest_features(store, "users", "user_id", spark.createDataFrame([(7, later, later, -1.0)], schema))
    assert len(files - {p for p in tmp_path.glob("users_latest/bucket=*/*.parquet")}) == 1
    assert {(r.user_id, r.x) for r in latest.collect()} == {(u, -1.0 if u == 7 else float(u)) for u in range(200)}
