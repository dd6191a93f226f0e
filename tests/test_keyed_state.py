from datetime import datetime, timedelta

from basketry.streaming import keyed_state as ks
from basketry.streaming.keyed_state import PROVIDER

UPDATES = "user_id string, event_timestamp timestamp, level double, note string"


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def at(hour, minute=0):
    return datetime(2024, 1, 1, hour, minute)


def test_newest_rows_survive_a_restart(spark, tmp_path):
    """Late and repeated updates change nothing, ties go to the higher row, and a second run goes on from the first."""
    log, state = f"{tmp_path}/log", f"{tmp_path}/state"

    def run():
        ks.run_state(ks.newest_rows(spark.readStream.schema(UPDATES).parquet(log), "user_id"), state)
        return {r.user_id: (r.event_timestamp, r.level, r.note) for r in ks.state_table(spark, state, "newest").collect()}
    feed(spark, log, [("a", at(3), 1.0, "x"), ("a", at(2), 9.0, "x"), ("b", at(5), None, "x"), (None, at(1), 2.0, None)], UPDATES)
    assert run() == {"a": (at(3), 1.0, "x"), "b": (at(5), None, "x"), None: (at(1), 2.0, None)}
    before = spark.conf.get(PROVIDER[0], None)
    feed(spark, log, [("a", at(3), 1.0, "x"), ("a", at(1), 5.0, "y"), ("b", at(5), 0.5, "w"), ("c", at(4), 7.0, None)], UPDATES)
    assert run() == {"a": (at(3), 1.0, "x"), "b": (at(5), 0.5, "w"), "c": (at(4), 7.0, None), None: (at(1), 2.0, None)}
    assert run()["c"] == (at(4), 7.0, None)  # nothing new
    assert spark.conf.get(PROVIDER[0], None) == before


def test_keys_without_updates_expire(spark, tmp_path):
    """A key lives as long as its last update, as the watermark tells the time."""
    log, state = f"{tmp_path}/log", f"{tmp_path}/state"

    def run():
        updates = spark.readStream.schema(UPDATES).parquet(log)
        ks.run_state(ks.newest_rows(updates, "user_id", ttl=timedelta(hours=2)), state)
        return {(r.user_id, r.event_timestamp) for r in ks.state_table(spark, state, "newest").collect()}
    feed(spark, log, [("a", at(3), 1.0, "x"), ("b", at(3), 1.0, "x"), ("c", None, 1.0, "x")], UPDATES)
    assert run() == {("a", at(3)), ("b", at(3))}
    feed(spark, log, [("b", at(4), 1.0, "x"), ("c", at(6, 30), 1.0, "x")], UPDATES)  # the watermark becomes 5:30
    assert run() == {("b", at(4)), ("c", at(6, 30))}
    feed(spark, log, [("d", at(5, 45), 1.0, "x")], UPDATES)
    assert run() == {("b", at(4)), ("c", at(6, 30)), ("d", at(5, 45))}


def test_activity_is_kept_and_given_out_when_idle(spark, tmp_path):
    log, state, out = f"{tmp_path}/log", f"{tmp_path}/state", f"{tmp_path}/out"
    schema = "user_id string, ts timestamp"

    def run():
        events = spark.readStream.schema(schema).parquet(log)
        ks.run_state(ks.activity_rows(events, idle=timedelta(hours=6)), state, out)
        kept = {(r.user_id, r.event_count, r.first_ts, r.last_ts) for r in ks.state_table(spark, state, "activity").collect()}
        return kept, {tuple(r)[:4] for r in spark.read.parquet(out).collect()}
    feed(spark, log, [("a", at(1)), ("a", at(2)), ("b", at(1)), ("c", at(8, 30)), (None, at(9)), ("d", None)], schema)
    # the watermark is 7:30: b's six hours are over, those of a are not
    assert run() == ({("a", 2, at(1), at(2)), ("c", 1, at(8, 30), at(8, 30))}, {("b", 1, at(1), at(1))})
    feed(spark, log, [("a", at(7, 45)), ("a", at(7, 45)), ("b", at(9)), ("c", at(9, 30))], schema)
    # a came back in time and starts its six hours again; b counts anew
    assert run() == ({("a", 4, at(1), at(7, 45)), ("b", 1, at(9), at(9)), ("c", 2, at(8, 30), at(9, 30))}, {("b", 1, at(1), at(1))})
    feed(spark, log, [("e", at(20))], schema)
    kept, gone = run()
    assert {k[0] for k in kept} == {"e"} and ("a", 4, at(1), at(7, 45)) in gone and ("b", 1, at(9), at(9)) in gone and len(gone) == 4
