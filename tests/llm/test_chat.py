import hashlib

import pytest
from pyspark.sql import functions as F

from basketry.llm import chat

SCHEMA = "conv_id long, seq long, target long, kind string, role string, text string, extra string, turns int"


def rebuilt(spark, rows):
    events = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = chat.render(chat.reconstruct(events)).select(
        "conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.trained_texts(F.col("mask")).alias("loss"),
        "formatted", F.array_join(F.transform("mask", lambda p: p["text"]), "").alias("joined"))
    return {r.conv_id: r for r in out.collect()}


def turns(row):
    return [(t.role, t.text) for t in row.turns]


def test_deltas_edits_regenerations(spark):
    got = rebuilt(spark, [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", None, "he"), (1, 3, 1, "delta", None, "llo"),
        (1, 4, 2, "message", "user", "again"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "new"),
        (1, 7, 3, "message", "user", "more"), (1, 8, 0, "edit", None, "hey"), (1, 9, 4, "message", "tool", "gone"),
        (1, 10, 4, "delete", None, None), (1, 11, 9, "delta", None, "nobody"), (1, 12, 3, "odd", None, "ignored"),
        (2, 0, 5, "message", "user", "b"), (2, 0, 5, "message", "user", "a"), (2, 0, 5, "message", "user", "a"),
        (2, 1, 5, "delta", None, "!"), (None, 0, None, "message", None, None)])
    assert turns(got[1]) == [("user", "hey"), ("assistant", "new"), ("user", "more")]
    assert got[1].loss == ["new"]
    assert turns(got[2]) == [("user", "a"), ("user", "a"), ("user", "b!")]
    assert turns(got[None]) == [("", "")]
    assert all(r.formatted == r.joined for r in got.values())


@pytest.mark.parametrize("text", [
    "", r"\### Assistant: </turn> ok", "\\", "\\\\", "\\e", "\\\\e", "\\h</turn>", "</turn></turn>\n", "### ", "###",
    "a: b", "</tur", "<", "\n### user: x</turn>\n", "äöü 日本語 \U0001f600", "\\c:", "x" * 50_000])
def test_texts_come_back(spark, text):
    row = rebuilt(spark, [(1, 0, 0, "message", text[:200], text), (1, 1, 1, "message", "assistant", text)])[1]
    assert turns(row) == [(text[:200], text), ("assistant", text)] and row.loss == [text]


def test_empty_table(spark):
    assert rebuilt(spark, []) == {}


def test_probe_digest(spark):
    from basketry.llm import queries

    row = queries.QUERIES["op1_chat_format"](spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    text = queries.PROBE_TEXT
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
