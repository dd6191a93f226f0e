r"""Conversations rebuilt from event logs and rendered as training text.

An event is a row (conv_id, seq, target, kind, role, text):

* ``message`` opens the message ``target`` (its place in the conversation);
* ``delta`` adds its text to the message, as streaming does;
* ``edit`` replaces the text of the message;
* ``regenerate`` empties the message, and whatever was opened between it and
  this event is gone;
* ``delete`` takes the message away.

Everything runs as DataFrame functions. Events are folded by message first, so
the many deltas of a busy conversation are spread over tasks; only its
finished messages meet, in the one row that holds its text.

Rendered form: ``### role: text</turn>\n`` for every message. In texts a
backslash becomes ``\\``, ``</turn>`` becomes ``\e`` and ``### `` becomes ``\h``;
in roles also ``:`` becomes ``\c``. So neither mark can occur inside a text, and
``parse`` gives back exactly what went in.

Edge cases: a null text is empty, a null role is the empty role, rows with a null
conversation id form one conversation, null places come first. Several openings
of one place are all kept, ordered by role and text, and later deltas go to the
last of them; an event for a place nobody opened does nothing, and so does one
of an unknown kind. Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
HEAD = "### "
OPENINGS = ("message",)
RESETS = ("edit", "regenerate")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(END), F.lit("\\e"))
    out = F.replace(out, F.lit(HEAD), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Undo ``escape``. Doubled backslashes part the text first, so that what is
    left between them holds only whole codes."""
    def codes(part: Column) -> Column:
        out = F.replace(part, F.lit("\\c"), F.lit(":"))
        out = F.replace(out, F.lit("\\h"), F.lit(HEAD))
        return F.replace(out, F.lit("\\e"), F.lit(END))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), codes), "\\")


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id and ``turns``: array of (role, text) in order, after all events."""
    events = events.select(
        "conv_id", "seq", "target", "kind",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    event = F.struct("seq", (F.col("kind") != "message").alias("later"), "kind", "role", "text")
    folded = events.groupBy("conv_id", "target").agg(
        F.sort_array(F.collect_list(event)).alias("events"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("cut"),
        F.min(F.when(F.col("kind") == "message", F.col("seq"))).alias("opened"))

    def of(kind: str) -> Column:
        return F.filter("events", lambda e: e["kind"] == kind)

    # What the last edit or regeneration left, then the deltas after it.
    # (position counted from 1; 0 if there is none)
    places = F.sequence(F.lit(1), F.size("events"))
    last_reset = F.coalesce(F.array_max(F.filter(
        places, lambda i: F.element_at("events", i)["kind"].isin(*RESETS))), F.lit(0))
    folded = folded.filter(F.size(of("message")) > 0).withColumn("last_reset", last_reset)
    tail = F.filter(F.slice("events", F.col("last_reset") + 1, F.size("events")),
                    lambda e: e["kind"] == "delta")
    added = F.array_join(F.transform(tail, lambda e: e["text"]), "")
    reset = F.try_element_at("events", F.nullif(F.col("last_reset"), F.lit(0)))
    base = (F.when(F.col("last_reset") == 0, F.element_at(of("message"), -1)["text"])
            .when(reset["kind"] == "edit", reset["text"]).otherwise(F.lit("")))
    last = F.struct(F.element_at(of("message"), -1)["role"].alias("role"),
                    F.concat(base, added).alias("text"))
    first = F.transform(F.slice(of("message"), 1, F.greatest(F.size(of("message")) - 1, F.lit(0))),
                        lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text")))
    deleted = F.size(of("delete")) > 0
    messages = folded.select(
        "conv_id", "target", "opened", "cut", deleted.alias("deleted"),
        F.concat(first, F.array(last)).alias("texts"))
    # gone: opened after an earlier message and before that one's regeneration
    earlier = (Window.partitionBy("conv_id").orderBy("target")
               .rowsBetween(Window.unboundedPreceding, -1))
    messages = messages.withColumn("cut_before", F.max("cut").over(earlier))
    kept = messages.filter(~F.col("deleted") & F.coalesce(
        F.col("cut_before") < F.col("opened"), F.lit(True)))
    ordered = F.sort_array(F.collect_list(F.struct("target", "texts")))
    return kept.groupBy("conv_id").agg(
        F.flatten(F.transform(ordered, lambda m: m["texts"])).alias("turns"))


def render(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, ``formatted`` and ``mask``: the same text as consecutive pieces
    (text, loss); the pieces under the loss are the texts of role ``trained``."""
    def pieces(turn: Column) -> Column:
        loss = turn["role"] == trained
        return F.array(
            F.struct(F.concat(F.lit(HEAD), escape(turn["role"], role=True), F.lit(": ")).alias("text"),
                     F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), loss.alias("loss")),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
    mask = conversations.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("mask"))
    return mask.select(
        "conv_id", F.array_join(F.transform("mask", lambda p: p["text"]), "").alias("formatted"), "mask")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text)."""
    ends = F.split(formatted, END + "\n", -1)
    bodies = F.slice(ends, 1, F.size(ends) - 1)

    def turn(body: Column) -> Column:
        colon = F.locate(": ", body)
        return F.struct(
            unescape(F.substring(body, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(body, colon + 2, F.length(body))).alias("text"))
    return F.transform(bodies, turn)


def trained_texts(mask: Column) -> Column:
    """The unescaped texts under the loss, in order."""
    return F.transform(F.filter(mask, lambda p: p["loss"]), lambda p: unescape(p["text"]))
