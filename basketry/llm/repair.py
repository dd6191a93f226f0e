"""Structure of conversations repaired at the least cost, by dynamic programming over runs.

A well-formed conversation has role initials ``(s?(ua)+)?``. A row's symbol is its role's initial with
its first fault: blank, duplicate (role and text seen earlier) or truncated. Every row is kept (0),
given the role of user or assistant (2) or deleted (3, required for blank and duplicate rows); empty rows of
user or assistant are inserted anywhere (2); a truncated row that stays adds 1. Of the cheapest edits those
with the ASCII-least initials (D, I, K, R) win.

The state is what the last row said: nothing yet, system, user, assistant. A symbol is a 4 x 4 matrix of least
costs, with insertions before the row. Equal consecutive symbols are one run, and a run of n rows is advanced with
the cached binary powers of its matrix (products of sums and minima). From the costs that remain at the end
of each run the choices are then unrolled, row by row, for the audit.

Rows are sorted by a range partitioning of (conversation, turn), so a conversation of any size is spread over
many tasks. What one task has of a conversation is a segment of at most ``SEGMENT`` different rows. Most
conversations are one segment and done at once. Of the others, each segment's matrix goes to a pass that
streams backward through a conversation's segments and hands each the costs that remain after it; then each segment
tells for every state it may begin with where it ends, and a pass forward hands it the state it does begin
with. Only these summaries of a few numbers, never the rows, meet in one task. Texts take no part in any of this: rows are
named by 128 bits of a SHA-256, and texts are joined to the rows that stay.

Edge cases: a null role or text is one space, so it is blank, or has no legal initial. Rows of equal turn (null turns
come first) are ordered by role and hash of the text; fully equal rows count as often as they occur, stand next to each other,
and are held as one row with a count. Null ids are one conversation. Very long texts are hashed and joined, never
gathered. Empty input gives empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import written

SEGMENT = 1 << 16  # different rows of a segment, at most
BLANKS = " \t\n\x0b\x0c\r"
NEVER = 1 << 60
# Costs of edits, and roles that may be given or inserted: fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {2: "user", 3: "assistant"}
INITIALS = "sua?"
NEXT = (2, 2, 3, 2)  # the state that an inserted or re-roled row leads to
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # by initial: the states a kept row leads from and to
GONE = 8  # symbol of rows that must be deleted; others are the initial's place, and 4 more if truncated
END = (0, 4, 2, 0)  # costs that remain after the last row: what is inserted to end well

Vector = tuple[int, ...]


def _moves(symbol: int) -> list[dict[str, tuple[int, int]]]:
    """By state: the edits of a row, each with its cost and the state it leads to."""
    extra = TRUNCATED if symbol != GONE and symbol & 4 else 0
    out = []
    for state in range(4):
        moves = {"D": (DELETE, state)}
        if symbol != GONE:
            if state in KEPT[symbol & 3]:
                moves["K"] = (extra, KEPT[symbol & 3][state])
            moves["R"] = (REROLE + extra, NEXT[state])
        out.append(moves)
    return out


MOVES = {symbol: _moves(symbol) for symbol in [*range(8), GONE]}


def product(a: list[Vector], b: list[Vector]) -> list[Vector]:
    """The min-plus product of two matrices."""
    columns = list(zip(*b))
    return [tuple(min(x + y for x, y in zip(row, column)) for column in columns) for row in a]


def applied(a: list[Vector], v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


def _matrix(symbol: int) -> list[Vector]:
    """Least costs from state to state over one row and the insertions before it."""
    inserted = [[0 if a == b else NEVER for b in range(4)] for a in range(4)]
    for start in range(4):
        state, cost = start, 0
        for _ in range(2):  # more would only come back
            state, cost = NEXT[state], cost + INSERT
            inserted[start][state] = min(inserted[start][state], cost)
    step = [[NEVER] * 4 for _ in range(4)]
    for state, moves in enumerate(MOVES[symbol]):
        for cost, to in moves.values():
            step[state][to] = min(step[state][to], cost)
    return product([tuple(r) for r in inserted], [tuple(r) for r in step])


IDENTITY = [tuple(0 if a == b else NEVER for b in range(4)) for a in range(4)]
POWERS = {symbol: [_matrix(symbol)] for symbol in MOVES}  # of each symbol's matrix: 1, 2, 4, 8 ... rows


def powers(symbol: int, n: int) -> Iterator[list[Vector]]:
    """The cached powers whose product advances ``n`` rows."""
    cached, k = POWERS[symbol], 0
    while n >> k:
        if k == len(cached):
            cached.append(product(cached[-1], cached[-1]))
        if n >> k & 1:
            yield cached[k]
        k += 1


def runs(symbols: list[int], counts: list[int]) -> list[list[int]]:
    """[symbol, rows] of equal consecutive symbols. Of a row that occurs several times all but the first must go."""
    out: list[list[int]] = [[-1, 0]]
    for symbol, n in zip(symbols, counts):
        for s, m in ((symbol, n),) if symbol == GONE else ((symbol, 1), (GONE, n - 1)):
            if s == out[-1][0]:
                out[-1][1] += m
            elif m:
                out.append([s, m])
    return out[1:]


def advanced(collapsed: list[list[int]]) -> list[Vector]:
    """The matrix of all runs."""
    whole = IDENTITY
    for symbol, n in collapsed:
        for power in powers(symbol, n):
            whole = product(whole, power)
    return whole


def unrolled(collapsed: list[list[int]], state: int, after: Vector, last: bool) -> tuple[str, int, int]:
    """(audit, cost, last state) of the cheapest edits from ``state`` on, where ``after`` remains after the runs."""
    ends = []
    for symbol, n in reversed(collapsed):
        ends.append(after)
        for power in powers(symbol, n):
            after = applied(power, after)
    audit, cost, now = [], 0, after
    for (symbol, n), end in zip(collapsed, reversed(ends)):
        if symbol == GONE:  # D is the least initial, and insertions may as well come later
            audit.append("D" * n)
            cost += DELETE * n
            now = end
            continue
        inner = [end]
        for _ in range(n - 1):
            inner.append(applied(POWERS[symbol][0], inner[-1]))
        for left in reversed(inner):
            while True:
                moves, remains = MOVES[symbol][state], now[state]
                edit = next((e for e in ("D", "I", "K", "R") if (
                    INSERT + now[NEXT[state]] == remains if e == "I" else
                    e in moves and moves[e][0] + left[moves[e][1]] == remains)))
                audit.append(edit)
                if edit != "I":
                    break
                state, cost = NEXT[state], cost + INSERT
            cost, state, now = cost + moves[edit][0], moves[edit][1], left
    if last:
        while END[state]:
            audit.append("I")
            state, cost = NEXT[state], cost + INSERT
    return "".join(audit), cost, state


def _named(*parts: Column) -> Column:
    """128 bits that name a row of these parts."""
    text = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.substring(F.unhex(F.sha2(F.concat(*text).cast("binary"), 256)), 1, 16)


def _rows(rows: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text, and the names of the row and of what it says in its conversation."""
    plain = rows.select(F.col(id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    here = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    at = F.coalesce(F.col("turn").cast("string"), F.lit(""))
    return plain.withColumn("said", _named(here, F.col("role"), F.col("text"))).withColumn(
        "name", F.substring(F.unhex(F.sha2(F.concat("said", at.cast("binary")), 256)), 1, 16))


def _marked(rows: DataFrame) -> DataFrame:
    """name, conv_id, turn, role, n (copies), fault and symbol of all different rows, without texts."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    light = rows.select(
        "name", "said", "conv_id", "turn", "role", F.length(end).alias("letters"), F.right(end, F.lit(1)).alias("end"))
    light = light.groupBy("name").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in light.columns[1:]])
    light = written(light, "turns")
    first = light.groupBy("said").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "name")).alias("f")).select(
        F.col("f.name").alias("name"), F.lit(True).alias("first"))
    fault = F.when(F.col("letters") == 0, "blank").when(F.col("first").isNull(), "duplicate").when(
        ~F.col("end").isin(".", "!", "?"), "truncated").otherwise("none")
    marked = light.join(first, "name", "left").withColumn("fault", fault)
    place = F.instr(F.lit(INITIALS[:3]), initial) - 1
    place = F.when((F.length(initial) == 0) | (place < 0), 3).otherwise(place)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(
        place + F.when(F.col("fault") == "truncated", 4).otherwise(0))
    return marked.select("name", "conv_id", "turn", "role", "n", "fault", place.alias("initial"), symbol.alias("symbol"))


def _illegal(a: int, b: int) -> bool:
    return INITIALS[a] + INITIALS[b] not in ("su", "ua", "au")


def _segments(key: str):
    """For mapInArrow over sorted rows (conv_id, name, symbol, n, initial): a row per segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, part = TaskContext.get().partitionId() << 32, None
        mine: list[list] = [[], [], [], []]
        goes_on = True  # the first of a partition may have begun in the one before

        def made(open_end: bool) -> tuple:
            nonlocal number
            names, symbols, counts, initials = mine
            collapsed = runs(symbols, counts)
            illegal = sum(n - 1 for n in counts) + sum(map(_illegal, initials, initials[1:]))
            # copies of a row have one initial, and no initial may follow itself
            number += 1
            return (part, number, goes_on or open_end, names, symbols, counts, illegal, initials[0], initials[-1],
                    [x for row in advanced(collapsed) for x in row])

        def out(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*done), schema)], schema=schema)

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("number", pa.int64()), ("open", pa.bool_()),
                                ("names", pa.list_(pa.binary())), ("symbols", pa.list_(pa.int32())),
                                ("counts", pa.list_(pa.int64())), ("illegal", pa.int64()), ("first", pa.int32()),
                                ("last", pa.int32()), ("matrix", pa.list_(pa.int64()))])
            done = []
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                full = len(mine[0]) == SEGMENT
                if mine[0] and (full or conv != part):
                    done.append(made(full and conv == part))
                    goes_on = full and conv == part
                    mine = [[], [], [], []]
                part = conv
                for have, new in zip(mine, rest):
                    have.append(new)
            if done:
                yield out(done, schema)
        if mine[0]:
            yield out([made(True)], schema)
    return run, (f"conv_id {key}, number long, open boolean, names array<binary>, symbols array<int>, counts array<long>, "
                 "illegal long, first int, last int, matrix array<long>")


def _by_conversation(step):
    """For mapInArrow over rows sorted by conv_id: ``step(values, kept)`` for every row, where ``kept`` is what it gave
    for the conversation's row before, None at first. Gives (number, *what step gives)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = kept = schema = None
        for batch in batches:
            out = []
            for conv, number, *values in zip(*(c.to_pylist() for c in batch.columns)):
                kept = step(values, kept if schema is not None and conv == part else None)
                part, schema = conv, True
                out.append((number, *kept))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(step.names, row)) for row in out], schema=step.schema)
    return run


def _backward(values: list, kept: tuple | None) -> tuple:
    """Costs that remain after a segment, whether it is the last, and those that remain before it."""
    after = tuple(kept[2]) if kept else END
    matrix = values[0]
    return list(after), kept is None, list(applied([tuple(matrix[i:i + 4]) for i in range(0, 16, 4)], after))


_backward.names = ["number", "after", "is_last", "before"]
_backward.schema = pa.schema([("number", pa.int64()), ("after", pa.list_(pa.int64())), ("is_last", pa.bool_()),
                              ("before", pa.list_(pa.int64()))])


def _forward(values: list, kept: tuple | None) -> tuple:
    """The state a segment begins with, its rows' first place, what its first pair adds to the illegal ones; then
    the same for the next segment."""
    first, last, ends, sizes = values
    state, base = (kept[3], kept[4]) if kept else (0, 0)
    pair = int(bool(kept) and _illegal(kept[5], first))
    return state, base, pair, ends[state], base + sizes[state], last


_forward.names = ["number", "state", "base", "pair", "end", "next", "seen"]
_forward.schema = pa.schema([("number", pa.int64()), ("state", pa.int32()), ("base", pa.int64()), ("pair", pa.int32()),
                             ("end", pa.int32()), ("next", pa.int64()), ("seen", pa.int32())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (conv_id, number, first, last, symbols, counts, after, is_last): where each state leads, and how
    many rows then stay."""
    for batch in batches:
        ends, sizes = [], []
        for symbols, counts, after, last in zip(*(c.to_pylist() for c in batch.columns[4:])):
            told = [unrolled(runs(symbols, counts), s, tuple(after), last) for s in range(4)]
            ends.append([t[2] for t in told])
            sizes.append([len(t[0]) - t[0].count("D") for t in told])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(ends, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int64()))],
            names=["conv_id", "number", "first", "last", "ends", "sizes"])


PLACED = pa.list_(pa.struct([("position", pa.int64()), ("name", pa.binary()), ("given", pa.string())]))


def _unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (conv_id, number, illegal, names, symbols, counts, state, base, after, is_last): audit, cost, and the
    rows that stay: position, name (none if inserted) and the role given to it (none if kept)."""
    for batch in batches:
        audits, costs, placed = [], [], []
        for names, symbols, counts, state, base, after, last in zip(*(c.to_pylist() for c in batch.columns[3:])):
            audit, cost, _ = unrolled(runs(symbols, counts), state, tuple(after), last)
            mine, row, copies = [], 0, 0
            for edit in audit:
                if edit != "I":
                    if edit != "D":
                        state = KEPT[symbols[row] & 3][state] if edit == "K" else NEXT[state]
                        mine.append({"position": base + len(mine), "name": names[row],
                                     "given": None if edit == "K" else ROLES[state]})
                    copies += 1
                    if copies == counts[row]:
                        row, copies = row + 1, 0
                else:
                    state = NEXT[state]
                    mine.append({"position": base + len(mine), "name": None, "given": ROLES[state]})
            audits.append(audit)
            costs.append(cost)
            placed.append(mine)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(audits), pa.array(costs, pa.int64()),
                                          pa.array(placed, PLACED)],
                                         names=["conv_id", "number", "illegal", "audit", "cost", "placed"])


class Repaired(NamedTuple):
    """``rows``: conv_id, position, role, text of the repaired conversations. ``audits``: a row per conversation
    with gaps, blank, duplicate, truncated, illegal, cost and audit."""

    rows: DataFrame
    audits: DataFrame


def repair(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Repair the conversations of ``rows``, which is read twice and should be a table or computed from one."""
    full = _rows(rows, id, turn, role, text)
    marked = written(_marked(full), "marked")
    key = marked.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("name")]
    cut, schema = _segments(key)
    segments = written(marked.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "name", "symbol", "n", "initial").mapInArrow(cut, schema), "segments")

    wide = segments.filter("open")
    after = wide.select("conv_id", "number", "matrix").repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.desc("number")).mapInArrow(
        _by_conversation(_backward), "number long, after array<long>, is_last boolean, before array<long>")
    wide = written(wide.join(after.drop("before"), "number"), "open")
    ends = wide.select("conv_id", "number", "first", "last", "symbols", "counts", "after", "is_last").mapInArrow(
        _ends, f"conv_id {key}, number long, first int, last int, ends array<int>, sizes array<long>")
    begins = ends.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc("number")).mapInArrow(
        _by_conversation(_forward), "number long, state int, base long, pair int, end int, next long, seen int")
    wide = wide.join(begins.select("number", "state", "base", "pair"), "number").withColumn(
        "illegal", F.col("illegal") + F.col("pair"))
    whole = segments.filter("NOT open").withColumns({
        "state": F.lit(0), "base": F.lit(0).cast("long"), "after": F.array(*map(F.lit, END)).cast("array<long>"),
        "is_last": F.lit(True)})
    names = ["conv_id", "number", "illegal", "names", "symbols", "counts", "state", "base", "after", "is_last"]
    edited = written(whole.select(names).unionByName(wide.select(names)).mapInArrow(
        _unroll, f"conv_id {key}, number long, illegal long, audit string, cost long, "
                 "placed array<struct<position:long,name:binary,given:string>>"), "edited")

    def count(name: str, n: Column) -> Column:
        return F.coalesce(F.sum(n), F.lit(0)).alias(name)
    # of several copies only the first can be anything but a duplicate
    fault, n, once = F.col("fault"), F.col("n"), F.col("fault").isin("truncated", "none")
    seen = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1
    faults = marked.groupBy(F.col("conv_id").alias("conv")).agg(
        F.coalesce((seen - F.countDistinct("turn")).try_cast("long"), F.lit(0)).alias("gaps"),
        count("blank", F.when(fault == "blank", n)),
        count("duplicate", F.when(once, n - 1).when(fault == "duplicate", n)),
        count("truncated", F.when(fault == "truncated", 1)))
    joined = F.array_sort(F.collect_list(F.struct("number", "audit")))
    audits = edited.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(joined, lambda s: s["audit"]), "").alias("audit"))
    audits = audits.join(faults, audits["conv_id"].eqNullSafe(faults["conv"])).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    stay = edited.select("conv_id", F.explode("placed").alias("p")).select("conv_id", "p.*")
    texts = full.groupBy("name").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kept = stay.filter("name IS NOT NULL").join(texts, "name").select(
        "conv_id", "position", F.coalesce("given", "role").alias("role"), "text")
    new = stay.filter("name IS NULL").select("conv_id", "position", F.col("given").alias("role"), F.lit("").alias("text"))
    return Repaired(kept.unionByName(new), audits)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows: of ``role:text``, joined by line feeds. A conversation's rows stream by
    one after the other, as a digest needs them, and none is held."""
    key = rows.schema["conv_id"].dataType.simpleString()
    lines = rows.select("conv_id", "position", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = digest = None

        def made(schema: pa.Schema, convs: list, found: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(convs, schema.field(0).type), pa.array(found, pa.string())],
                                              names=["conv_id", "repaired_sha256"])
        for batch in batches:
            convs, found = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(2)):
                if digest is None or conv != part:
                    if digest is not None:
                        convs.append(part)
                        found.append(digest.hexdigest())
                    part, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.as_buffer())
            yield made(batch.schema, convs, found)
        if digest is not None:
            yield made(batch.schema, [part], [digest.hexdigest()])
    return lines.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "position").mapInArrow(
        run, f"conv_id {key}, repaired_sha256 string")
