import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.llm import queries, repair

FOLDER = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    """Faults of (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(BLANK)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else
                   "truncated" if end[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(rows, told):
    """(cost, audit, repaired) by a search over all edits, cheapest and then least first; nothing is collapsed."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, said, out = heapq.heappop(queue)
        state = said[-1:] if said != "s" else "s"
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return cost, audit, out
        new = "assistant" if state == "u" else "user"

        def go(price, edit, step, role=None, text=""):
            more = said if role is None else (said + role[:1])[-2:]
            if role is None or re.fullmatch(r"s|s?u|ua|au", more):
                heapq.heappush(queue, (cost + price, audit + edit, i + step, more, out if role is None else out + (f"{role}:{text}",)))
        go(2, "I", 0, new)
        if i < len(rows):
            (role, text), late = rows[i], int(told[i] == "truncated")
            go(3, "D", 1)
            if told[i] in ("none", "truncated"):
                if role[:1] and (role[0] in "ua" and role[0] == new[0] or role[0] == "s" and not said):
                    go(late, "K", 1, role, text)
                go(2 + late, "R", 1, new, text)


def brute(rows):
    """The contract's row for one conversation's (turn, role, text) in order."""
    plain = [(r, t) for _, r, t in rows]
    told, turns = faults(plain), {t for t, _, _ in rows if t is not None}
    cost, audit, out = cheapest(plain, told)
    pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[told.count(f) for f in (
        "blank", "duplicate", "truncated")], pairs, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def harmed(rows):
    """What the query does to (conv_id, turn, role, text) before it repairs."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(given):
    """By conversation; rows of equal turn are not ordered here, so there must be none but equal ones."""
    by = defaultdict(list)
    for conv, *rest in harmed(given):
        by[conv].append(tuple(rest))
    for rows in by.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    return Counter((conv, *brute(by[conv])) for conv in {g[0] for g in given})


def told(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op13_repair(spark, str(tmp_path))
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert out.columns == names
    return Counter(map(tuple, out.collect()))


def some_rows(seed, convs, longest):
    rand = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "no", " ", "", "What?  ", "Yes.", None, "ü! "]
    out = []
    for conv in [*range(convs), None]:
        for turn in [*sorted(rand.choice(3 * longest, rand.integers(1, longest), replace=False).tolist())]:
            out.append((conv, turn, roles[rand.choice(6, p=[.38, .38, .1, .06, .04, .04])],
                        texts[rand.integers(8)] if rand.random() < .5 else f"text {rand.integers(9999)}."))
    return out


@pytest.mark.parametrize("segment", [1 << 16, 3])
def test_against_search_over_all_edits(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    given = some_rows(segment, 60, 14)
    given += [given[5]] * 3 + [(1000, None, "user", "a null turn."), (1001, None, None, None)]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").selectExpr("*", "turn AS position", "1 AS name")
    assert told(spark, df.repartition(5), tmp_path) == expected(given)


def test_whole_table(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    assert Counter(map(tuple, queries.op13_repair(spark, FOLDER).collect())) == expected(given)


def test_empty_table(spark, tmp_path):
    assert not told(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tmp_path)


def test_a_conversation_over_many_tasks(spark, tmp_path, monkeypatch):
    """One conversation with most rows, in segments of a few rows, with a text that is mostly the same."""
    monkeypatch.setattr(repair, "SEGMENT", 16)
    rand = np.random.default_rng(8)
    given = [(7, i, ["user", "assistant"][(i + rand.integers(0, 12) // 11) % 2], "the same." if i % 3 else f"turn {i}.") for i in range(700)]
    given += [(i, 0, "user", "Hello.") for i in range(20, 40)] + [(50, 1, "user", "word " * 300_000 + ".")]
    df = spark.createDataFrame(given, "conv_id int, turn int, role string, text string").repartition(9)
    assert told(spark, df, tmp_path) == expected(given)
    made = repair.repair(df)
    rows = sorted((r for r in made.rows.collect() if r.conv_id == 7), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows)))
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows))


def test_powers_and_choices_of_long_runs():
    """A run's powers are its matrix multiplied over and over; unrolled costs are the matrix's."""
    for symbol in repair.MOVES:
        whole = repair.IDENTITY
        for n in range(1, 40):
            whole = repair.product(whole, repair.POWERS[symbol][0])
            assert repair.advanced([[symbol, n]]) == whole
            for state in range(4):
                audit, cost, end = repair.unrolled([[symbol, n]], state, repair.END, True)
                assert cost == repair.applied(whole, repair.END)[state] and end in (0, 3)
                assert len(audit) - audit.count("I") == n
