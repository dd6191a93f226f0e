import math
from collections import Counter

import numpy as np
import pytest

from basketry.llm import vecdedup

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, limit=0.98):
    """(id, n_links, component, kept) by all pairs."""
    good = [label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
            for _, v, label in rows]
    unit = [np.array(v) / max(map(abs, v)) if g else None for (_, v, _), g in zip(rows, good)]
    unit = [u if u is None else u / np.sqrt(u @ u) for u in unit]
    near = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2]
             and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= limit] for i in range(len(rows))]
    out = Counter()
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen |= set(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out[row[0], len(near[i]), least, row[0] == least] += 1
    return out


def told(df, **more):
    return Counter(map(tuple, vecdedup.near_duplicates(df, **more).collect()))


def planted(rand, n, size, label, first):
    """Groups of near copies about the limit, and scattered vectors."""
    centres = rand.normal(size=(n // 4, size))
    x = centres[rand.integers(len(centres), size=n)] + rand.normal(size=(n, size)) * rand.choice([0.02, 0.1, 0.2], size=(n, 1))
    return [(first + 7 * i % n, [float(v) for v in r], label) for i, r in enumerate(x)]


@pytest.mark.parametrize("size, sample", [(16, 20_000), (16, 60), (3, 20_000), (64, 20_000)])
def test_against_all_pairs(spark, monkeypatch, size, sample):
    """Over many lists and blocks, with codebooks of all rows and of few."""
    for name, value in (("BLOCK", 40), ("LIST", 15), ("PACKET", 16)):
        monkeypatch.setattr(vecdedup, name, value)
    rand = np.random.default_rng(size)
    rows = planted(rand, 500, size, "a", 0) + planted(rand, 90, size, "b", 600)
    rows += [(2000, None, "a"), (2001, [0.0] * size, "a"), (2002, [math.nan] * size, "a"), (2003, [None] * size, "a"),
             (2004, rows[0][1], None), (2005, [1.0] * (size + 1), "a"), (2006, [2.0] * (size + 1), "a"), (2007, [], "a"),
             (2008, [x * 1e300 for x in rows[1][1]], "a"), (2009, [x * 1e-300 for x in rows[1][1]], "a"),
             (2010, [x * 4 for x in rows[2][1]], "a"), (2011, [-x for x in rows[2][1]], "a"), (None, rows[3][1], "a"),
             (None, [9.0] + [0.0] * (size - 1), "c"), rows[4], rows[4], (2012, rows[5][1], "b"), (2013, [-0.0, 1.0], "z"), (2014, [0.0, 1.0], "z")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS class").repartition(3)
    assert told(df, sample=sample) == brute(rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """A third of all rows around one vector, and copies of one vector: all links are counted, and few rows tell them."""
    monkeypatch.setattr(vecdedup, "BLOCK", 100)
    rand = np.random.default_rng(5)
    hot = rand.normal(size=8)
    x = [*(hot + 0.01 * rand.normal(size=(300, 8))), *[hot] * 200, *rand.normal(size=(300, 8))]
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(df) == brute(rows)
    vectors = vecdedup.classes(df)
    models = vecdedup.trained(vectors)
    assert vecdedup.links(vecdedup.index(vectors, models), models).count() < 10 * len(rows)


def test_empty_table(spark):
    assert not told(spark.createDataFrame([], SCHEMA))


def test_codes_bound_distances():
    """A looked-up distance is off by the code's loss at most."""
    rand = np.random.default_rng(6)
    x = vecdedup.units(rand.normal(size=(400, 20)))
    words = [vecdedup._means(x[:, a:b], 8, rand) for a, b in zip(vecdedup._cuts(20), vecdedup._cuts(20)[1:])]
    codes, loss = vecdedup.coded(x, words)
    far = vecdedup.looked_up(x[:50], codes, words)
    exact = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(axis=2))
    assert (np.abs(far - exact) <= loss[None, :] + 1e-9).all() and loss.mean() < 0.9
