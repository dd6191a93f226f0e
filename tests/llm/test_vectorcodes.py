import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from basketry.llm import vectorcodes


def brute(rows, rounds=6, parts=8):
    """(id, code, error, label_error, digest) by plain k-means over lists of integers; ``rows`` of one size."""
    kept = [(i, label, [math.floor(Fraction(x) * 4096) for x in vec]) for i, vec, label in rows
            if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-len(kept[0][2]) // parts)
    cut = [[(v + [0] * parts)[p * width:(p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:16]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(mine[e]) for col in zip(*mine[e])] if mine[e] else old
                        for e, old in enumerate(books[p])]
    told, total = [], Counter()
    for (i, label, _), c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        total[label] += error
        told.append((i, label, "".join(f"{e:02x}" for _, e in best), error))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = (1 << 63) - 1
    return Counter((i, c, min(e, top), min(total[label], top), sha) for i, label, c, e in told)


def told(df):
    return Counter(map(tuple, vectorcodes.compress(df).drop("label").collect()))


SCHEMA = "vec_id long, embedding array<double>, label string"


@pytest.mark.parametrize("size, spread", [(16, 1.0), (24, 0.02), (11, 3.0), (8, 100.0), (112, 1.0)])
def test_against_plain_k_means(spark, monkeypatch, size, spread):
    monkeypatch.setattr(vectorcodes, "CHUNK", 90)
    rand = np.random.default_rng(size)
    centres = rand.normal(size=(20, size))
    x = spread * (centres[rand.integers(20, size=300)] + 0.1 * rand.normal(size=(300, size)))
    rows = [(i * 3 % 301, [float(v) for v in r], [None, "a", "b"][i % 3]) for i, r in enumerate(x)]
    rows += [(1000, None, "a"), (1001, [float("nan")] * size, "a"), (1002, [None] * size, "a"), (1003, [math.inf] * size, "b"),
             (None, rows[9][1], "b"), rows[4], rows[4]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS code").repartition(3)
    assert told(df) == brute(rows)


def test_huge_components_stay_exact(spark):
    rand = np.random.default_rng(4)
    rows = [(i, [float(v) * 10.0 ** int(rand.integers(-3, 306)) for v in rand.normal(size=8)], "a") for i in range(60)]
    rows += [(100 + i, [float(v) for v in rand.normal(size=8) * 1e9], "b") for i in range(60)]
    assert told(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert told(spark.createDataFrame(rows[60:], SCHEMA)) == brute(rows[60:])


def test_other_sizes_few_vectors_and_none(spark):
    few = [(i, [0.5 * i] * 8, None) for i in range(5)]
    other = [(50 + i, [float(i % 3)] * 16, "x") for i in range(40)]
    got = told(spark.createDataFrame(few + other + [(99, [], "y")], SCHEMA))
    want = brute([(i, v, str(len(v))) for i, v, _ in few]) + brute(other)
    assert got == want + Counter([(99, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())])
    assert not told(spark.createDataFrame([], SCHEMA))


def test_curve_visits_neighbours():
    """On a full grid every step of the curve goes to a neighbouring cell, and every cell has a place of its own."""
    for n, bits in ((2, 5), (3, 3)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * n), axis=-1).reshape(-1, n)
        old, vectorcodes.CURVE_BITS = vectorcodes.CURVE_BITS, bits
        try:
            place = vectorcodes.hilbert(grid)
        finally:
            vectorcodes.CURVE_BITS = old
        assert sorted(place) == list(range(side ** n))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_blocks_spare_most_points():
    """Where the entries lie apart, shortlists leave one entry for most blocks, and the sums are those of all points."""
    rand = np.random.default_rng(1)
    entries = (rand.normal(size=(16, 8)) * 4000).astype(np.int64)
    points = entries[rand.integers(16, size=4000)] + rand.integers(-90, 90, size=(4000, 8))
    blocks = vectorcodes.Blocks.of(points)
    sums, counts, read = blocks.sums_by_entry(entries)
    at, _ = vectorcodes.nearest(points, entries)
    assert (counts == np.bincount(at, minlength=16)).all() and read < 2000
    assert all((sums[e] == points[at == e].sum(axis=0)).all() for e in range(16))
    again = vectorcodes.Blocks.loaded(blocks.stored())
    assert (again.assigned(entries)[0] == at).all()
