import math
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import mips, queries


def brute(vectors, k, every):
    out = []
    for q in vectors:
        if q % every == 0:
            ranked = sorted((-sum(a * b for a, b in zip(vectors[q], v)), c) for c, v in vectors.items()
                            if c != q and len(v) == len(vectors[q]))[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_search_is_exact(spark, spread, monkeypatch):
    monkeypatch.setattr(mips, "BLOCK", 150)
    monkeypatch.setattr(mips, "QUERIES", 20)
    rand = np.random.default_rng(3)
    x = rand.normal(size=(900, 6)) * np.exp(spread * rand.normal(size=(900, 1)))
    x[5] = x[6] = x[7] = x[20]
    x[100] = 0
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)]
    rows += [(5000, None, "a"), (5001, [1.0, None], "a"), (5020, [float("nan")] * 6, "a"), (5040, [float("inf")] * 6, "a"),
             (5004, [1.0, 2.0], "a"), (5100, [2.0, 2.0], "a"), (6000, [], "a"), (5060, [1e30] * 6, "a"), (None, [1.0] * 6, "a"),
             rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    scaled = mips.scaled(df)
    vectors = {r.id: r.vec for r in scaled.collect()}
    assert not {5000, 5001, 5020, 5040, 5060, None} & set(vectors)
    got = mips.search(scaled.filter("id % 20 = 0"), scaled, 7)
    assert sorted(map(tuple, got.collect())) == brute(vectors, 7, 20)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 19 + i), float(-(2 ** 19) + 3 * i)]) for i in range(30)]
    scaled = mips.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = mips.search(scaled.filter("id % 10 = 0"), scaled, 5)
    assert sorted(map(tuple, got.collect())) == brute({r.id: r.vec for r in scaled.collect()}, 5, 10)


def test_empty(spark):
    scaled = mips.scaled(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert mips.search(scaled, scaled).collect() == []
    one = mips.scaled(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))
    assert mips.search(one, one).collect() == []


def test_repeated_rows_are_ranked_as_the_sql_does(spark, tmp_path):
    """Queries and candidates in several rows, equal ones and others of the same id."""
    rand = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rand.normal(size=4)]) for i in range(400)]
    rows += [rows[100]] * 2 + [r for r in rows if r[1][0] > 1] * 2 + [(7, [3.0, 3.0, 3.0, 3.0])] * 3 + [(200, [1.0, -2.0, 0.5, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    told = [tuple(r) for r in queries.op5_top_k(spark, str(tmp_path)).collect()]
    assert sorted(told) == sorted(engine.execute(queries.SQL["op5_top_k"]).fetchall())


def test_vectors_of_any_finite_length(spark):
    """Long vectors are queries and candidates like all others; ranks follow true products, of repeated rows too."""
    rand = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rand.normal(size=4) * 10.0 ** int(rand.choice([0, 0, 0, 4, 7, 12, 150, 305]))]) for i in range(160)]
    rows += [(500, [3e6] * 4), (500, [3e6] * 4), (501, [-3e6] * 4), (502, [float("nan")] * 4), (503, [0.0] * 4), (520, [1.7e308] * 4),
             (504, [3e6, 1.0]), (540, [2.0, 2.0]), (None, [1.0] * 4), (505, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score").repartition(3)
    exact = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if i is not None and not any(x != x for x in v)]
    top = (1 << 63) - 1
    want = []
    for q, v in exact:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in exact if c != q and len(v) == len(w))[:5]
            want += [(q, c, max(-top - 1, min(top, -s)), s) for s, c in best]
    got = mips.search_all(df, F.col("id") % 20 == 0, 5)
    told = [tuple(r)[:1] + tuple(r)[2:] for r in got.collect()]
    queries = {q: n for q, n in Counter(q for q, _ in exact if q % 20 == 0).items()}
    single = [w[:3] for w in want if queries[w[0]] == 1]
    assert Counter(t for t in told if queries[t[0]] == 1) == Counter(single)
    # two rows of one query id are ranked together
    assert [r[1:] for r in sorted(tuple(r) for r in got.collect() if r.query_id == 500)] == [
        (i + 1, w[1], w[2]) for i, w in enumerate(sorted((w for w in want if w[0] == 500), key=lambda w: (w[3], w[1]))[:5])]
