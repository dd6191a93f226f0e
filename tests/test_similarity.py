import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from basketry.operators import similarity

VECTORS = "id int, vector array<double>"


def frame(spark, matrix, ids=None):
    rows = [(int(i), [float(x) for x in row]) for i, row in zip(ids or range(len(matrix)), matrix)]
    return spark.createDataFrame(rows, VECTORS)


def brute(scores, k, skip_self=True):
    out = {}
    for i, row in enumerate(np.round(scores, 9)):
        order = [j for j in np.lexsort((np.arange(len(row)), -row)) if not (skip_self and j == i)]
        out[i] = [int(j) for j in order[:k]]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["source_id"], r["rank"])):
        out.setdefault(r["source_id"], []).append(r["neighbor_id"])
    return out


@pytest.mark.parametrize("block_rows,cells_per_root", [(2048, 0.1), (16, 1.0)])
def test_similar_items_exact_with_copies(spark, block_rows, cells_per_root):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(5, 6)) * 4
    matrix = centers[rng.integers(0, 5, 150)] + rng.normal(size=(150, 6)) * 0.3
    matrix[40:90] = matrix[40]  # a third of all rows are copies
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    found = similarity.similar_items(frame(spark, matrix), 5, block_rows=block_rows, cells_per_root=cells_per_root)
    assert lists(found) == brute(unit @ unit.T, 5)


def test_zero_vectors(spark):
    vectors = frame(spark, [[1, 0], [0, 0], [1, 1]])
    assert set(lists(similarity.similar_items(vectors, 5))) == {0, 2}
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 9)], "a int, b int")
    rows = {r["b"]: r["similarity"] for r in similarity.pair_similarity(pairs, vectors).collect()}
    assert rows[1] == 0.0 and rows[9] == 0.0 and rows[2] == pytest.approx(2 ** -0.5)


def test_vectors_that_are_not_finite_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None), (6, [0.2, 1.0])]
    vectors = spark.createDataFrame(rows, VECTORS)
    assert lists(similarity.similar_items(vectors, 5)) == {0: [1, 6], 1: [0, 6], 6: [1, 0]}
    assert lists(similarity.best_candidates(vectors, vectors, 1)) == {0: [0], 1: [1], 6: [6]}


def test_best_candidates_by_dot_product(spark):
    rng = np.random.default_rng(2)
    users, items = rng.normal(size=(40, 5)), rng.normal(size=(70, 5)) * rng.uniform(0.1, 5, (70, 1))
    found = similarity.best_candidates(frame(spark, users), frame(spark, items), 4, block_rows=16, cells_per_root=0.8)
    assert lists(found) == brute(users @ items.T, 4, skip_self=False)


def test_fewer_candidates_than_asked(spark):
    found = similarity.similar_items(frame(spark, [[1, 0], [0, 1]]), 10)
    assert lists(found) == {0: [1], 1: [0]}
    empty = similarity.similar_items(frame(spark, [[0, 0]]), 10)
    assert empty.collect() == []


def test_visits_go_out_in_small_frames(spark, monkeypatch):
    """A vector that visits all cells is repeated slice by slice, and large blocks give the same lists as cells."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    monkeypatch.setattr(similarity, "SLICE", 40)
    cells = {tuple(r) for r in similarity.similar_items(df, 3, block_rows=8, cells_per_root=1.0).collect()}
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 1)
    blocks = {tuple(r) for r in similarity.similar_items(df, 3, block_rows=8, cells_per_root=1.0).collect()}
    v = np.array([x for _, x in rows]); v /= np.linalg.norm(v, axis=1)[:, None]
    scores = np.round(v @ v.T, 9); np.fill_diagonal(scores, -2)
    true = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), -scores[i]))[:3]}
    assert {r[:2] for r in cells} == {r[:2] for r in blocks} == true


def test_a_block_takes_little_beside_its_vectors():
    """Vectors are read from the batch as they are, without an object each, and products are worked out tile by tile."""
    rng = np.random.default_rng(4)
    width, rows = 64, 20_000
    values = np.round(rng.normal(size=(2, rows, width)), 1)
    values[1, 5000:9000] = values[1, 5000]  # ties go to the lower id

    def table(name, ids, matrix):
        offsets = pa.array(np.arange(0, matrix.size + 1, width, dtype="int32"))
        return pa.table({name: ids, "vector": pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))})
    cids = rng.permutation(rows)
    asked, held = table("qid", np.arange(300), values[0, :300]), table("cid", cids, values[1])
    tracemalloc.start()
    found = similarity._best_products(asked, held, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * values[1].nbytes + (8 << 20)
    scores = np.round(values[0, :300] @ values[1].T, 9)
    expected = [(i, int(cids[j])) for i in range(300) for j in np.lexsort((cids, -scores[i]))[:5]]
    assert list(zip(found["qid"].to_pylist(), found["cid"].to_pylist())) == expected


def test_visitors_are_counted_without_their_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "qid long, vector array<double>")
    placed = similarity._place(df.withColumnRenamed("qid", "cid"), similarity._pick_centers(df.withColumnRenamed("qid", "cid"), 5))
    cells = similarity._describe(placed, similarity._pick_centers(df.withColumnRenamed("qid", "cid"), 5), 3, 8)
    counted = similarity._visits(df, cells, 3, counted=True)
    assert counted.columns == ["cell", "n"]
    told = {r["cell"]: r["n"] for r in counted.groupBy("cell").agg({"n": "sum"}).toDF("cell", "n").collect()}
    assert told == {r["cell"]: r["count"] for r in similarity._visits(df, cells, 3).groupBy("cell").count().collect()}


def test_tiles_look_closer_only_at_rows_with_a_hit(monkeypatch):
    """Products of many tiles, taken again in double precision now and then: the best of all, ties to the lower place."""
    rng = np.random.default_rng(6)
    rows, others = (np.round(rng.normal(size=(n, 6)), 1) for n in (40, 5000))
    others[2000:2600] = others[7]
    place, looked, divmod_ = rng.permutation(5000), [], np.divmod
    monkeypatch.setattr(similarity, "TILE", (40, 128))
    monkeypatch.setattr(similarity.np, "divmod", lambda at, width: looked.append(len(at)) or divmod_(at, width))
    reach = np.sqrt((others ** 2).sum(1).max())
    r, c, score = similarity._best_columns(rows, others, others.astype(np.float32), reach, place, 5, np.full(40, -np.inf))
    truth = np.round(rows @ others.T, 9)
    for i in range(40):
        best = np.lexsort((place, -truth[i]))[:5]
        assert c[r == i].tolist() == best.tolist() and score[r == i].tolist() == truth[i][best].tolist()
    # better than the best a row knows: no tile has to be looked at
    looked.clear()
    none = similarity._best_columns(rows, others, others.astype(np.float32), reach, place, 5, np.full(40, 1e3))
    assert len(none[0]) == 0 and not looked
