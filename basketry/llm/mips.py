"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length into classes, from the longest to the shortest,
and each class is cut into blocks of a few thousand vectors by a hash. Queries travel in
blocks too, to every block of candidates whose longest vector could still give a
score that matters, and meet it in one task, where only the block and one block
of queries are in memory.

First each query is scored against one block of the longest class; its k-th best score
there is a lower bound for the final one. In a block of longest length l that bound is a
local cosine threshold t = bound / (|q| l). Above 1 the block is skipped. A high
threshold prunes by coordinates: on the query's largest coordinates a candidate must lie
near enough to the query for a cosine of t. A low one prunes by length: candidates
shorter than bound / |q| are left out. What remains is verified with exact products.

Bounds are widened by far more than rounding, so the result is exact.

Vectors whose squared length reaches 2^62 after scaling stand apart: their products need not fit a long. ``search_all``
lets them meet, as queries and as candidates, all others in blocks, with Python's integers; usually there are none.

Edge cases: vectors that are null or hold null or non-finite components take no part. Vectors meet
only vectors of as many components. Scores that a long cannot hold are given as the greatest or least
long, but ranked by their true values. Fully equal rows count once in ``search``, and ``every_row`` then ranks each
of them, as SQL does; rows with a query's id count as
its own and are no candidates for it; equal vectors of other ids are all ranked, ties by smaller id. Null ids take no part.
Queries without candidates give no rows, and so do empty tables. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import small_batches, written

CLASSES = 64  # of length
BLOCK = 4096  # candidates of a block, about
QUERIES = 512  # queries of a block, about
COSINE = 0.6  # thresholds from here on prune by coordinates
FOCUS = 3  # coordinates looked at
SLACK = 1e-9


SCALE = 1024
LONGEST = 2.0 ** 31  # squares below 2^62 have products that a long holds


def kept(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, raw, norm) of the vectors that take part; the length is that of the scaled vector, about."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.filter(F.col(id).isNotNull() & F.col(vector).isNotNull() & good).select(
        F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("raw"))
    whole = F.transform("raw", lambda x: F.lit(float(SCALE)) * x)
    return found.withColumn("norm", F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, x: s + F.rint(x) * F.rint(x))))


def scaled(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec, norm) of the vectors that take part and are not too long: components floor(1024 * x), and the length."""
    whole = F.transform("raw", lambda x: F.floor(F.lit(float(SCALE)) * x))
    short = kept(rows, id, vector).filter(F.col("norm") < LONGEST * 0.99).select("id", whole.alias("wide"))
    norm = F.aggregate("wide", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return short.select("id", F.col("wide").cast("array<int>").alias("vec"), F.sqrt(norm).alias("norm"))


def _classes(rows: DataFrame) -> list[dict]:
    """Length classes by number of components, longest first: dim, above (the shortest
    length), longest, blocks."""
    edges = rows.groupBy(F.size("vec").alias("dim")).agg(F.percentile_approx(
        "norm", [i / CLASSES for i in range(CLASSES)], 10_000).alias("edges")).collect()
    found = []
    for dim, cuts in edges:  # a row per number of components
        cuts = sorted(set(cuts))
        found += [(dim, a, b) for a, b in zip([-1.0, *cuts[1:]], [*cuts[1:], float("inf")])]
    table = rows.sparkSession.createDataFrame(found, "dim int, above double, below double")
    sized = rows.join(F.broadcast(table), (F.size("vec") == F.col("dim")) & (F.col("norm") >= F.col("above")) & (
        F.col("norm") < F.col("below"))).groupBy("dim", "above").agg(
        F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    return [{"dim": r["dim"], "above": r["above"], "longest": r["longest"], "blocks": math.ceil(r["n"] / BLOCK)}
            for r in sorted(sized, key=lambda r: (r["dim"], -r["above"]))]


def _class_of(classes: list[dict]) -> Column:
    """The place in ``classes`` of a row (vec, norm)."""
    table = F.array(*[F.struct(F.lit(c["dim"]).alias("dim"), F.lit(c["above"]).alias("above"),
                               F.lit(i).alias("i")) for i, c in enumerate(classes)])
    return F.filter(table, lambda c: (c["dim"] == F.size("vec")) & (F.col("norm") >= c["above"]))[0]["i"]


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Packed queries: dim, number, items (id, vec, norm, bound)."""
    n = max(1, math.ceil(queries.count() / QUERIES))
    return queries.groupBy(F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("number")).agg(
        F.sort_array(F.collect_list(F.struct("id", "vec", "norm", "bound"))).alias("items"))


def _visits(blocks: DataFrame, classes: list[dict], probe: bool) -> DataFrame:
    """A row for every block of candidates that a block of queries has to meet."""
    table = F.array(*[F.struct(F.lit(i).alias("class"), F.lit(c["dim"]).alias("dim"), F.lit(c["blocks"]).alias("blocks"),
                               F.lit(c["longest"]).alias("longest")) for i, c in enumerate(classes)])
    mine = F.filter(table, lambda c: c["dim"] == F.col("dim"))
    if probe:
        first = F.try_element_at(mine, F.lit(1))
        return blocks.select("number", "items", first["class"].alias("class"),
                             F.pmod("number", first["blocks"]).alias("block")).filter("class IS NOT NULL")
    met = blocks.select("number", "items", F.explode(mine).alias("c")).withColumn("items", F.filter(
        "items", lambda q: q["bound"].isNull() | (q["norm"] * F.col("c.longest") * (1 + SLACK) >= q["bound"])))
    return met.filter(F.size("items") > 0).select(
        "number", "items", F.col("c.class").alias("class"),
        F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1)).alias("block"))


def _survivors(unit: np.ndarray, norms: np.ndarray, q: np.ndarray, length: float, bound: float) -> np.ndarray | None:
    """Places of the candidates (longest first) a query cannot rule out; None for all."""
    if length == 0 or bound <= 0 or not norms[0]:
        return None
    cosine = bound / (length * norms[0]) * (1 - SLACK)
    if cosine > 1:
        return np.empty(0, np.int64)
    if cosine < COSINE:  # by length
        return np.arange(np.searchsorted(-norms, -bound / length * (1 - SLACK), "right"))
    there = np.arange(len(norms))
    direction = q / length
    for f in np.argsort(-np.abs(direction))[:FOCUS]:  # by coordinates
        x, reach = direction[f], math.sqrt(max(0.0, (1 - cosine ** 2) * (1 - direction[f] ** 2))) + SLACK
        low = -1 - SLACK if x <= -cosine else x * cosine - reach
        high = 1 + SLACK if x >= cosine else x * cosine + reach
        values = unit[there, f]
        there = there[(values >= low) & (values <= high)]
    return there


def _best(k: int, pruned: bool):
    """For mapInArrow over rows (class, block, number, ids, vecs, norms, bounds) sorted by
    the first three; number -1 marks candidates. Gives (query_id, id, score)."""
    def candidates(ids: list, vecs: list, norms: list):
        ids, vecs, norms = np.concatenate(ids), np.concatenate(vecs), np.concatenate(norms)
        order = np.lexsort((ids, -norms))
        vecs = vecs.reshape(len(ids), -1)[order].astype(np.float64)
        norms = norms[order]
        unit = vecs / np.where(norms > 0, norms, 1)[:, None] if pruned else None
        return ids[order], vecs, norms, unit

    def top(q_id: np.ndarray, which: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        own = ids[None, :] == q_id[:, None]
        low = np.iinfo(np.int64).min
        scores = np.where(own, low, scores)
        if scores.shape[1] > k:
            edge = np.partition(scores, -k, axis=1)[:, -k, None]
            rows, cols = np.nonzero((scores >= edge) & ~own)
        else:
            rows, cols = np.nonzero(~own)
        values, found = scores[rows, cols], ids[cols]
        order = np.lexsort((found, -values, rows))
        rows, values, found = rows[order], values[order], found[order]
        starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.empty(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        keep = place < k
        return which[rows[keep]], found[keep], values[keep]

    def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
        if most < 2.0 ** 52:  # every partial sum is exact in a double
            return np.rint(a @ b.T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T

    def search(block, q_ids, q_vecs, q_norms, bounds) -> Iterator[pa.RecordBatch]:
        ids, vecs, norms, unit = block
        q = q_vecs.reshape(len(q_ids), -1).astype(np.float64)
        every, some = [], []
        for i in range(len(q_ids)):
            left = None if not pruned or np.isnan(bounds[i]) else _survivors(unit, norms, q[i], q_norms[i], bounds[i])
            if left is None or len(left) > len(ids) // 4:
                every.append(i)
            elif len(left):
                some.append((np.array([i]), left))
        most = float(norms[0]) * float(q_norms.max(initial=0))
        for rows, there in [*([(np.array(every), slice(None))] if every else []), *some]:
            a, b, c = top(q_ids[rows], q_ids[rows], ids[there], products(q[rows], vecs[there], most))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vecs, norms, block = None, [], [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for i, (kind, part, number) in enumerate(keys):
                if (kind, part) != here:
                    here, ids, vecs, norms, block = (kind, part), [], [], [], None
                a, b, c, d = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(3, 7))
                if number < 0:
                    ids.append(a)
                    vecs.append(b)
                    norms.append(c)
                elif ids:
                    block = block or candidates(ids, vecs, norms)
                    yield from search(block, a, b, c, d)
    return run


def _met(candidates: DataFrame, visits: DataFrame, classes: list[dict], k: int, pruned: bool) -> DataFrame:
    mine = candidates.withColumn("class", _class_of(classes))
    counts = F.array(*[F.lit(c["blocks"]) for c in classes])
    rows = mine.select(
        "class", F.pmod(F.xxhash64("id"), F.get(counts, F.col("class"))).cast("int").alias("block"),
        F.lit(-1).alias("number"), F.array("id").alias("ids"), "vec",
        F.array("norm").alias("norms"), F.array(F.lit(None).cast("double")).alias("bounds"))
    asked = visits.select(
        "class", F.col("block").cast("int"), "number", F.col("items.id").alias("ids"), F.flatten("items.vec").alias("vec"),
        F.col("items.norm").alias("norms"), F.col("items.bound").alias("bounds"))
    if not pruned:  # candidates of blocks nobody visits need not travel
        rows = rows.join(asked.select("class", "block").distinct(), ["class", "block"], "left_semi").select(rows.columns)
    n = max(candidates.sparkSession.sparkContext.defaultParallelism, min(sum(c["blocks"] for c in classes), 100_000))
    small_batches(candidates.sparkSession, 256)
    return rows.unionByName(asked).repartition(n, "class", "block").sortWithinPartitions("class", "block", "number").mapInArrow(
        _best(k, pruned), "query_id long, id long, score long")


def search(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of every query.
    Both tables as ``scaled`` gives them."""
    candidates = written(candidates.distinct(), "vectors")
    queries = written(queries.distinct().withColumn("bound", F.lit(None).cast("double")), "queries")
    classes = _classes(candidates)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    if not classes:
        return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias(
            "score")).limit(0)
    probed = _met(candidates, _visits(_query_blocks(queries), classes, probe=True), classes, k, pruned=False)
    bounds = probed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bound"))
    bounded = queries.drop("bound").join(bounds, queries["id"] == bounds["query_id"], "left").select(
        "id", "vec", "norm", "bound")
    bounded = written(bounded, "queries")
    found = _met(candidates, _visits(_query_blocks(bounded), classes, probe=False), classes, k, pruned=True)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


def every_row(found: DataFrame, queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """What ``search`` found, with repeated rows as rows of their own: a pair of which the query has m rows and
    the candidate n is ranked m x n times.

    Any row among the k highest then belongs to a pair that is found, so only the found pairs with
    an id of several rows are scored again.
    """
    again = [rows.groupBy("id").count().filter("count > 1").select("id") for rows in (queries, candidates)]
    again = written(again[0].unionAll(again[1]).distinct(), "repeated")
    if again.isEmpty():
        return found
    found = written(found, "found")
    pairs = found.select("query_id", "id").distinct()
    touched = pairs.join(again, "id", "left_semi").unionAll(pairs.join(
        again.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select("query_id", "id")).distinct()

    def counted(rows: DataFrame, *names: str) -> DataFrame:
        return rows.groupBy("id", "vec").agg(F.count("*")).toDF(*names)
    product = F.aggregate(F.zip_with("q", "c", lambda a, b: a.cast("long") * b.cast("long")),
                          F.lit(0).cast("long"), lambda s, x: s + x)
    copies = F.least(F.col("m") * F.col("n"), F.lit(k)).cast("int")
    scored = (touched.join(counted(queries, "query_id", "q", "m"), "query_id")
              .join(counted(candidates, "id", "c", "n"), "id").where("size(q) = size(c)")
              .select("query_id", "id", product.alias("score"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_"))
              .drop("_"))
    rest = found.join(touched, ["query_id", "id"], "left_anti").select("query_id", "id", "score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rest.unionByName(scored).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


# --------------------------------------------------------------------------
# vectors too long for products in longs


def _integers(raw: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as Python's integers: 1024 * x is exact, unless it overflows, and x is whole then."""
    with np.errstate(over="ignore"):
        whole = np.floor(raw * SCALE)
    return np.array([int(w) if np.isfinite(w) else int(x) * SCALE for x, w in zip(raw.ravel(), whole.ravel())],
                    dtype=object).reshape(raw.shape)


def _sortable(n: int) -> str:
    """A text that sorts like the integer."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + "".join(chr(105 - ord(c)) for c in digits)


def _meet(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, key) of the ``k`` best of every query among the candidates, both (id, raw), exactly, block by
    block; ``key`` sorts like the true score."""
    sizes = [max(1, math.ceil(df.count() / n)) for df, n in ((queries, 128), (candidates, 1024))]
    asked = queries.groupBy(F.size("raw").alias("dim"), F.pmod(F.xxhash64("id", "raw"), F.lit(sizes[0])).alias("q")).agg(
        F.collect_list(F.struct("id", "raw")).alias("asked"))
    asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sizes[1] - 1).cast("long"))))
    held = candidates.groupBy(F.size("raw").alias("dim"), F.pmod(F.xxhash64("id", "raw"), F.lit(sizes[1])).alias("c")).agg(
        F.collect_list(F.struct("id", "raw")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(*(batch.column(i).to_pylist() for i in range(2))):
                a, b = (_integers(np.array([r["raw"] for r in rows], float).reshape(len(rows), -1)) for rows in (asked, held))
                rows = []
                for query, vector in zip(asked, a):
                    scores = (b * vector).sum(axis=1).tolist() if b.shape[1] else [0] * len(held)
                    best = sorted((-s, r["id"]) for s, r in zip(scores, held) if r["id"] != query["id"])[:k]
                    rows += [(query["id"], i, max(-1 << 63, min((1 << 63) - 1, -s)), _sortable(-s)) for s, i in best]
                if rows:
                    q, i, s, key = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s, pa.int64()), pa.array(key)],
                                                     names=["query_id", "id", "score", "key"])
    return asked.join(held, ["dim", "c"]).select("asked", "held").mapInArrow(
        run, "query_id long, id long, score long, key string")


def search_all(rows: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` highest inner products of every row that meets ``queries`` (a condition on
    ``id``), among all rows of other ids. Repeated rows are rows of their own."""
    short = scaled(rows, id, vector)
    found = every_row(search(short.filter(queries), short, k), short.filter(queries), short, k)
    every = kept(rows, id, vector).withColumn("long", F.col("norm") >= LONGEST * 0.99)
    if every.filter("long").isEmpty():
        return found
    every = written(every.select("id", "raw", "long"), "vectors")
    long, ask = every.filter("long"), every.filter(queries)
    more = _meet(ask.filter("long"), every, k).unionByName(_meet(ask.filter("NOT long"), long, k))
    # products of short vectors fit a long, and so does their key
    text = F.abs("score").cast("string")
    key = F.when(F.col("score") >= 0, F.concat(F.lit("1"), F.lpad(F.length(text).cast("string"), 5, "0"), text)).otherwise(
        F.concat(F.lit("0"), (99999 - F.length(text)).cast("string"), F.translate(text, "0123456789", "9876543210")))
    both = found.select("query_id", "id", "score", key.alias("key")).unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "id")
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")
