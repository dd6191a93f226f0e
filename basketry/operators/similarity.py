"""Similar users and items: given pairs, and nearest vectors."""

from __future__ import annotations

import sys
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import cosine, norm
from basketry.operators.ranking import top_n_per_group
from basketry.session import cut_lineage, scratch_path, spread

# executors get these functions with the job and need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGITS = 9  # scores this close count as equal, and the lower id goes first
SLICE = 1 << 20  # scores, or components of visiting vectors, that a task holds at a time
BLOCK_BYTES = 48 << 20  # of the vectors of a block in double precision, where all blocks meet
TILE = (256, 1024)  # rows and columns of products worked out at a time, so that they stay in a core's cache


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of each given pair (a, b); 0 if a vector is missing or zero."""
    left = vectors.select(F.col("id").alias("a"), F.col("vector").alias("_va"))
    right = vectors.select(F.col("id").alias("b"), F.col("vector").alias("_vb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").select(
        "a", "b", cosine(F.col("_va"), F.col("_vb")).alias("similarity"))


def similar_items(vectors: DataFrame, k: int = 10, targets: DataFrame | None = None,
                  **blocking: int) -> DataFrame:
    """The ``k`` nearest items by cosine for each target (default: each item).

    ``vectors`` and ``targets`` have id and vector. Vectors without length have no direction, and those with a
    component that is null or not finite none that is known: they take no part.
    """
    candidates = unit_vectors(vectors)
    found = nearest(unit_vectors(targets) if targets is not None else candidates, candidates, k, **blocking)
    return found.withColumnRenamed("score", "similarity")


def finite_vectors(df: DataFrame) -> DataFrame:
    """Rows whose vector has only known, finite components."""
    return df.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))))


def unit_vectors(df: DataFrame) -> DataFrame:
    """id and vector, scaled to length 1; rows whose vector has no direction go."""
    length = norm(F.col("vector"))
    return finite_vectors(df).where(length > 0).select("id", F.transform("vector", lambda x: x / length).alias("vector"))


def best_candidates(
    users: DataFrame, candidates: DataFrame, k: int = 10, same_ids: bool = False, **blocking: int,
) -> DataFrame:
    """The ``k`` candidates with the highest dot product for each user.

    Each candidate gets one more coordinate that brings all to the same
    length, the user gets a zero there; the nearest vectors are then the ones
    with the highest dot product.
    """
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    users, candidates = finite_vectors(users), finite_vectors(candidates)
    longest = candidates.agg(F.max(squares)).first()[0] or 0.0
    pad = F.array(F.sqrt(F.greatest(F.lit(longest) - squares, F.lit(0.0))))
    padded = candidates.select("id", F.concat("vector", pad).alias("vector"))
    asked = users.select("id", F.concat("vector", F.array(F.lit(0.0))).alias("vector"))
    return nearest(asked, padded, k, same_ids=same_ids, **blocking)


def highest_products(asked: DataFrame, offered: DataFrame, k: int, widen=None, block_rows: int | None = None,
                     extra=None) -> DataFrame:
    """The ``k`` of ``offered`` with the highest dot product for each of ``asked``, all compared: source_id, neighbor_id,
    score, rank. Rows have id (unique) and vector, finite and of one length.

    Each side is packed into rows of ``BLOCK_BYTES`` of vectors, which are written once. Every pair of blocks meets in a
    cartesian product, which reads both and shuffles neither; a task has a block of the asked and most blocks of the other
    side, and gives its ``k`` best, so what goes to disk grows with the number of vectors alone. ``widen`` is a pair of
    functions that make the vectors to be multiplied of a block's rows, where these are longer than what has to be sent.

    ``extra``, three functions, asks for a second list each, marked by the column ``added``: by the product and that of what the
    first two make of the asked and the offered; the third tells the most that can add to an asked one's products.
    """
    first = offered.select(F.size("vector")).first()
    rows = block_rows or max(1024, BLOCK_BYTES // (8 * max(first[0], 1)) if first else 0)
    if widen:  # longer vectors, in both precisions
        rows = max(1024, rows // 4)
    count, tasks = asked.count(), 2 * asked.sparkSession.sparkContext.defaultParallelism
    held = max(1, -(-offered.count() // rows))
    # smaller ones of the asked, as many as keep all cores busy
    number = max(1, -(-count // rows), min(-(-count // 1024), tasks))
    left, right = _packed(asked, "q", number), _packed(offered, "c", held)
    to_left, to_right = widen or (None, None)

    def best_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[_Best]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                asked, held = (_Packed.of(batch, name, i) for name in "qc")
                block = batch["qblock"][i].as_py()
                bests = found.setdefault(block, [_Best(asked.ids, k) for _ in range(2 if extra else 1)])
                _add(bests, asked, held, to_left, to_right, extra)
        for bests in found.values():
            for added, best in enumerate(bests):
                rows = best.table()
                if extra:
                    rows = rows.append_column("added", pa.array([bool(added)] * rows.num_rows, pa.bool_()))
                yield from rows.to_batches()

    schema = f"{_fields(asked.withColumnRenamed('id', 'qid'), ['qid'])}, {_fields(offered.withColumnRenamed('id', 'cid'), ['cid'])}, score double{', added boolean' if extra else ''}"
    marks = ["added"] if extra else []
    met = left.hint("shuffle_replicate_nl").crossJoin(right)
    # neighbouring partitions have the same block of the asked
    met = met.coalesce(max(number, min(number * held, tasks)))
    return top_n_per_group(met.mapInArrow(best_of_blocks, schema), ["qid", *marks], [F.desc("score"), F.asc("cid")], k).select(
        F.col("qid").alias("source_id"), F.col("cid").alias("neighbor_id"), "score", "rank", *marks)


def _packed(df: DataFrame, side: str, number: int) -> DataFrame:
    """One row per block of rows: its number, the ids, and the components of all vectors one after the other."""
    def pack(rows: pa.Table) -> pa.Table:
        return pa.table({
            name: values if name == f"{side}block" else pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            for name, values in ((f"{side}block", rows["block"].slice(0, 1)), (f"{side}ids", rows["id"].combine_chunks()),
                                 (f"{side}vectors", _lists(rows["vector"]).flatten()))})

    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = (f"{side}block int, {side}ids array<{kinds['id'].simpleString()}>, "
              f"{side}vectors {kinds['vector'].simpleString()}")
    blocks = df.select(F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias("block"), "id", "vector")
    path = scratch_path(df.sparkSession, "blocks")
    # a file each: a writer holds one block at a time
    packed = blocks.groupBy("block").applyInArrow(pack, schema)
    packed.write.option("maxRecordsPerFile", 1).parquet(path)
    return df.sparkSession.read.schema(packed.schema).parquet(path)


# --------------------------------------------------------------------------
# nearest vectors


@dataclass(frozen=True)
class _Cells:
    """Reference vectors and what is known about the candidates around each."""

    centers: pd.DataFrame        # one vector per cell
    nearest: np.ndarray          # smallest candidate distance in the cell
    farthest: np.ndarray         # largest candidate distance in the cell
    close_by: list[np.ndarray]   # the smallest few distances in the cell
    blocks: np.ndarray           # blocks the candidates of the cell are cut into


class _Rows:
    """The vectors of a batch."""

    def __init__(self, batch: pd.DataFrame):
        self.full = np.vstack(batch["vector"].to_numpy()).astype(float)

    def dot(self, other: _Rows) -> np.ndarray:
        return self.full @ other.full.T

    def squares(self) -> np.ndarray:
        return (self.full ** 2).sum(1)

    def distances(self, other: _Rows) -> np.ndarray:
        squared = self.squares()[:, None] + other.squares()[None, :] - 2.0 * self.dot(other)
        return np.sqrt(np.maximum(squared, 0.0))


def nearest(
    queries: DataFrame, candidates: DataFrame, k: int, same_ids: bool = True,
    block_rows: int = 2048, cells_per_root: float = 0.5,
) -> DataFrame:
    """Exact top ``k`` candidates by dot product for every query.

    Rows have id and vector, an array of finite doubles. All candidate vectors must
    have the same length, so the highest dot product is the smallest distance.
    Returns source_id, neighbor_id, score, rank.

    Equal vectors are treated once: any query ranks their rows together, by id,
    so only the first few ids can be in a result. Distinct candidates fall into
    cells around reference vectors. Distances to those vectors bound, for each
    query, how far its k-th neighbour can be and how near a cell can get; the
    query goes only to cells that can hold a neighbour. The number of cells grows
    with the root of the number of vectors, but a cell has a block's worth of them at least: a
    query is sent once per cell it visits. Cells and the queries that visit them
    are cut into blocks of about ``block_rows``, each task compares one block of
    both and returns k rows per query.
    """
    want = k + 1 if same_ids else k
    all_pairs = queries is candidates
    same = ["vector"]
    kept = top_n_per_group(candidates, same, [F.asc("id")], want, "_n").select(
        *same, F.col("id").alias("neighbor_id"))
    distinct = cut_lineage(candidates.groupBy(*same).agg(F.min("id").alias("cid")))
    total = distinct.count()
    if total == 0:
        return queries.select(
            F.col("id").alias("source_id"), F.col("id").alias("neighbor_id"),
            F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)

    count = min(math.ceil(cells_per_root * math.sqrt(total)), total // block_rows)
    centers = _pick_centers(distinct, max(1, count))
    placed = _place(distinct, centers)
    cells = _describe(placed, centers, want, block_rows)

    asked = (distinct.withColumnRenamed("cid", "qid") if all_pairs
             else cut_lineage(queries.groupBy(*same).agg(F.min("id").alias("qid"))))
    visits = _visits(spread(asked, "qid"), cells, want)
    visitors = _visits(spread(asked, "qid"), cells, want, counted=True)
    best = top_n_per_group(
        _compare(visits, visitors, asked, placed, want, cells, block_rows, total),
        ["qid"], [F.desc("score"), F.asc("cid")], want, "_r")

    # back from distinct vectors to rows
    kept_ids = _on_same_vector(kept, distinct).select("cid", "neighbor_id")
    members = _on_same_vector(queries, asked).select(F.col("id").alias("source_id"), "qid")
    short = top_n_per_group(
        best.join(kept_ids, "cid"), ["qid"], [F.desc("score"), F.asc("neighbor_id")], want, "_r")
    rows = members.join(short.select("qid", "neighbor_id", "score"), "qid")
    if same_ids:
        rows = rows.where(F.col("source_id") != F.col("neighbor_id"))
    return top_n_per_group(
        rows, ["source_id"], [F.desc("score"), F.asc("neighbor_id")], k).drop("qid")


def _on_same_vector(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "vector")


def _pick_centers(distinct: DataFrame, count: int) -> pd.DataFrame:
    """Seeded vectors, in proportion to the root of their number, to build cells on."""
    rows = distinct.orderBy(F.md5(F.col("cid").cast("string")), "cid").limit(count).collect()
    return pd.DataFrame({"vector": [r["vector"] for r in rows]}, dtype=object)


def _place(distinct: DataFrame, centers: pd.DataFrame) -> DataFrame:
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        around = _Rows(centers)
        for batch in batches:
            if len(batch):
                away = _Rows(batch).distances(around)
                cell = away.argmin(1)
                yield batch.assign(cell=cell.astype("int32"), away=away[np.arange(len(batch)), cell])

    columns = ["vector", "cid"]
    schema = f"{_fields(distinct, columns)}, cell int, away double"
    return cut_lineage(distinct.select(*columns).mapInPandas(assign, schema))


def _describe(placed: DataFrame, centers: pd.DataFrame, want: int, block_rows: int) -> _Cells:
    """Cell bounds: one small row per cell."""
    close = top_n_per_group(placed.select("cell", "away", "cid"), ["cell"],
                            [F.asc("away"), F.asc("cid")], want, "_n")
    close = close.groupBy("cell").agg(F.collect_list("away").alias("close_by"))
    rows = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far"),
    ).join(close, "cell").collect()
    size = len(centers)
    near, far = np.full(size, np.inf), np.full(size, -np.inf)
    blocks = np.zeros(size, dtype=int)
    close_by: list[np.ndarray] = [np.array([])] * size
    for r in rows:
        near[r["cell"]], far[r["cell"]] = r["near"], r["far"]
        blocks[r["cell"]] = -(-r["n"] // block_rows)
        close_by[r["cell"]] = np.array(r["close_by"])
    return _Cells(centers, near, far, close_by, blocks)


def _visits(asked: DataFrame, cells: _Cells, want: int, counted: bool = False) -> DataFrame:
    """Each query with every cell that can hold one of its neighbours; ``counted``: how many come to each cell, a row per
    cell and slice, without any vector."""
    filled = np.flatnonzero(cells.blocks > 0)
    offsets = np.concatenate([cells.close_by[c] for c in filled])
    owner = np.concatenate([np.full(len(cells.close_by[c]), c) for c in filled])
    far = float(np.max(cells.farthest[filled], initial=0.0))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        around = _Rows(cells.centers)
        each = max(1, SLICE // max(len(owner), 1))
        width = max(1, around.full.shape[1])
        for whole in batches:
            for start in range(0, len(whole), each):
                batch = whole.iloc[start:start + each]
                asked = _Rows(batch)
                away = asked.distances(around)
                reach = away[:, owner] + offsets[None, :]
                if reach.shape[1] >= want:
                    limit = np.partition(reach, want - 1, axis=1)[:, want - 1]
                else:
                    limit = np.full(len(batch), np.inf)
                gap = np.maximum(away - cells.farthest[None, :], cells.nearest[None, :] - away)
                # float error of a distance: relative to the lengths it comes from
                length = np.sqrt(max(asked.squares().max(), around.squares().max(), far ** 2))
                visit = (gap <= limit[:, None] + 1e-6 * (1 + length)) & (cells.blocks > 0)[None, :]
                if counted:
                    seen = visit.sum(axis=0)
                    yield pd.DataFrame({"cell": np.flatnonzero(seen).astype("int32"), "n": seen[seen > 0]})
                    continue
                row, cell = np.nonzero(visit)
                # a vector is repeated for every cell it visits, so the rows go out in small frames
                step = max(1, SLICE // width)
                for i in range(0, len(row), step):
                    yield batch.iloc[row[i:i + step]].assign(cell=cell[i:i + step].astype("int32"))

    columns = ["vector", "qid"]
    return asked.select(*columns).mapInPandas(choose, "cell int, n long" if counted else f"{_fields(asked, columns)}, cell int")


def _compare(visits: DataFrame, counted: DataFrame, asked: DataFrame, placed: DataFrame, want: int, cells: _Cells,
             block_rows: int, total: int) -> DataFrame:
    """Dot products block by block; the best ``want`` per query and block.

    The visits are worked out twice, once to count them: that costs less than
    storing every query once per visited cell.
    """
    visitors = {r["cell"]: r["n"] for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    found = sum(int(own) for own in cells.blocks)
    rows = max(block_rows, BLOCK_BYTES // (8 * max(1, len(cells.centers["vector"].iloc[0]))))
    if sum(visitors.values()) > asked.count() * max(1, -(-total // rows)) and found > 1:
        # most cells are visited: sending a vector once per large block is less
        best = highest_products(asked.select(F.col("qid").alias("id"), "vector"),
                                placed.select(F.col("cid").alias("id"), "vector"), want, block_rows=rows)
        return best.select(F.col("source_id").alias("qid"), F.col("neighbor_id").alias("cid"), "score")
    crowds = {cell: -(-n // block_rows) for cell, n in visitors.items()}
    plan = F.get(F.array(*[
        F.struct(F.lit(int(own)).alias("held"), F.lit(int(crowds.get(cell, 0))).alias("asked"))
        for cell, own in enumerate(cells.blocks)]), F.col("cell"))
    held_block = F.pmod(F.xxhash64("cid"), plan["held"]).cast("int")
    asked_block = F.pmod(F.xxhash64("qid"), plan["asked"]).cast("int")
    # every block of a cell's candidates meets every block of its visitors
    left = visits.select("cell", asked_block.alias("qb"), F.explode(
        F.sequence(F.lit(0), plan["held"] - 1)).alias("cb"), "qid", "vector")
    right = spread(placed, "cid").where(plan["asked"] > 0).select("cell", held_block.alias("cb"), F.explode(
        F.sequence(F.lit(0), plan["asked"] - 1)).alias("qb"), "cid", "vector")

    def best_in_block(asked: pa.Table, held: pa.Table) -> pa.Table:
        return _best_products(asked, held, want)

    keys = ["cell", "cb", "qb"]
    schema = f"{_fields(visits, ['qid'])}, {_fields(placed, ['cid'])}, score double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_in_block, schema)


def _lists(vectors: pa.ChunkedArray) -> pa.Array:
    lists = vectors.combine_chunks()
    if len(pc.unique(pc.list_value_length(lists))) > 1:
        raise ValueError("vectors of several lengths")
    return lists


@dataclass(frozen=True)
class _Packed:
    """Ids and vectors of a block: one row per vector, without an object for each."""

    ids: pa.Array
    vectors: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, side: str, row: int) -> _Packed:
        ids, flat = (batch[f"{side}{name}"][row].values for name in ("ids", "vectors"))
        return cls(ids, flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1))

    @classmethod
    def of_rows(cls, rows: pa.Table, key: str) -> _Packed:
        flat = _lists(rows["vector"]).flatten().to_numpy(zero_copy_only=False)
        return cls(rows[key].combine_chunks(), flat.reshape(rows.num_rows, -1))


class _Best:
    """The best of the blocks seen so far for each vector of one block: row of the vector, id and rounded score."""

    def __init__(self, ids: pa.Array, want: int):
        self.ids, self.want = ids, want
        self.least = np.full(len(ids), -np.inf)  # the last of the best so far
        self.row, self.cid, self.score = np.empty(0, int), None, np.empty(0)

    def add(self, asked: _Packed, held: _Packed) -> None:
        _add([self], asked, held)

    def merge(self, parts: list[tuple], held: _Packed) -> None:
        """Take in the best of another block, the lower id first among equal ones."""
        row, column, score = (np.concatenate(p) for p in zip(*parts))
        cid = held.ids.take(pa.array(column))
        if self.cid is None:
            self._keep(row, cid, score)
            return
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, score])
        cid = pa.concat_arrays([self.cid, cid])
        by = pa.table({"row": row, "score": score, "cid": cid})
        order = pc.sort_indices(by, sort_keys=[("row", "ascending"), ("score", "descending"), ("cid", "ascending")]).to_numpy()
        row = row[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < self.want
        self._keep(row[kept], cid.take(pa.array(order[kept])), score[order[kept]])

    def _keep(self, row: np.ndarray, cid: pa.Array, score: np.ndarray) -> None:
        self.row, self.cid, self.score = row, cid, score
        last = np.arange(len(row)) - np.searchsorted(row, row) == self.want - 1
        self.least[row[last]] = score[last]

    def table(self) -> pa.Table:
        return pa.table({"qid": self.ids.take(pa.array(self.row)), "cid": self.cid, "score": self.score})


def _add(bests: list[_Best], asked: _Packed, held: _Packed, to_left=None, to_right=None, extra=None) -> None:
    """Products in double precision of another block, for lists of the same rows: by the product, and by that and ``extra``."""
    others = held.vectors.astype(float, copy=False)
    others = others if to_right is None else to_right(others)
    place = np.empty(len(held.ids), dtype=np.int64)
    place[pc.sort_indices(held.ids).to_numpy()] = np.arange(len(held.ids))
    narrow, parts = others.astype(np.float32), [[] for _ in bests]
    reach = np.sqrt(np.einsum("ij,ij->i", others, others).max())
    right = extra[1](others) if extra else None
    each = max(1, min(TILE[0], SLICE // TILE[1]))
    for start in range(0, len(asked.ids), each):
        rows = asked.vectors[start:start + each].astype(float, copy=False)
        rows = rows if to_left is None else to_left(rows)
        founds = [_Found(rows, others, place, best.want, best.least[start:start + each]) for best in bests]
        if extra:
            founds[1].extra = (extra[0](rows), right, extra[2](rows))
        _look(rows, others, narrow, reach, founds)
        for part, found in zip(parts, founds):
            part.append((found.row + start, found.column, found.score))
    for best, part in zip(bests, parts):
        best.merge(part, held)


def _best_products(asked: pa.Table, held: pa.Table, want: int) -> pa.Table:
    """qid, cid and rounded score of the ``want`` best of ``held`` for each of ``asked``, lower cid first."""
    if not (asked.num_rows and held.num_rows):
        return pa.table({"qid": [], "cid": [], "score": pa.array([], pa.float64())})
    rows = _Packed.of_rows(asked, "qid")
    best = _Best(rows.ids, want)
    best.add(rows, _Packed.of_rows(held, "cid"))
    return best.table()


def _best_columns(rows: np.ndarray, others: np.ndarray, narrow: np.ndarray, reach: float, place: np.ndarray,
                  want: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of each row's ``want`` highest products, the lower ``place`` first among equal ones.
    Those below ``known``, a score per row, may be missing."""
    found = _Found(rows, others, place, want, known)
    _look(rows, others, narrow, reach, [found])
    return found.row, found.column, found.score


class _Found:
    """The best columns of some rows so far. Products in single precision tell which can be among them; those are taken again
    in double precision, some at a time."""

    def __init__(self, rows: np.ndarray, others: np.ndarray, place: np.ndarray, want: int, known: np.ndarray):
        self.rows, self.others, self.place, self.want = rows, others, place, want
        self.row, self.column, self.score = np.empty(0, int), np.empty(0, int), np.empty(0)
        self.least = known.copy()  # the last of the best so far
        self.extra: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # what adds to a product, and the most it can add
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def start(self, products: np.ndarray) -> None:
        """The last of the best among some of the columns is no better than that among all."""
        blank, step = np.isneginf(self.least), max(1, min(4, products.shape[1] // (4 * self.want)))
        if products.shape[1] > self.want and blank.any():
            sample = products[blank, ::step].astype(float)
            if self.extra:
                sample += self.extra[0][blank] @ self.extra[1][:products.shape[1]:step].T
            self.least[blank] = np.partition(sample, -self.want, axis=1)[:, -self.want]

    def offer(self, products: np.ndarray, highest: np.ndarray, first: int, slack: np.ndarray) -> None:
        bound = self.least - slack - (self.extra[2] if self.extra else 0.0)
        if products.dtype == np.float32:
            bound = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
        # few rows have a product that counts once the best so far are good
        hit = np.flatnonzero(highest >= bound)
        if len(hit) == 0:
            return
        r, c = np.divmod(np.flatnonzero(products[hit] >= bound[hit, None]), products.shape[1])
        self.waiting.append((hit[r], c + first))
        self.count += len(r)
        if self.count >= 8 * len(self.rows):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        r, c = (np.concatenate(part) for part in zip(*self.waiting))
        taken, step = np.empty(len(r)), max(1, (SLICE >> 2) // self.rows.shape[1])
        for i in range(0, len(r), step):
            at, to = r[i:i + step], c[i:i + step]
            taken[i:i + step] = np.einsum("ij,ij->i", self.rows[at], self.others[to])
            if self.extra:
                taken[i:i + step] += np.einsum("ij,ij->i", self.extra[0][at], self.extra[1][to])
        row, column = np.concatenate([self.row, r]), np.concatenate([self.column, c])
        score = np.concatenate([self.score, np.round(taken, DIGITS)])
        order = np.lexsort((self.place[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        position = np.arange(len(row)) - np.searchsorted(row, row)
        last = position == self.want - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], score[last])
        keep = position < self.want
        self.row, self.column, self.score = row[keep], column[keep], score[keep]
        self.waiting, self.count = [], 0


def _look(rows: np.ndarray, others: np.ndarray, narrow: np.ndarray, reach: float, founds: list[_Found]) -> None:
    """Offer the products of all rows and columns, tile by tile."""
    error = 1.2e-7 * (rows.shape[1] + 4) * np.sqrt((rows ** 2).sum(1)) * reach
    exact = not (np.isfinite(error).all() and max(np.abs(rows).max(), reach) < 1e15)
    if exact:
        error = np.zeros(len(rows))
    # what rounds to the same score as the last one in still counts
    slack = 2 * error + 1e-30 + 2 * 10.0 ** -DIGITS
    left, right = (rows, others) if exact else (rows.astype(np.float32), narrow)
    width = max(TILE[1], *[found.want for found in founds])
    room = np.empty((len(rows), width), left.dtype)  # one for all tiles
    for start in range(0, len(others), width):
        stop = min(start + width, len(others))
        products = np.matmul(left, right[start:stop].T, out=room if stop - start == width else None)
        highest = products.max(axis=1)
        for found in founds:
            if start == 0:
                found.start(products)
            found.offer(products, highest, start, slack)
    for found in founds:
        found.settle()


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
