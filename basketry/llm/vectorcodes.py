"""Vectors compressed to short codes: each of ``PARTS`` parts of a vector becomes the place of the nearest entry
of that part's codebook, which is learned by k-means over all vectors, exactly, in integers.

Components are floor(scale * x). Vectors are gathered in chunks by the task that reads them, without a shuffle.
In a chunk the points of each part are sorted along a Hilbert curve and cut into flat blocks of ``BLOCK`` points; a block
stores its points, the least and greatest component of each (its box), and their sums. The chunks are written once.

In a round every block first compares its box with the codebook. An entry whose least distance to the box is
more than the greatest distance of another is out for the whole block. If one entry is left, the block's stored sums
are added to it, and no point is read. Otherwise the entries left, the block's shortlist, are compared with its points by
an exact kernel: products in doubles where all of them are below 2^52, in 64-bit integers where they are below 2^61, and in
Python's integers beyond. Blocks of equal shortlists go through the kernel together.

A round sends sums and counts by part and entry (of each task) through a shuffle, and from there 16 rows per part to the
driver. Codebooks are as small. Nothing is keyed by the data, so nothing is skewed.

Edge cases: vectors that are null or hold null or non-finite components are dropped. A part has a width of the number of
components over ``PARTS``, rounded up; missing components are zeros. Vectors of another number of components have codebooks
of their own, empty ones too. Rows of equal id are vectors of their own; as first entries they stand in
the order of their components, and null ids last. Fewer vectors than entries give smaller codebooks. Errors and their sums that a
long cannot hold are given as the greatest long. Empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import scratch_path, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CHUNK = 8192  # vectors, at most
VALUES = 1 << 20  # components of a chunk, at most, if it has several vectors
BLOCK = 32  # points
CURVE = 12  # components, of the most spread, that a Hilbert curve runs through
CURVE_BITS = 5
LONGEST = (1 << 63) - 1
INTS = "array<string>"  # integers of any size travel as decimal numbers


def integers(vectors: list[np.ndarray], scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of equal size, exactly: as 64-bit integers, or as objects if one is too large."""
    x = np.stack(vectors).astype(np.float64)
    with np.errstate(over="ignore"):
        wide = np.floor(x * scale)
    if not x.size or np.abs(wide).max() < 2.0 ** 62:
        return wide.astype(np.int64)
    exact = [[int(w) if np.isfinite(w) else int(v) * scale for v, w in zip(*rows)] for rows in zip(x, wide)]
    return np.array(exact, dtype=object)


def hilbert(points: np.ndarray) -> np.ndarray:
    """Places of the points along a Hilbert curve through a grid over their box."""
    if points.dtype == object:
        points = (points >> max(0, _most(points).bit_length() - 60)).astype(np.int64)
    low, high = points.min(axis=0), points.max(axis=0)
    spread = np.array([float(s) for s in high - low])
    axes = np.sort(np.argsort(-spread, kind="stable")[:CURVE])
    axes = axes[spread[axes] > 0]
    if not len(axes):
        return np.zeros(len(points), np.int64)
    cells = (points[:, axes] - low[axes]).astype(np.float64) / spread[axes] * ((1 << CURVE_BITS) - 1)
    x = [c for c in np.rint(cells).astype(np.int64).T.copy()]
    for level in range(CURVE_BITS - 1, 0, -1):  # turn and mirror the cube of each level
        inside = (1 << level) - 1
        for c in x:
            upper = (c >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ c) & inside)
            x[0] ^= np.where(upper, inside, swap)
            c ^= swap if c is not x[0] else 0
    for a, b in zip(x, x[1:]):  # Gray code
        b ^= a
    turn = np.zeros(len(points), np.int64)
    for level in range(CURVE_BITS - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    place = np.zeros(len(points), np.int64)
    for bit in range(CURVE_BITS - 1, -1, -1):
        for c in x:
            place = place << 1 | ((c ^ turn) >> bit & 1)
    return place


def _stored(values: np.ndarray) -> bytes:
    """Integers as bytes: of 4 or 8 bytes each, or as text."""
    if values.dtype == object:
        return b"t" + " ".join(map(str, values.ravel())).encode()
    small = not values.size or np.abs(values).max() < 2 ** 31
    return (b"4" if small else b"8") + values.astype("<i4" if small else "<i8").tobytes()


def _loaded(data: bytes) -> np.ndarray:
    if data[:1] == b"t":
        return np.array([int(x) for x in data[1:].split()], dtype=object)
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).astype(np.int64)


def _widened(values: np.ndarray, most: int, width: int) -> np.ndarray:
    """In a type in which sums of ``width`` squares of differences of values up to ``most`` are exact."""
    bound = 4 * max(1, width) * max(1, most) ** 2
    return values.astype(np.float64 if bound < 1 << 52 else np.int64 if bound < 1 << 61 else object)


def _most(*values: np.ndarray) -> int:
    return max((int(np.abs(v).max()) for v in values if v.size), default=0)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest entry, squared distance) of every point; of equal distances the first entry's."""
    most, width = _most(points, entries), points.shape[1]
    p, e = _widened(points, most, width), _widened(entries, most, width)
    squares = (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]
    at = squares.argmin(axis=1)
    found = squares[np.arange(len(points)), at]
    return at, found.astype(object if found.dtype == object else np.int64)


class Blocks:
    """The points of one part of a chunk in Hilbert order, in blocks, with boxes and sums."""

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.order, self.points, self.low, self.high, self.sums = order, points, low, high, sums
        self.begins = np.arange(0, len(order), BLOCK)
        self.counts = np.diff(np.r_[self.begins, len(order)])

    @classmethod
    def of(cls, points: np.ndarray) -> Blocks:
        order = np.argsort(hilbert(points), kind="stable")
        points = points[order]
        begins = np.arange(0, len(points), BLOCK)
        return cls(order, points, np.minimum.reduceat(points, begins), np.maximum.reduceat(points, begins),
                   np.add.reduceat(_summable(points), begins))

    def stored(self) -> dict:
        return {"order": self.order.astype("<i4").tobytes(), **{
            n: _stored(getattr(self, n)) for n in ("points", "low", "high", "sums")}}

    @classmethod
    def loaded(cls, row: dict) -> Blocks:
        order = np.frombuffer(row["order"], "<i4")
        blocks = -(-len(order) // BLOCK)
        return cls(order, _loaded(row["points"]).reshape(len(order), -1),
                   *(_loaded(row[n]).reshape(blocks, -1) for n in ("low", "high", "sums")))

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """For every block: the entries that may be nearest to a point in its box."""
        most = _most(self.low, self.high, entries)
        low, high, e = (_widened(x, most, entries.shape[1]) for x in (self.low, self.high, entries))
        below, above = low[:, None, :] - e[None, :, :], e[None, :, :] - high[:, None, :]
        outside = np.maximum(np.maximum(below, above), 0)
        across = np.maximum(np.abs(below), np.abs(above))
        least, greatest = (outside * outside).sum(axis=2), (across * across).sum(axis=2)
        return least <= greatest.min(axis=1)[:, None]

    def _together(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(blocks, places of entries) of equal shortlists."""
        lists, which = np.unique(self.shortlists(entries), axis=0, return_inverse=True)
        for i, mask in enumerate(lists):
            yield np.flatnonzero(which.ravel() == i), np.flatnonzero(mask)

    def _points_of(self, blocks: np.ndarray) -> np.ndarray:
        places = self.begins[blocks][:, None] + np.arange(BLOCK)[None, :]
        return places[places < np.repeat(self.begins[blocks] + self.counts[blocks], BLOCK).reshape(places.shape)]

    def sums_by_entry(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(sums, counts) of the points nearest to each entry, and how many points were read for it."""
        sums, counts, read = np.zeros(entries.shape, object), np.zeros(len(entries), np.int64), 0
        for blocks, short in self._together(entries):
            if len(short) == 1:
                sums[short[0]] += self.sums[blocks].sum(axis=0).astype(object)
                counts[short[0]] += self.counts[blocks].sum()
                continue
            places = self._points_of(blocks)
            read += len(places)
            points = self.points[places]
            at, _ = nearest(points, entries[short])
            for i in np.unique(at):
                mine = points[at == i]
                sums[short[i]] += _summable(mine).sum(axis=0).astype(object)
                counts[short[i]] += len(mine)
        return sums, counts, read

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every point, in the chunk's order."""
        code, error = np.empty(len(self.order), np.int64), np.empty(len(self.order), object)
        for blocks, short in self._together(entries):
            places = self._points_of(blocks)
            at, squares = nearest(self.points[places], entries[short])
            code[self.order[places]], error[self.order[places]] = short[at], squares
        return code, error


def _summable(points: np.ndarray) -> np.ndarray:
    """In a type in which the sum of a chunk's components is exact."""
    return points if points.dtype == object or _most(points) < 2 ** 40 else points.astype(object)


def kept(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vec) of the vectors that take part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(vector).isNotNull() & good).select(
        F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))


def chunks(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """The written chunks: size (components of a vector), ids, labels, and for every part its blocks."""
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("id", "label"))
    names = ["order", "points", "low", "high", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}  # by size: slices of batches, vectors

        def made(size: int) -> pa.RecordBatch:
            slices, vecs = waiting.pop(size)
            wide = integers(vecs, scale)
            width = -(-size // parts)
            padded = np.zeros((len(wide), width * parts), wide.dtype)
            padded[:, :size] = wide
            blocks = [Blocks.of(padded[:, p * width:(p + 1) * width]).stored() for p in range(parts)]
            ids, labels = (pa.concat_arrays([s.column(i) for s in slices]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([
                pa.array([size], pa.int32()),
                *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)),
                pa.array([blocks], pa.list_(pa.struct([(n, pa.binary()) for n in names])))],
                names=["size", "ids", "labels", "parts"])

        for batch in batches:
            column = batch.column(2)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            for size in np.unique(sizes).tolist():
                mine, most = np.flatnonzero(sizes == size), max(1, min(CHUNK, VALUES // max(1, size)))
                for some in np.split(mine, range(most, len(mine), most)):
                    have = waiting.setdefault(size, ([], []))
                    have[0].append(batch.select([0, 1]).take(pa.array(some)))
                    have[1].extend(values[offsets[i]:offsets[i + 1]] for i in some)
                    if len(have[1]) >= most:
                        yield made(size)
            while sum(size * len(have[1]) for size, have in waiting.items()) > 4 * VALUES:  # of many sizes
                yield made(max(waiting, key=lambda s: s * len(waiting[s][1])))
        for size in list(waiting):
            yield made(size)
    made = vectors.select("id", "label", "vec").mapInArrow(
        run, f"size int, ids array<{id_type}>, labels array<{label_type}>, "
             f"parts array<struct<{','.join(n + ':binary' for n in names)}>>")
    path = scratch_path(vectors.sparkSession, "chunks")
    made.write.option("parquet.block.size", 8 << 20).parquet(path)  # rows are large; readers hold a row group
    return vectors.sparkSession.read.schema(made.schema).parquet(path)


def first_entries(vectors: DataFrame, entries: int = ENTRIES, scale: int = SCALE,
                  parts: int = PARTS) -> dict[int, list[np.ndarray]]:
    """By size: a codebook for every part, the parts of the vectors of the smallest ids."""
    best = Window.partitionBy("size").orderBy(F.asc_nulls_last("id"), "vec")
    rows = vectors.withColumn("size", F.size("vec")).withColumn("n", F.row_number().over(best)).filter(
        F.col("n") <= entries).select("size", "n", "vec").collect()  # so many per size
    found: dict[int, list] = {}
    for size, _, vec in sorted(rows, key=lambda r: (r[0], r[1])):
        found.setdefault(size, []).append(np.array(vec, np.float64))
    out = {}
    for size, vecs in found.items():
        wide, width = integers(vecs, scale), -(-size // parts)
        padded = np.zeros((len(wide), width * parts), wide.dtype)
        padded[:, :size] = wide
        out[size] = [padded[:, p * width:(p + 1) * width] for p in range(parts)]
    return out


def advanced(table: DataFrame, codebooks: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """The codebooks after one more round over the chunks."""
    shared = table.sparkSession.sparkContext.broadcast(codebooks)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for size, parts in zip(*(batch.column(i).to_pylist() for i in range(2))):
                for p, row in enumerate(parts):
                    sums, counts, _ = Blocks.loaded(row).sums_by_entry(shared.value[size][p])
                    have = total.setdefault((size, p), [0, 0])
                    have[0], have[1] = have[0] + sums, have[1] + counts
        yield from _sums((size, p, e, counts[e], sums[e]) for (size, p), (sums, counts) in total.items()
                         for e in range(len(counts)) if counts[e])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for size, p, e, n, sums in zip(*(c.to_pylist() for c in batch.columns)):
                have = total.setdefault((size, p, e), [0, 0])
                have[0], have[1] = have[0] + n, have[1] + np.array([int(x) for x in sums], object)
        yield from _sums((*key, n, sums) for key, (n, sums) in total.items())
    schema = f"size int, part int, entry int, n long, sums {INTS}"
    rows = table.select("size", "parts").mapInArrow(added, schema).repartition("size", "part", "entry").mapInArrow(
        merged, schema).collect()
    out = {size: [_objects(c) for c in books] for size, books in codebooks.items()}
    for size, part, entry, n, sums in rows:
        out[size][part][entry] = [int(x) // n for x in sums]
    shared.unpersist()
    return {size: [_narrowed(c) for c in books] for size, books in out.items()}


def _objects(book: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in book], dtype=object).reshape(book.shape)


def _narrowed(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if _most(book) < 2 ** 62 else book


def _sums(rows) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    if rows:
        size, part, entry, n, sums = zip(*rows)
        yield pa.RecordBatch.from_arrays([
            pa.array(size, pa.int32()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
            pa.array([int(x) for x in n], pa.int64()), pa.array([[str(x) for x in s] for s in sums], pa.list_(pa.string()))],
            names=["size", "part", "entry", "n", "sums"])


def learned(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, scale: int = SCALE,
            parts: int = PARTS) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """The chunks of the vectors, and the codebooks by size."""
    table, books = chunks(vectors, scale, parts), first_entries(vectors, entries, scale, parts)
    for _ in range(rounds):
        books = advanced(table, books)
    return table, books


def digest(books: list[np.ndarray]) -> str:
    """Of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def encoded(table: DataFrame, codebooks: dict[int, list[np.ndarray]]) -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of all vectors in chunks; ``code`` has two hex digits a part, and
    ``error`` is a decimal."""
    shared = table.sparkSession.sparkContext.broadcast(codebooks)
    id_type, label_type = (table.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))
    most = 10 ** 38 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = {size: digest(books) for size, books in shared.value.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                size, parts = batch.column(0)[i].as_py(), batch.column(3)[i].as_py()
                found = [Blocks.loaded(row).assigned(book) for row, book in zip(parts, shared.value[size])]
                codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
                errors = [min(int(x), most) for x in sum(error for _, error in found)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(1)[i].values, batch.column(2)[i].values, pa.array([c.tobytes().hex() for c in codes]),
                    pa.array(errors, pa.decimal128(38, 0)), pa.array([digests[size]] * len(codes))],
                    names=["id", "label", "code", "error", "codebooks_sha256"])
    return table.select("size", "ids", "labels", "parts").mapInArrow(
        run, f"id {id_type}, label {label_type}, code string, error decimal(38,0), codebooks_sha256 string")


def compress(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
             rounds: int = ROUNDS, entries: int = ENTRIES, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of all vectors that take part."""
    table, books = learned(kept(rows, id, vector, label), rounds, entries, scale, parts)
    codes = written(encoded(table, books), "codes")
    total = codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))

    def as_long(name: str):
        limit = F.lit(LONGEST).cast("decimal(38,0)")
        return F.least(F.coalesce(name, limit), limit).cast("long").alias(name)
    return codes.join(total, codes["label"].eqNullSafe(total["of"])).select(
        "id", "label", "code", as_long("error"), as_long("label_error"), "codebooks_sha256")
