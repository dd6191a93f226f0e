"""Near-duplicate vectors within equal labels, by product quantisation with inverted lists.

Vectors are scaled to length 1. A coarse codebook parts the space into cells, and each (label, cell) is an inverted
list. What a vector differs from its cell's centre, its residual, is cut into parts, and the place of each part's nearest
codeword is a byte of the vector's code. The index holds every vector with its list, its code and ``loss``, the
distance between the residual and what the code stands for.

A pair of cosine c is sqrt(2 - 2c) apart, here called ``reach``, and each vector is on its own cell's side of the plane half-way
between the two centres. So one of the two is within half of ``reach`` of that plane, and every vector probes its own list
and those beyond such near planes: these probes are sufficient for all pairs. In a list, distances from a probing vector to
the codes come from a table of its distances to all codewords (asymmetric, by lookup). By the triangle inequality a
candidate is worth a look if its distance to the code is at most ``reach`` and its loss. What is left is reranked by
exact cosines in double precision. So nothing is lost, whatever the codebooks, which are trained on a bounded sample.

Equal vectors of a label are treated once, with a count. The lists of a label are laid out one after the other in blocks of
about ``BLOCK`` vectors; a large list takes several. A vector goes once to every block with a list that it probes, and
meets it in packets, so no list, label or group of copies is ever in one task. A block and a packet give counts by vector, and
links that span what is connected, never all pairs.

Edge cases: vectors that are null, without components, zero, or hold null or non-finite components, and those with a null label, link with nothing,
and are components of their own. Vectors meet only vectors of as many components. Rows of equal id are vectors of
their own, and equal rows link like any other copies. A null id becomes a component's id only if it has no other, and a row
without one is kept if it is alone or all of its component have none. Components of
any finite size are scaled exactly before lengths are taken. Empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import written
from basketry.llm.simhash import components

COSINE = 0.98
SAMPLE = 20_000  # vectors the codebooks are trained on, about
CELLS = 1024  # of the coarse codebook, at most
LIST = 1024  # vectors of a list of the largest label, about; more if that takes more cells
CODEWORDS = 64  # of each part
PARTS = 8
ROUNDS = 8  # of training
BLOCK = 4096  # vectors of a block of a list, about
PACKET = 512  # probing vectors that meet a block at once
SLACK = 1e-6  # by which bounds are widened; cosines this near to the limit are computed once more
DENSE = 0.05  # share of candidates from which on all cosines of a packet and a block are computed
SEED = 11


def classes(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The different vectors that may link, written: class (a number), label, vec, n (rows), least (id)."""
    x = F.col(vector).cast("array<double>")
    good = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    found = rows.filter(good).groupBy(F.col(label).alias("label"), x.alias("vec")).agg(
        F.count("*").alias("n"), F.min(id).alias("least"))
    return written(found.select(F.monotonically_increasing_id().alias("class"), "label", F.size("vec").alias("size"),
                                "vec", "n", "least"), "classes")


def units(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1; powers of two first, so that squares neither overflow nor vanish."""
    large = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = np.ldexp(vectors, -np.frexp(large)[1])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :], 0)


def _means(points: np.ndarray, k: int, rand: np.random.Generator) -> np.ndarray:
    """Centres of at most ``k`` groups of points."""
    centres = points[np.sort(rand.choice(len(points), min(k, len(points)), replace=False))]
    for _ in range(ROUNDS):
        near = _squares(points, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _cuts(size: int) -> list[int]:
    return np.linspace(0, size, min(PARTS, size) + 1).astype(int).tolist()


def trained(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """By number of components: the centres of the cells, and the codewords of each part. ``sample`` bounds the rows
    that are read for it, chosen by hash. A size that is not in the sample has one cell at the origin and one
    codeword, which is right, too, and only slower."""
    total, largest = vectors.groupBy("label", "size").count().agg(F.sum("count"), F.max("count")).first()
    share = min(1.0, sample / max(1, total or 0))
    chosen = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "class"), 11) < F.lit(int(share * 2 ** 53))
    found = vectors.filter(chosen).select("size", "vec").limit(2 * sample).collect()
    rand, out = np.random.default_rng(SEED), {}
    for size in sorted({r["size"] for r in found}):
        points = units(np.array([r["vec"] for r in found if r["size"] == size]))
        centres = _means(points, max(1, min(CELLS, largest // LIST, len(points) // 4)), rand)
        rest = points - centres[_squares(points, centres).argmin(axis=1)]
        cuts = _cuts(size)
        out[size] = centres, [_means(rest[:, a:b], CODEWORDS, rand) for a, b in zip(cuts, cuts[1:])]
    return out


def _model(models: dict, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = _cuts(size)
    return models.get(size) or (np.zeros((1, size)), [np.zeros((1, b - a)) for a, b in zip(cuts, cuts[1:])])


def coded(rest: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, losses) of residuals."""
    cuts = _cuts(rest.shape[1])
    codes = np.stack([_squares(rest[:, a:b], w).argmin(axis=1) for a, b, w in zip(cuts, cuts[1:], words)], axis=1)
    stands = np.concatenate([w[c] for w, c in zip(words, codes.T)], axis=1)
    return codes.astype(np.uint8), np.sqrt(((rest - stands) ** 2).sum(axis=1))


def looked_up(rest: np.ndarray, codes: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Distances from each residual to what each code stands for, from tables of distances to codewords."""
    cuts = _cuts(rest.shape[1])
    total = np.zeros((len(rest), len(codes)))
    for a, b, w, c in zip(cuts, cuts[1:], words, codes.T):
        total += _squares(rest[:, a:b], w)[:, c]
    return np.sqrt(total)


def planes(points: np.ndarray, home: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of every point to the plane between its own cell and each other; 0 for its own."""
    squares = _squares(points, centres)
    between = np.sqrt(_squares(centres, centres))[home]
    beyond = squares - squares[np.arange(len(points)), home][:, None]
    # equal centres have no plane between them
    return np.where(between > 0, np.maximum(beyond, 0) / (2 * np.where(between > 0, between, 1)), 0)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def index(vectors: DataFrame, models: dict, cosine: float = COSINE) -> DataFrame:
    """The inverted lists, written: class, label, size, n, vec (of length 1), cell, code, loss, and the cells to probe
    (``probes``, and as bits in ``near``)."""
    shared, reach = vectors.sparkSession.sparkContext.broadcast(models), reach_of(cosine)
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, vecs = batch.column(2).to_numpy(), _arrays(batch.column(4))
            for size in np.unique(sizes).tolist():
                centres, words = _model(shared.value, size)
                every = np.flatnonzero(sizes == size)
                for mine in np.split(every, range(1024, len(every), 1024)):
                    x = units(np.stack([vecs[i] for i in mine]))
                    home = _squares(x, centres).argmin(axis=1)
                    codes, loss = coded(x - centres[home], words)
                    near = planes(x, home, centres) <= reach / 2 + SLACK
                    near[np.arange(len(x)), home] = True
                    probes = pa.ListArray.from_arrays(
                        pa.array(np.r_[0, near.sum(axis=1).cumsum()].astype(np.int32)),
                        pa.array(np.nonzero(near)[1].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([
                        *batch.select([0, 1, 2, 3]).take(pa.array(mine)).columns,
                        pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(x.ravel())),
                        pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(loss), probes,
                        pa.array([b.tobytes() for b in np.packbits(near, axis=1)], pa.binary())],
                        names=["class", "label", "size", "n", "vec", "cell", "code", "loss", "probes", "near"])
    return written(vectors.select("class", "label", "size", "n", "vec").mapInArrow(
        run, f"class long, label {label}, size int, n long, vec array<double>, cell int, code binary, loss double, "
             "probes array<int>, near binary"), "index")


def reach_of(cosine: float) -> float:
    """How far apart vectors of length 1 with this cosine are."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def _spanning(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (of classes) that connect what the pairs ``near`` of ``a`` and ``b`` connect: of each to the first."""
    rows, columns = near.any(axis=1), near.any(axis=0)
    near, a, b = near[rows][:, columns], a[rows], b[columns]
    places, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    at_a, at_b = both[:len(a)], both[len(a):]
    names = np.arange(len(places))
    while len(a):
        new = names.copy()
        np.minimum.at(new, at_a, np.where(near, names[at_b][None, :], len(places)).min(axis=1))
        np.minimum.at(new, at_b, np.where(near, names[at_a][:, None], len(places)).min(axis=0))
        new = new[new]
        if (new == names).all():
            break
        names = new
    linked = np.flatnonzero(names != np.arange(len(places)))
    return places[linked], places[names[linked]]


def linked(x: np.ndarray, y: np.ndarray, candidates: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the candidate pairs have the cosine, from products in double precision."""
    if candidates.mean() > DENSE:
        product = x @ y.T
        sure, close = candidates & (product >= cosine + SLACK), candidates & (np.abs(product - cosine) < SLACK)
    else:
        sure, close = np.zeros_like(candidates), candidates
    i, j = np.nonzero(close)
    for k in range(0, len(i), 1 << 15):
        a, b = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
        sure[a, b] = np.einsum("pd,pd->p", x[a], y[b]) >= cosine
    return sure


def _met(models, cosine: float):
    """For mapInArrow over rows (number, block, guest, class, n, size, cell, own, vec, near, code, loss) sorted by the first
    three, guest false for the block's own: (class, n) for links counted, and (class, other) for links that span."""
    reach = reach_of(cosine)

    def gathered(parts: list[pa.RecordBatch]) -> dict:
        table = pa.Table.from_batches(parts).combine_chunks()
        found = {c: table.column(c).to_numpy() for c in ("class", "n", "cell", "own", "loss")}
        found["size"] = size = table.column("size")[0].as_py()
        found["vec"] = np.stack([v for c in table.column("vec").chunks for v in _arrays(c)])
        for name in ("near", "code"):
            raw = table.column(name).to_pylist()
            found[name] = raw[0] is not None and np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        cells = len(_model(models.value, size)[0])
        found["near"] = np.unpackbits(found["near"], axis=1)[:, :cells].astype(bool)
        return found

    def pairs(mine: dict, guests: dict, block: int) -> Iterator[pa.RecordBatch]:
        centres, words = _model(models.value, mine["size"])
        near = np.zeros((len(guests["class"]), len(mine["class"])), bool)
        for cell in np.unique(mine["cell"]):  # the lists of the block
            there, asking = np.flatnonzero(mine["cell"] == cell), np.flatnonzero(guests["near"][:, cell])
            if not len(asking):
                continue
            far = looked_up(guests["vec"][asking] - centres[cell], mine["code"][there], words)
            wanted = far <= reach + mine["loss"][there][None, :] + SLACK
            # of one list: each pair once, by blocks and then by classes
            same, own = (guests["cell"][asking] == cell)[:, None], guests["own"][asking][:, None]
            later = (own < block) | (own == block) & (guests["class"][asking][:, None] < mine["class"][there][None, :])
            # of two lists: in that of the smaller cell, if each probes the other's
            back = mine["near"][there][:, guests["cell"][asking]].T & (cell > guests["cell"][asking])[:, None]
            near[np.ix_(asking, there)] = wanted & np.where(same, later, ~back)
        if near.any():
            near = linked(guests["vec"], mine["vec"], near, cosine)
        if not near.any():
            return
        counts = np.concatenate([near @ mine["n"], guests["n"] @ near])
        names = np.concatenate([guests["class"], mine["class"]])
        yield out(names[counts > 0], counts[counts > 0], None)
        a, b = _spanning(near, guests["class"], mine["class"])
        yield out(a, None, b)

    def out(names, counts, other) -> pa.RecordBatch:
        none = pa.nulls(len(names), pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(names), none if counts is None else pa.array(counts), none if other is None else pa.array(other)],
            names=["class", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, residents, mine = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), keys.shape[1]]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key, guest = (keys[0, a], keys[1, a]), keys[2, a]
                if key != here:
                    here, residents, mine = key, [], None
                if not guest:
                    residents.append(batch.slice(a, b - a))
                    continue
                if mine is None:
                    mine, residents = gathered(residents), []
                for i in range(a, b, PACKET):
                    yield from pairs(mine, gathered([batch.slice(i, min(PACKET, b - i))]), int(here[1]))
    return run


def layout(lists: DataFrame) -> DataFrame:
    """Where the lists are, written: number, label, size, and by cell the first block and how many (``span``). A label has
    no more lists than there are cells."""
    sizes = lists.groupBy("label", "size", "cell").count()
    before = F.sum("count").over(Window.partitionBy("label", "size").orderBy("cell")) - F.col("count")
    first, last = F.floor(before / BLOCK), F.floor((before + F.col("count") - 1) / BLOCK)
    placed = sizes.select("label", "size", "cell", first.alias("first"), (last - first + 1).alias("span"))
    gathered = placed.groupBy("label", "size").agg(F.map_from_entries(F.collect_list(F.struct(
        "cell", F.struct("first", "span")))).alias("cells"), F.max("cell").alias("most"))
    by_cell = F.transform(F.sequence(F.lit(0), F.col("most")), lambda c: F.try_element_at("cells", c))
    return written(gathered.select(F.monotonically_increasing_id().alias("number"), "label", "size",
                                   by_cell.alias("at")), "layout")


def links(lists: DataFrame, models: dict, cosine: float = COSINE) -> DataFrame:
    """From an index: (class, n, other), written. ``n`` are rows of other classes linked with a class, to be summed, and
    the links to ``other`` connect exactly what links connect."""
    placed = lists.join(layout(lists), ["label", "size"])
    home = F.get("at", F.col("cell"))
    own = (home["first"] + F.pmod(F.xxhash64("class"), home["span"])).cast("int")
    blocks = F.array_distinct(F.flatten(F.transform(F.filter("probes", lambda c: F.get("at", c).isNotNull()), lambda c: F.sequence(
        F.get("at", c)["first"], F.get("at", c)["first"] + F.get("at", c)["span"] - 1))))
    values = ["class", "n", "size", "cell", "own", "vec", "near"]
    rows = placed.withColumns({"own": own, "blocks": blocks.cast("array<int>")})
    residents = rows.select("number", F.col("own").alias("block"), F.lit(False).alias("guest"), *values, "code", "loss")
    guests = rows.select("number", F.explode("blocks").alias("block"), F.lit(True).alias("guest"), *values,
                         F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("loss"))
    shared = lists.sparkSession.sparkContext.broadcast(models)
    met = residents.unionByName(guests).repartition("number", "block").sortWithinPartitions("number", "block", "guest")
    return written(met.mapInArrow(_met(shared, cosine), "class long, n long, other long"), "links")


def near_duplicates(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``rows``, which is read twice and should be a table."""
    vectors = classes(rows, id, vector, label)
    models = trained(vectors, sample)
    found = links(index(vectors, models, cosine), models, cosine)
    counts = found.filter("n IS NOT NULL").groupBy("class").agg(F.sum("n").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    rooted = vectors.select("class", "label", "vec", "n", "least").join(counts, "class", "left").join(
        roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = rooted.join(least, "root").select(
        F.col("label").alias("its"), "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    given = rows.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("own"))
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return given.join(told, (F.col("label") == F.col("its")) & (F.col("own") == F.col("vec")), "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))
