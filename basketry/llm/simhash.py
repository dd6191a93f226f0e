"""Near-duplicates by SimHash, found through deletion variants of segments.

Two fingerprints that differ in at most ``k`` bits are cut into k // 2 + 1
segments, so that some segment differs in one bit at most. Each segment is
indexed once for every bit left out of it: segments that differ in at most one bit
agree in one of these variants. Equal variants meet in a shuffle and are
verified on all 64 bits.

What is indexed are distinct fingerprints, so copies count once. A bucket of equal
variants is turned into links that span its components, never into all its
pairs. Buckets of more than ``crowd`` fingerprints are not gathered: their
members pass through to a second index with all ways of leaving out k of the 64 bits,
where every bucket is a clique and is linked to its first member while it streams by.
Each pair within k bits shares a bucket in the first index; if all buckets it shares are
crowded, both its members are in the second. So no link is lost at any size.

Components come from alternating star contractions of the links, each round
written to the shared folder.

Edge cases: texts without words (null and empty too) have fingerprint zero and
link like any other; fewer words than a shingle make one shingle of all; repeated
shingles count as often as they occur. Rows of equal id keep one row each. Null ids
are kept and never become a component's id unless it has no other. Empty input
gives empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import small_batches, written

SHINGLE = 3
DISTANCE = 2
SEED = 42
CROWD = 4096
PAIRED = 16  # runs up to this length are compared pair by pair, all at once


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: majority of the bits of its shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # for bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined, n = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(words) - n + 1].tolist()
    count, votes = len(starts), np.zeros(64, np.int64)
    ends = ends[n - 1:].tolist()
    for i in range(0, count, 8192):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(
            starts[i:i + 8192], ends[i:i + 8192])], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > count, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame, id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``id``, the columns in ``keep`` and ``fingerprint`` (64 bits as a long) per row."""
    small_batches(documents.sparkSession)
    kept = documents.select(*[F.col(f"`{c}`") for c in (id, *(keep or []))],
                            F.col(text).cast("binary").alias("\ttext"))
    schema = kept.drop("\ttext").withColumn("fingerprint", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(made, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return kept.mapInArrow(run, schema)


def _segments(k: int) -> list[tuple[int, int]]:
    """(first bit, width) of k // 2 + 1 segments of 64 bits."""
    cuts = np.linspace(0, 64, k // 2 + 2).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(prints: DataFrame, k: int = DISTANCE) -> DataFrame:
    """(key, fingerprint) for every segment and every bit left out of it."""
    places = []
    for s, (first, width) in enumerate(_segments(k)):
        for bit in range(first, first + width):
            mask = ((1 << width) - 1) << first & ~(1 << bit)
            places.append((bit * 16 + s, mask - (1 << 64) if mask >> 63 else mask))
    table = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(mask).alias("mask")) for code, mask in places])
    keys = F.transform(table, lambda p: F.xxhash64(p["code"], F.col("fingerprint").bitwiseAND(p["mask"])))
    return prints.select(F.explode(keys).alias("key"), "fingerprint")


def _spanning(prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) that connect what is connected within ``k`` bits."""
    n = len(prints)
    labels, rows = np.arange(n), max(1, 2 ** 20 // n)
    while True:
        new = np.concatenate([
            np.where(np.bitwise_count(prints[i:i + rows, None] ^ prints[None, :]) <= k, labels, n).min(axis=1)
            for i in range(0, n, rows)])
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    member = np.flatnonzero(labels != np.arange(n))
    return prints[member], prints[labels[member]]


def _links_of_runs(keys: np.ndarray, prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    begins, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
    size = np.repeat(ends - begins, ends - begins)
    a, b = [prints[:0]], [prints[:0]]
    short = np.flatnonzero((size > 1) & (size <= PAIRED))
    for step in range(1, PAIRED):
        here = short[short + step < len(keys)]
        here = here[keys[here] == keys[here + step]]
        if not len(here):
            break
        close = here[np.bitwise_count(prints[here] ^ prints[here + step]) <= k]
        a.append(prints[close])
        b.append(prints[close + step])
    for i in np.flatnonzero(ends - begins > PAIRED):
        member, first = _spanning(prints[begins[i]:ends[i]], k)
        a.append(member)
        b.append(first)
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return both[0], both[1]


def _bucket_links(k: int, crowd: int):
    """For mapInArrow over (key, fingerprint) sorted by both: rows (a, b) for links,
    and (a, null) for members of crowded buckets, none of which is held in memory."""
    def out(a, b=None) -> pa.RecordBatch:
        a = pa.array(np.asarray(a, np.uint64).view(np.int64))
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.asarray(b, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, crowded = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            if crowded is not None:  # the rest of a crowded bucket
                rest = int(np.searchsorted(keys, crowded, "right"))
                yield out(prints[:rest])
                keys, prints = keys[rest:], prints[rest:]
                if not len(keys):
                    continue
                crowded = None
            last = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            if len(keys) - last > crowd:
                crowded = keys[-1]
                yield out(prints[last:])
            done_keys, done = keys[:last], prints[:last]
            if last:
                yield from finished(done_keys, done)
            keys, prints = (keys[:0], prints[:0]) if crowded is not None else (keys[last:], prints[last:])
        if len(keys):
            yield from finished(keys, prints)

    def finished(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        size = np.diff(np.r_[0, cuts, len(keys)])
        large = np.repeat(size > crowd, size)
        if large.any():
            yield out(prints[large])
        if not large.all():
            yield out(*_links_of_runs(keys[~large], prints[~large], k))
    return run


def _cliques(k: int):
    """For mapInArrow over fingerprints: (code, value, fingerprint) for all ways of
    leaving out ``k`` bits."""
    masks = np.array([~np.uint64(sum(1 << b for b in bits)) for bits in combinations(range(64), k)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.arange(len(masks), dtype=np.int32)
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), 128):
                some = every[i:i + 128]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(codes, len(some))),
                    pa.array((some[:, None] & masks[None, :]).ravel().view(np.int64)),
                    pa.array(np.repeat(some, len(masks)).view(np.int64))], names=["code", "value", "fingerprint"])
    return run


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (code, value, fingerprint) sorted: links of every row to the first of its bucket."""
    bucket = hub = None
    for batch in batches:
        code, value, prints = (batch.column(i).to_numpy() for i in range(3))
        if not len(code):
            continue
        new = np.r_[(code[0], value[0]) != bucket, (np.diff(code) != 0) | (np.diff(value) != 0)]
        first = np.where(new, np.arange(len(new)), -1)
        first = np.maximum.accumulate(first)
        hubs = np.where(first >= 0, prints[np.maximum(first, 0)], hub if hub is not None else 0)
        linked = prints != hubs
        bucket, hub = (code[-1], value[-1]), hubs[-1]
        both = np.unique(np.stack([prints[linked], hubs[linked]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def links(prints: DataFrame, k: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints; together they connect exactly the
    fingerprints connected by steps of at most ``k`` bits."""
    spark = prints.sparkSession
    small_batches(spark, 65536)
    found = written(variants(prints, k).repartition("key").sortWithinPartitions("key", "fingerprint")
                    .mapInArrow(_bucket_links(k, crowd), "a long, b long"), "links")
    crowded = found.filter("b IS NULL").select(F.col("a").alias("fingerprint")).distinct()
    cliques = crowded.mapInArrow(_cliques(k), "code int, value long, fingerprint long")
    more = cliques.repartition("code", "value").sortWithinPartitions("code", "value", "fingerprint").mapInArrow(
        _star, "a long, b long")
    return found.filter("b IS NOT NULL").unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's
    smallest node. Alternates large and small stars until nothing changes."""
    def pairs(u: str, v: str, df: DataFrame) -> DataFrame:
        return df.select(F.col(u).alias("u"), F.col(v).alias("v"))

    edges = written(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(pairs("v", "u", edges))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            pairs("u", "m", low)).filter("u <> v").distinct()
        edges = written(small, "edges")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def group(documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
          k: int = DISTANCE, crowd: int = CROWD, keep: list[str] | None = None) -> DataFrame:
    """``id``, ``keep``, ``fingerprint``, ``root`` and ``component_id`` for every row:
    the smallest id that can be reached by steps of at most ``k`` bits."""
    rows = written(fingerprints(documents, id, text, shingle, keep), "fingerprints")
    # everything up to the last join is by distinct fingerprint, so copies count once
    prints = written(rows.groupBy("fingerprint").agg(F.min(id).alias("least")), "prints")
    found = components(links(prints.select("fingerprint"), k, crowd))
    rooted = prints.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(least, "root").select("fingerprint", "root", "component_id"), "named")
    # nothing later relies on how this join deals its rows, so a large group of copies is split at run time
    return rows.join(named, "fingerprint")


def one_of_each(documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                k: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Of every component one row with all its columns: that of the smallest id; of
    several with it, and of rows without ids, the one with the smallest hash."""
    hashed = [F.col(f"`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = documents.withColumn("\thash", F.xxhash64(*hashed))
    rows = group(marked, id, text, shingle, k, crowd, keep=["\thash"])
    order = F.struct(F.col(id).isNull().alias("no_id"), F.col(id).alias("id"), F.col("\thash").alias("hash"))
    chosen = rows.groupBy("root").agg(F.min(order).alias("row")).select("row.id", "row.hash")
    kept = marked.join(chosen, marked[id].eqNullSafe(chosen["id"]) & (marked["\thash"] == chosen["hash"]), "left_semi")
    if rows.groupBy(id, "\thash").count().filter("count > 1").limit(1).count():  # rows that are equal throughout
        kept = kept.dropDuplicates([id, "\thash"])
    return kept.drop("\thash")
