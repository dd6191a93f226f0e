"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of word pairs, words and a uniform word:
p(w | h) = l2 c(h w) / c(h) + l1 c(w) / N + l0 / (V + 1). The weights depend on how often the
context h occurs (by powers of two) and are learned by expectation-maximisation: a part of the
training texts is deleted from the counts, and its tokens, counted by context frequency
and estimates, are what the weights make most likely. Scores then use the counts of all training texts.

How counts travel. Texts become a table of batches of about ``BATCH`` tokens: a sorted
vocabulary of 64-bit word hashes and tokens as places in it. A batch asks for each of its distinct words
and pairs once, with its own counts, in packed arrays by range of keys; the task of a
range adds up what all batches have and answers each. So the shuffles carry distinct keys of
batches, a frequent pair costs a few bytes per batch and never gathers the documents that have it, and
no task holds more than its range or one batch. Only the weights' histogram, some thousand
rows however large the corpus, reaches the driver.

Words are told apart by XXH64; two of a hundred million words collide with a chance of 1 in 3000.

Edge cases: a null text is empty: its only token is the end. Rows of equal id are scored one by
one. Without training rows all counts are zero. Without deleted rows, or for contexts unlike any deleted
one, the weights are those learned from all deleted tokens, or ``START`` at last. Empty
input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ARROW_ROWS, small_batches, written

BATCH = 1_000_000  # tokens of a batch, one text at least
RANGE = 1_000_000  # keys asked for in a range, about
START = (0.3, 0.6, 0.1)  # weights of pairs, words and the uniform word before learning
STEP = 0.25  # of a power of two, by which estimates are counted for learning
NEVER = 255  # stands for an estimate of zero there
ROUNDS = 60
SCORED, LEARNED, DELETED = 0, 1, 2  # roles of texts


def _packed(values: np.ndarray, kind: str) -> bytes:
    """An array as byte planes, compressed."""
    import zstandard

    values = np.ascontiguousarray(values, kind)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)), "<u8")


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key for a pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def tokenized(documents: DataFrame) -> DataFrame:
    """Batches (batch, deleted, ids, roles, sizes, vocabulary, tokens) of rows (id, text, role).

    Deleted texts have batches of their own. The end token is the hash of nothing.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        number = TaskContext.get().partitionId() << 32
        waiting = {False: ([], [], [], []), True: ([], [], [], [])}  # words, ids, roles, sizes

        def made(deleted: bool) -> pa.RecordBatch:
            nonlocal number
            words, ids, roles, sizes = waiting[deleted]
            waiting[deleted] = ([], [], [], [])
            coded = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode()
            hashes = np.fromiter((xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64,
                                 len(coded.dictionary))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            number += 1
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([deleted]), pa.array([ids], pa.list_(pa.int64())),
                pa.array([_packed(np.array(roles), "u1")]), pa.array([_packed(np.array(sizes), "<u4")]),
                pa.array([_packed_keys(hashes[order])]),
                pa.array([_packed(place[coded.indices.to_numpy()], "<u4")])],
                names=["batch", "deleted", "ids", "roles", "sizes", "vocabulary", "tokens"])
        for batch in batches:
            for id, text, role in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                mine = waiting[role == DELETED]
                words = (text.as_py() or b"").lower().split()  # for bytes: A-Z only, and ASCII white space
                words.append(b"")
                for new, have in zip((pa.array(words, pa.binary()), id, role, len(words)), mine):
                    have.append(new)
                if sum(mine[3][-256:]) >= BATCH or len(mine[3]) % 256 == 0 and sum(mine[3]) >= BATCH:
                    yield made(role == DELETED)
        for deleted, mine in waiting.items():
            if mine[1]:
                yield made(deleted)

    rows = documents.select(F.col("id").cast("long"), F.col("text").cast("binary"), F.col("role").cast("int"))
    return rows.mapInArrow(run, "batch long, deleted boolean, ids array<long>, roles binary, sizes binary, "
                                "vocabulary binary, tokens binary")


class Batch:
    """A row of the token table, opened."""

    def __init__(self, row: dict):
        self.ids, self.number, self.deleted = row["ids"], row["batch"], row["deleted"]
        self.roles, self.sizes = _unpacked(row["roles"], "u1"), _unpacked(row["sizes"], "<u4").astype(np.int64)
        self.vocabulary = _unpacked_keys(row["vocabulary"])
        self.tokens = _unpacked(row["tokens"], "<u4")
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.role = np.repeat(self.roles, self.sizes)  # of every token
        # the context of a text's first token is no word
        self.context = np.r_[np.uint32(0), self.tokens[:-1]].astype(np.int64)
        self.context[self.begins] = -1
        hashes = np.append(self.vocabulary, np.uint64(1))
        keys = _mixed(hashes[self.context], self.vocabulary[self.tokens])
        self.pairs, self.pair = np.unique(keys, return_inverse=True)

    def counts(self, places: np.ndarray, n: int, role: int) -> np.ndarray:
        return np.bincount(places[self.role == role], minlength=n)


def _asked(ranges: int):
    """For mapInArrow over batches: what each asks of each range of keys."""
    shift = np.uint64(64 - int(math.log2(ranges)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in some.to_pylist():
                b = Batch(row)
                out = []
                for kind, keys, places in ((1, b.vocabulary, b.tokens), (2, b.pairs, b.pair)):
                    learned = b.counts(places, len(keys), LEARNED)
                    deleted = b.counts(places, len(keys), DELETED)
                    part = keys >> shift if ranges > 1 else np.zeros(len(keys), np.uint64)
                    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(keys)]
                    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        out.append((int(part[i]), kind, b.number, b.deleted, _packed_keys(keys[i:j]),
                                    _packed(learned[i:j], "<u4"), _packed(deleted[i:j], "<u4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (
                        pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["range", "kind", "batch", "gone", "keys", "learned", "deleted"])
    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over requests sorted by range and kind: answers (batch, kind, range, learned, all), and one
    row with batch null per range and kind: the sums of distinct keys and of counts."""
    here, rows = None, []

    def finished() -> pa.RecordBatch:
        keys = [_unpacked_keys(r["keys"]) for r in rows]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([_unpacked(r[c], "<u4") for r in rows]), len(distinct)).astype(np.uint64)
                for c in ("learned", "deleted")]
        every = sums[0] + sums[1]
        ends = np.cumsum([len(k) for k in keys])
        out = [(None, here[1], here[0], None, None, int((every > 0).sum()), int(every.sum()), int(sums[0].sum()))]
        for r, a, b in zip(rows, ends - [len(k) for k in keys], ends):
            mine = back[a:b]
            out.append((r["batch"], here[1], here[0], _packed(sums[0][mine], "<u8") if r["gone"] else None,
                        _packed(every[mine], "<u8"), None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (
            pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
            names=["batch", "kind", "range", "learned", "every", "distinct", "total", "total_learned"])
    for batch in batches:
        for row in batch.to_pylist():
            if (row["range"], row["kind"]) != here:
                if rows:
                    yield finished()
                here, rows = (row["range"], row["kind"]), []
            rows.append(row)
    if rows:
        yield finished()


def _opened(batch: pa.Table, answers: pa.Table, column: str) -> tuple[Batch, np.ndarray, np.ndarray]:
    """A batch, and the counts of its words and pairs."""
    found: dict[int, list] = {1: [], 2: []}
    for row in sorted(answers.select(["kind", "range", column]).to_pylist(), key=lambda r: (r["kind"], r["range"])):
        found[row["kind"]].append(_unpacked(row[column], "<u8"))
    return Batch(batch.to_pylist()[0]), *(np.concatenate(found[k]).astype(np.float64) for k in (1, 2))


def _estimates(b: Batch, words: np.ndarray, pairs: np.ndarray, total: float, texts: float):
    """For every token: frequency of its context, and the estimates from pairs and from words."""
    context = np.append(words, texts)[b.context]
    with np.errstate(divide="ignore", invalid="ignore"):
        by_pair = np.where(context > 0, pairs[b.pair] / context, 0.0)
    return context, by_pair, words[b.tokens] / max(total, 1.0)


def _class(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the power of two below their frequency."""
    return np.frexp(context)[1]


def learn(counts: list[tuple[int, int, int, int]], uniform: float) -> np.ndarray:
    """Weights by class of context (64 rows) from counts (class, pair step, word step, n)."""
    def maximised(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        parts = np.stack([np.where(rows[:, 1] == NEVER, 0.0, 2.0 ** (-rows[:, 1] * STEP)),
                          np.where(rows[:, 2] == NEVER, 0.0, 2.0 ** (-rows[:, 2] * STEP)),
                          np.full(len(rows), uniform)], axis=1)
        for _ in range(ROUNDS):
            share = parts * weights
            share /= share.sum(axis=1, keepdims=True)
            weights = np.maximum((share * rows[:, 3:]).sum(axis=0) / rows[:, 3].sum(), 1e-6)
            weights /= weights.sum()
        return weights
    start = np.array(START)
    if not counts:
        return np.tile(start, (64, 1))
    rows = np.array(counts, float)
    general = maximised(rows, start)
    out = np.tile(general, (64, 1))
    for c in np.unique(rows[:, 0]).astype(int):
        out[c] = maximised(rows[rows[:, 0] == c], general)
    return out


def score(documents: DataFrame) -> DataFrame:
    """(id, role, n_tokens, n_known, train_tokens, base_score, score) of rows (id, text, role).

    ``role`` is SCORED for texts to be scored only, LEARNED, or DELETED for texts that are learned from, but
    left out of the counts while the weights are learned. All are scored.
    """
    spark = documents.sparkSession
    batch_rows = spark.conf.get(ARROW_ROWS)
    store = written(tokenized(documents), "tokens")
    small_batches(spark, 4)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in some.to_pylist():
                roles, size = _unpacked(row["roles"], "u1"), _unpacked(row["sizes"], "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([int(size.sum())]), pa.array(
                    [int((roles == LEARNED).sum())]), pa.array([int((roles == DELETED).sum())])], names=["n", "a", "b"])
    told = store.select("roles", "sizes").mapInArrow(sizes, "n long, a long, b long")
    tokens, learned, deleted = (x or 0 for x in told.agg(F.sum("n"), F.sum("a"), F.sum("b")).first())
    ranges = 1 << max(0, math.ceil(math.log2(max(1, tokens / RANGE))))
    requests = store.mapInArrow(_asked(ranges), "range int, kind int, batch long, gone boolean, keys binary, "
                                                "learned binary, deleted binary")
    answers = written(
        requests.repartition(max(ranges, spark.sparkContext.defaultParallelism), "range").sortWithinPartitions(
            "range", "kind", "batch").mapInArrow(
            _answered, "batch long, kind int, range int, learned binary, every binary, distinct long, total long, "
                       "total_learned long"), "counts")
    v, n, n_learned = (x or 0 for x in answers.filter("batch IS NULL AND kind = 1").agg(
        F.sum("distinct"), F.sum("total"), F.sum("total_learned")).first())
    uniform = 1.0 / (v + 1)
    answers = answers.filter("batch IS NOT NULL")

    def events(batch: pa.Table, found: pa.Table) -> pa.Table:
        b, words, pairs = _opened(batch, found, "learned")
        context, by_pair, by_word = _estimates(b, words, pairs, n_learned, learned)
        with np.errstate(divide="ignore"):
            steps = [np.where(p > 0, np.minimum(np.rint(-np.log2(p) / STEP), NEVER - 1), NEVER).astype(np.int64)
                     for p in (by_pair, by_word)]
        cells, count = np.unique((_class(context) << 16) | (steps[0] << 8) | steps[1], return_counts=True)
        return pa.table({"class": cells >> 16, "pair": cells >> 8 & 255, "word": cells & 255, "n": count})

    gone = store.filter("deleted").groupBy("batch").cogroup(
        answers.filter("learned IS NOT NULL").groupBy("batch")).applyInArrow(
        events, "class long, pair long, word long, n long")
    histogram = gone.groupBy("class", "pair", "word").agg(F.sum("n").alias("n")).collect()
    small_batches(spark, int(batch_rows))  # what is left comes by groups
    weights = learn(sorted(map(tuple, histogram)), uniform)

    def scored(batch: pa.Table, found: pa.Table) -> pa.Table:
        b, words, pairs = _opened(batch, found, "every")
        context, by_pair, by_word = _estimates(b, words, pairs, n, learned + deleted)
        mine = weights[_class(context)]
        p = mine[:, 0] * by_pair + mine[:, 1] * by_word + mine[:, 2] * uniform
        counts = words[b.tokens]

        def summed(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, b.begins)
        return pa.table({
            "id": pa.array(b.ids, pa.int64()), "role": pa.array(b.roles.astype(np.int32)), "n_tokens": b.sizes,
            "n_known": summed((counts > 0).astype(np.int64)), "train_tokens": np.full(len(b.ids), n, np.int64),
            "base_score": summed(np.log10((counts + 1) / (n + v + 1))), "score": summed(np.log10(p))})

    return store.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        scored, "id long, role int, n_tokens long, n_known long, train_tokens long, base_score double, score double")
