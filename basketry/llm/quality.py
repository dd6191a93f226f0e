"""Documents selected by importance: how much better a model of target text explains them
than a model of the raw corpus does.

Both models are bags of hashed n-grams: words and runs of punctuation, pairs of neighbours, and
one shared place for a word that follows itself. The target is a labelled sample: rows of good
quality that are not toxic, from at most ``sample`` labels; the raw model counts all documents. A
document's log weight is the log ratio of its probabilities under the two, a word on the mean, with its own
counts taken out of both, so that labelled and other documents are weighed alike. If one of its
passages has a lower ratio a word, the document has that one: a few words that the target
never uses would else be outweighed by the length of the rest.

Selection is importance resampling without replacement: Gumbel noise, from a hash of seed and id, is added to the log
weights over a temperature, and the k highest are taken. So documents are drawn one after the other with
probabilities in proportion to exp(log weight / temperature). The temperature is in log units a word; at the default
those about the cut are left to chance, and documents far from it are not. ``k`` may be given, as a number or as a share of all
documents; else it is the number of documents whose weight reaches a threshold, which is fitted on the labelled sample.

Only sums by place (a fixed number), the labelled sample, and histograms reach the driver. The
k-th highest value is found exactly by narrowing histograms over the written weights.

Edge cases: null and empty texts have weight 0. Several labels of a document: it is good if
all say so. Null ids have no labels. Without labels every document has weight 0 and is selected.
Documents with equal noisy weight at the edge (repeated rows) are all selected. All columns are kept;
added ones whose names are taken get underscores before them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import blocks, free_name, small_batches

PLACES = 1 << 17  # for words, and as many for pairs
SAMPLE = 50_000  # labels used, about
SMOOTHING = 2.0  # counts added to each place of both models, at the target's size
PASSAGE = 32  # words
LOWEST = -8.0  # weights from here down count as one in fitting the threshold
STEPS = 512  # weights told apart in fitting it, in a unit
TEMPERATURE = 0.02
LOSS = 30.0  # a lost good document weighs as much as so many kept bad ones
SEED = 61
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20\x7f0-9a-z\x80-\xff]+")
PIECE = 1 << 22  # bytes handled at once
REPEAT = 2 * PLACES  # the place of a word that follows itself


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of a whole text: the place of every word, and of every pair with the word before."""
    data, words, pairs, last = text.encode("utf-8", "replace").lower(), [], [], np.empty(0, np.uint32)
    begin = 0
    while begin < len(data):
        end = len(data) if len(data) - begin <= PIECE else data.rfind(b" ", begin + 1, begin + PIECE)
        end = end if end > 0 else begin + PIECE
        tokens = TOKEN.findall(data[begin:end])
        hashes = np.fromiter(map(crc32, tokens), np.uint32, len(tokens))
        words.append((hashes * np.uint32(0x9E3779B1)) >> np.uint32(15))
        chain = np.concatenate([last, hashes])
        mixed = (chain[:-1] * np.uint32(0x85EBCA77)) ^ (chain[1:] * np.uint32(0xC2B2AE3D))
        mixed = ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x2C1B3C6D)) >> np.uint32(15)
        pairs.append(np.where(chain[:-1] == chain[1:], REPEAT, mixed + PLACES))
        last, begin = chain[-1:], end
    none = [np.empty(0, np.int64)]
    return np.concatenate([*none, *words]).astype(np.int64), np.concatenate([*none, *pairs]).astype(np.int64)


def labelled(labels: DataFrame, id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(id, good) of about ``sample`` labelled documents, chosen by hash, or of all if they are fewer."""
    known = labels.filter(F.col(id).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    share = min(1.0, sample / max(1, known.count()))
    chosen = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), id), 11) < F.lit(int(share * 2 ** 53))
    return known.filter(chosen).groupBy(F.col(id).alias("\tid")).agg(
        ((F.min("quality") > 0) & (F.max("toxic") <= 0)).alias("\tgood"))


def with_labels(documents: DataFrame, known: DataFrame, id: str) -> DataFrame:
    """Documents with \\tgood: the label, or null. ``known`` is bounded by its sample."""
    return documents.join(F.broadcast(known), documents[id] == known["\tid"], "left").drop("\tid")


def fit(documents: DataFrame, known: DataFrame, id: str = "doc_id", text: str = "text") -> dict:
    """Counts by place of the target and of all documents."""
    small_batches(documents.sparkSession)
    rows = with_labels(documents.select(id, text), known, id).filter(F.col(text).isNotNull()).select(text, "\tgood")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(REPEAT + 1, np.int64), np.zeros(REPEAT + 1, np.int64)
        for batch in batches:
            for value, good in zip(batch.column(0), batch.column(1).to_pylist()):
                for places in features(value.as_py()):
                    place, n = np.unique(places, return_counts=True)
                    raw[place] += n
                    if good:
                        target[place] += n
        place = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(target[place]), pa.array(raw[place])], names=["place", "target", "raw"])

    counts = rows.mapInArrow(run, "place long, target long, raw long").groupBy("place").agg(
        F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()  # a row per place
    made = {k: np.zeros(REPEAT + 1) for k in ("target", "raw")}
    for k, n in made.items():
        n[counts["place"].to_numpy()] = counts[k].to_numpy()
    return made


def log_weight(model: dict, text: str, good: bool | None) -> float:
    """log p(text | target) - log p(text | raw), a word on the mean, without the text's own counts, or that of
    its passage with the least (there of single words), whichever is lower."""
    ratio = model["target"].sum() / max(1.0, model["raw"].sum())

    def each(places: np.ndarray) -> np.ndarray:
        place, back, n = np.unique(places, return_inverse=True, return_counts=True)
        target = np.maximum(model["target"][place] - (n if good else 0), 0)
        raw = np.maximum(model["raw"][place] - n, 0) * ratio
        return (np.log(target + SMOOTHING) - np.log(raw + SMOOTHING))[back]
    words, pairs = features(text)
    if not len(words) or not ratio:
        return 0.0
    ratios = each(words)
    total = np.r_[0.0, np.cumsum(ratios)]
    least = (total[PASSAGE:] - total[:-PASSAGE]).min(initial=np.inf) / PASSAGE
    return float(min((total[-1] + each(pairs).sum()) / len(words), least))


def weigh(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> DataFrame:
    """Documents with ``log_weight`` and ``labelled``: true for good, false for bad, or null."""
    spark = documents.sparkSession
    known = labelled(labels, id, sample)
    shared = spark.sparkContext.broadcast(fit(documents, known, id, text))
    weight, good = free_name(documents, "log_weight"), free_name(documents, "labelled")
    rows = with_labels(documents, known, id).withColumnRenamed("\tgood", good)
    schema = rows.withColumn(weight, F.lit(0.0)).schema
    place, label = rows.columns.index(text), rows.columns.index(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = dict(shared.value)
        for batch in batches:
            made = [log_weight(model, t.as_py() or "", g) for t, g in zip(
                batch.column(place), batch.column(label).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=schema.names)
    return rows.mapInArrow(run, schema)


def threshold(weighed: DataFrame, weight: str = "log_weight", good: str = "labelled", loss: float = LOSS) -> float:
    """The weight that parts good from bad labelled rows at the least cost, 0 at most.

    Minus infinity if no row is bad, or if the cut is below all weights told apart.
    """
    step = F.floor(F.least(F.greatest(F.col(weight), F.lit(LOWEST)), F.lit(0.0)) * STEPS)
    counts = weighed.filter(F.col(good).isNotNull()).groupBy(step.alias("step")).agg(
        F.count(F.when(F.col(good), 1)).alias("good"), F.count(F.when(~F.col(good), 1)).alias("bad")).collect()
    if not any(r["bad"] for r in counts):
        return float("-inf")
    counts = sorted((r["step"], r["good"], r["bad"]) for r in counts)
    goods, bads = max(1, sum(c[1] for c in counts)), max(1, sum(c[2] for c in counts))
    lost, kept, best = 0, bads, (float("inf"), 0.0)
    for step, n_good, n_bad in counts:
        best = min(best, (loss * lost / goods + kept / bads, step / STEPS))
        lost, kept = lost + n_good, kept - n_bad
    return best[1] if best[1] > LOWEST else float("-inf")


def kth_highest(rows: DataFrame, value: Column, k: int, gathered: int = 10_000) -> float:
    """The k-th highest value, exactly; ``rows`` is read once per step and should be a table."""
    values = rows.select(value.alias("x")).filter("x IS NOT NULL")
    low, high = values.agg(F.min("x"), F.max("x")).first()
    if low is None or k < 1:
        return float("inf")
    left = k  # wanted from low <= x <= high
    while True:
        part = values.filter((F.col("x") >= low) & (F.col("x") <= high))
        width = (high - low) / 1024
        if not low < low + width < high:
            return high if left <= part.filter(F.col("x") == high).count() else low
        step = F.least(F.floor((F.col("x") - low) / width), F.lit(1023))
        bins = sorted(((r["step"], r["n"], r["a"], r["b"]) for r in part.groupBy(step.alias("step")).agg(
            F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()), reverse=True)
        for _, n, a, b in bins:
            if left <= n:
                low, high = a, b
                break
            left -= n
        else:
            return low
        if n <= gathered:
            found = [r[0] for r in values.filter((F.col("x") >= low) & (F.col("x") <= high)).collect()]
            return sorted(found, reverse=True)[left - 1]
        if low == high:
            return low


def noisy(weight: Column, id: Column, seed: Column | int = SEED, temperature: float = TEMPERATURE) -> Column:
    """The log weight over the temperature with Gumbel noise that belongs to seed, id and weight."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    uniform = (F.shiftrightunsigned(F.xxhash64(seed, id, weight), 11) + F.lit(0.5)) / F.lit(2.0 ** 53)
    return weight / F.lit(float(temperature)) - F.log(-F.log(uniform))


def select(weighed: DataFrame, id: str = "doc_id", weight: str = "log_weight", good: str = "labelled",
           k: int | None = None, share: float | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """``weighed`` (a table) with ``key``, the noisy weight, and ``selected``: the ``k`` highest, or the given share of
    all rows, or as many as reach the threshold."""
    if k is None and share is not None:
        k = round(share * weighed.count())
    if k is None:
        k = weighed.filter(F.col(weight) >= threshold(weighed, weight, good)).count()
    key, selected = free_name(weighed, "key"), free_name(weighed, "selected")
    drawn = noisy(F.col(weight), F.col(id), seed, temperature)
    edge = kth_highest(weighed, drawn, k)
    return weighed.withColumn(key, drawn).withColumn(selected, F.col(key) >= F.lit(edge))
