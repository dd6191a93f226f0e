import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import quality


@pytest.fixture(scope="module")
def corpus(spark):
    rand = np.random.default_rng(6)
    words, bad = [f"w{i}" for i in range(300)], [f"slur{i}" for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        text = list(rand.choice(words, 80))
        kind = i % 4
        if kind == 2:
            text[10:14] = rand.choice(bad, 4)
        if kind == 3:
            text = [f"{w}***" for w in text[:40]] + ["again"] * 40
        rows.append((i, " ".join(text), "x"))
        if i % 3:
            labels.append((i, int(kind != 3), int(kind == 2)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "w1 w2 w3", "x"), (0, rows[0][1], "x")]
    labels += [(1, 1, 0), (2, None, 0), (None, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, key string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_weights_against_direct_counts(spark, corpus):
    docs, labels = corpus
    known = {r["\tid"]: r["\tgood"] for r in quality.labelled(labels).collect()}
    counts = {True: {}, False: {}}
    rows = docs.collect()
    for r in rows:
        for places in quality.features(r.text or ""):
            for p in places.tolist():
                counts[False][p] = counts[False].get(p, 0) + 1
                if known.get(r.doc_id):
                    counts[True][p] = counts[True].get(p, 0) + 1
    ratio = sum(counts[True].values()) / sum(counts[False].values())

    def direct(text, good):
        words, pairs = (x.tolist() for x in quality.features(text or ""))

        def each(places):
            return [np.log(max(counts[True].get(p, 0) - (places.count(p) if good else 0), 0) + quality.SMOOTHING)
                    - np.log(max(counts[False][p] - places.count(p), 0) * ratio + quality.SMOOTHING) for p in places]
        one = each(words)
        if not one:
            return 0.0
        passages = [sum(one[i:i + quality.PASSAGE]) / quality.PASSAGE for i in range(len(one) - quality.PASSAGE + 1)]
        return min([(sum(one) + sum(each(pairs))) / len(one), *passages])
    got = quality.weigh(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.isclose(r.log_weight, direct(r.text, r.labelled), atol=1e-9)


def test_selection(spark, corpus, tmp_path):
    docs, labels = corpus
    quality.weigh(docs, labels).write.parquet(f"{tmp_path}/w")
    weighed = spark.read.parquet(f"{tmp_path}/w")
    out = quality.select(weighed)
    assert out.columns[-2:] == ["_key", "selected"]
    rows = [r for r in out.collect() if r.doc_id is not None and r.doc_id < 400]
    share = [np.mean([r.selected for r in rows if (r.doc_id % 4 in kinds)]) for kinds in ((0, 1), (2,), (3,))]
    assert share[0] > 0.97 and share[1] < 0.2 and share[2] == 0.0
    fixed = quality.select(weighed, k=50).filter("selected").collect()
    keys = sorted((r["_key"] for r in out.collect()), reverse=True)
    assert len(fixed) == sum(k >= keys[49] for k in keys)


def test_kth_highest(spark):
    rand = np.random.default_rng(8)
    for values in (rand.normal(size=500) * 1e3, np.repeat(rand.normal(size=30), 40), np.ones(50), np.array([1.0, 1.0 + 2e-16 * 2])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        for k in (1, 2, len(values) // 2, len(values)):
            assert quality.kth_highest(df, F.col("v"), k, gathered=5) == sorted(values, reverse=True)[k - 1]


def test_without_labels_or_documents(spark, corpus):
    docs, labels = corpus
    got = quality.select(quality.weigh(docs, labels.limit(0)).cache()).collect()
    assert all(r.selected and r.log_weight == 0 for r in got)
    assert quality.weigh(docs.limit(0), labels).count() == 0


def test_threshold_keeps_very_low_good_rows(spark):
    """Weights at or below the lowest step, and labels without a bad row, set no cut."""
    def weighed(*rows):
        return spark.createDataFrame(rows, "doc_id long, log_weight double, labelled boolean")
    low = weighed((1, -900.0, True), (2, -600.0, True), (3, -2.0, True), (4, -1.0, False), (5, -800.0, None))
    assert quality.threshold(low) == float("-inf")
    assert all(r.selected for r in quality.select(low).collect())
    good = weighed((1, -3.0, True), (2, -9.0, None))
    assert quality.threshold(good) == float("-inf")
    assert all(r.selected for r in quality.select(good).collect())


def test_frequencies_follow_the_weights(spark):
    """Over many seeds documents are drawn one after the other, each with a chance in proportion to exp(weight / temperature)."""
    weights, temperature, seeds = [-0.5, -0.4, -0.3, -0.3, 0.0, 0.1], 0.2, 4000
    rows = spark.createDataFrame(list(enumerate(weights)), "doc_id long, w double")
    keys = rows.join(spark.range(seeds).withColumnRenamed("id", "seed")).select(
        "seed", "doc_id", quality.noisy(F.col("w"), F.col("doc_id"), F.col("seed"), temperature).alias("key"))
    drawn = keys.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("key", "doc_id")), asc=False).alias("order")).select(
        F.col("order.doc_id").alias("order")).collect()
    chance = np.exp(np.array(weights) / temperature)
    chance /= chance.sum()
    first = np.bincount([r.order[0] for r in drawn], minlength=6) / seeds
    assert np.abs(first - chance).max() < 4 * 0.5 / np.sqrt(seeds)
    second = sum(np.where(np.arange(6) == i, 0, chance[i] * chance / (1 - chance[i])) for i in range(6))
    both = np.bincount([i for r in drawn for i in r.order[:2]], minlength=6) / seeds
    assert np.abs(both - chance - second).max() < 4 * 0.5 / np.sqrt(seeds)


def test_seeds_and_temperature_decide(spark):
    """Other seeds select other documents; the cooler, the more of the highest weights; a share is a number of rows."""
    rows = spark.createDataFrame([(i, i / 500, None) for i in range(500)], "doc_id long, log_weight double, labelled boolean")

    def selected(**more):
        return {r.doc_id for r in quality.select(rows, share=0.2, **more).filter("selected").collect()}
    warm, other, cold = selected(temperature=0.5), selected(temperature=0.5, seed=5), selected(temperature=1e-6)
    assert len(warm) == len(other) == 100 and len(warm & other) < 80
    assert cold == set(range(400, 500)) and 100 > len(selected(temperature=0.05) & cold) > len(warm & cold)
