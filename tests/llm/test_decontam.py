import pytest
from pyspark.sql import functions as F

from basketry.llm import decontam

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
PASSAGE = " ".join(WORDS)


@pytest.fixture()
def benchmark(spark):
    return spark.createDataFrame(
        [(1, PASSAGE), (2, "short item"), (3, None), (4, "..."), (None, "a clean text"), (5, PASSAGE)],
        "item_id long, text string")


@pytest.fixture()
def documents(spark):
    return spark.createDataFrame([
        (1, "Intro words here. " + PASSAGE.upper().replace(" ", ", ") + ". And the end, one two three four five.", "x"),
        (2, PASSAGE, None), (3, None, "x"), (4, "", "x"), (5, f"... {PASSAGE} t u a b c d e f g h i j k l m n", "x"),
        (6, "a clean text", "x"), (7, "x y short item z a b c d e f", "x"), (8, "one two " + " ".join(WORDS[:9]), "x"),
        (8, "short item" + " w" * 20_000 + " short item", "x"), (None, "ärger short item é", "x")],
        "doc_id long, text string, hits string")


@pytest.mark.parametrize("bound", [50_000, 2])
def test_hits_items_and_cut_texts(spark, documents, benchmark, bound):
    windows = decontam.windows_of(benchmark).cache()
    found = decontam.find(documents, windows, bound=bound)
    rows = {(r.doc_id, r.n_words): [(h.at, h["size"]) for h in r["_hits"]] for r in found.collect()}
    assert rows[1, 22] == [(3, 10), (4, 10)] and rows[2, 11] == [(0, 10), (1, 10)]
    assert rows[7, 11] == [(2, 2)] and rows[8, 20_004] == [(0, 2), (20_002, 2)] and rows[None, 4] == [(1, 2)]
    assert all(rows[k] == [] for k in ((3, 0), (4, 0), (6, 3), (8, 11)))
    covered = {r[0]: r[1] for r in found.select("n_words", decontam.covered(F.col("_hits"))).collect()}
    assert covered[22] == 11 and covered[20_004] == 4
    named = decontam.name_items(found.select("doc_id", F.col("_hits").alias("hits")), windows, bound)
    items = {(r.doc_id, len(r.hits)): r["items"] for r in named.collect()}
    assert items[1, 2] == ["1", "5"] and items[7, 1] == ["2"] and items[6, 0] == [] and len(items) >= 9

    cleaned = decontam.clean(documents, benchmark, bound=bound)
    assert cleaned.columns == documents.columns
    by_id = [(r.doc_id, r.text) for r in cleaned.collect()]
    assert (1, "Intro words here. And the end, one two three four five.") in by_id
    assert not [r for r in by_id if r[0] == 2]  # all of it was a passage
    assert (3, None) in by_id and (4, "") in by_id and (6, "a clean text") in by_id
    assert (7, "x y z a b c d e f") in by_id and (5, "... t u a b c d e f g h i j k l m n") in by_id
    assert (8, ("w " * 20_000)) in by_id


def test_empty_tables(spark, documents, benchmark):
    none = benchmark.limit(0)
    assert decontam.clean(documents, none).count() == documents.count()
    assert decontam.clean(documents.limit(0), benchmark).count() == 0
