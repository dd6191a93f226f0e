import itertools

import numpy as np
import pytest

from basketry.llm import langid

EN = "the cat sat on the mat and looked at the other cats while they were all sleeping there "
DE = "der hund lief durch den wald und suchte nach einem knochen weil er hunger hatte und nicht schlafen konnte "
RU = "собака бежала через лес и искала кость потому что она была голодна "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t * 5, lang) for t, lang in ((EN, "en"), (DE, "de"), (RU, "ru"))] + [(None, "xx"), ("text", None)]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_labels_and_edges(spark, model):
    assert model["names"] == ["de", "en", "ru"]
    rows = [(1, EN), (2, DE), (3, RU), (4, None), (5, ""), (6, "123 !?"), (7, "日本語"), (8, EN + DE * 3), (8, EN), (9, EN * 30_000)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, score string")
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "score", "lang_pred", "_score", "spans"]
    got = [(r.doc_id, r.lang_pred, r["_score"], r.spans) for r in out.collect()]
    assert [g[1] for g in got] == ["en", "de", "ru", "und", "und", "und", got[6][1], "de", "en", "en"]
    assert got[6][1] in model["names"] and got[6][2] == 0.0
    assert all(0 <= g[2] <= 1 for g in got) and got[0][2] == 1.0 and 0.5 < got[7][2] < 1
    first, second = got[7][3]
    assert (first.lang, second.lang) == ("en", "de") and abs(second.begin - len(EN)) < 12
    assert len(got[9][3]) == 1 and got[9][3][0].end == len((EN * 30_000).rstrip())


def test_without_training_rows(spark):
    model = langid.train(spark.createDataFrame([], "text string, lang string"))
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [tuple(r) for r in langid.identify(df, model).collect()] == [(1, "abc", "und", 0.0, [])]
    assert langid.identify(df.limit(0), model).count() == 0


def test_paths_against_all_paths():
    rand = np.random.default_rng(4)
    docs = [rand.normal(size=(n, 3)) * 2 for n in (1, 2, 5, 6, 6, 4)]

    def value(scores, path):
        return sum(s[p] for s, p in zip(scores, path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:]))
    best = [max(value(d, p) for p in itertools.product(range(3), repeat=len(d))) for d in docs]
    assert np.allclose([value(d, p) for d, p in zip(docs, langid.best_paths(docs, 2.5))], best)
    same = langid.constant_paths(np.concatenate(docs), np.cumsum([len(d) for d in docs]), 2.5)
    for d, c, b in zip(docs, same, best):
        if c >= 0:
            assert np.isclose(value(d, [c] * len(d)), b)


def test_held_out_accuracy(spark):
    from basketry.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op2_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out")
    rows = got.collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
