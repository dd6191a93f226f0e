import pytest

import corpus_pipeline
from basketry.llm import queries
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    answer = duck(FOLDER).execute(queries.SQL[name])
    assert compare(frame.columns, [tuple(r) for r in frame.collect()],
                   [d[0] for d in answer.description], answer.fetchall()) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.written(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == first.columns
        left = [r.doc_id for r in docs.collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        ids = set(left)
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in out} == ids and len(ids) > 100
    assert all(r.length <= 4096 for r in out)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls everywhere, empty texts, repeated rows, an extra column, and no rows at all."""
    for table in ("benchmark", "labels"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    text = "the quick brown fox jumps over the lazy dog and runs away from it all day long"
    rows = [(1, text, "en", "s", 3, 0.5), (1, text, "en", "s", 3, 0.5), (2, text + " again", "en", None, None, None),
            (3, None, "en", "s", 0, 0.1), (4, "", None, None, None, None), (None, text.upper() + " x", None, None, None, None),
            (5, "123 456", "en", "s", 7, 0.2), (6, "word " * 9000, "en", "s", 7, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for some in (docs, docs.limit(0)):
        left = queries.written(some, "odd")
        for _, stage in corpus_pipeline.STAGES:
            left = queries.written(stage(spark, left, str(tmp_path)), "stage")
        ids = [r.doc_id for r in left.collect()]
        assert (sorted(set(ids), key=str) == [1, 2, 6, None] or set(ids) <= {1, 2, 6, None}) if some is docs else ids == []


def test_language_stage_keeps_texts_in_several_known_languages(spark):
    words = {"aa": ["kalimo", "tarevo", "sidumo", "penalo"], "bb": ["thwick", "scrunth", "blorgh", "grimps"],
             "cc": ["yqzaux", "queaux", "zuiyou", "xeauqu"]}
    rows = [(i * 10 + j, " ".join(w * 10), lang, "s") for i, (lang, w) in enumerate(words.items()) for j in range(8)]
    # each of the three has under half of the letters
    mixed = " ".join([*words["aa"] * 18, *words["bb"] * 12, *words["cc"] * 12])
    rows += [(100, mixed, None, "s"), (101, "\u4f60\u597d\u4e16\u754c " * 20, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = queries.langid.identify(docs, queries.langid.train(docs.select("lang", "text"))).filter("doc_id = 100").first()
    assert found.score < 0.5 and {x.lang for x in found.spans} == set(words)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, FOLDER).collect()}
    assert 100 in kept and 101 not in kept
