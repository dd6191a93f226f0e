"""From raw documents to packed training sequences, in five stages.

Every stage but the last returns the columns of documents. A stage's output is written as
Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontam, langid, packing, quality, simhash
from basketry.llm.common import read_table, tokenizer_path, written

LEAST_SHARE = 0.5  # of a document's letters in languages that are known
END = 1  # id after every document
MOST = 64  # documents of a sequence
COST = packing.LENGTH ** 2 // 2  # attention cost of a sequence; a longer piece has one of its own


def _only(found: DataFrame, documents: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"`{c}`") for c in documents.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mainly in languages that ``lang`` names, one or several. If it names none, those with letters."""
    model = langid.train(docs.select("lang", "text"))
    if not model["names"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model, share=True)
    label, _, _, share = found.columns[-4:]
    return _only(found.filter((F.col(label) != langid.UNKNOWN) & (F.col(share) >= LEAST_SHARE)), docs)


def importance(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    weighed = written(quality.weigh(docs, read_table(spark, sf_dir, "labels")), "weighed")
    good, weight = weighed.columns[-2:]
    found = quality.select(weighed, weight=weight, good=good)
    return _only(found.filter(F.col(found.columns[-1])), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; n_chars follows the text."""
    cleaned = decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in the written sequences."""
    return packing.placements(packing.pack_documents(
        docs, tokenizer_path("word_bpe_49k.json"), END, most=MOST, cost=COST))


STAGES = [
    ("language ID", language),
    ("quality classifier", importance),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", sequences),
]

# Trained models, fingerprints and tokenizers have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
