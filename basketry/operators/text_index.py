"""Literal substring search over a stored index, without reading the catalog.

The index has two tables. ``grams`` has, for every different run of one, two or three characters in the texts, the items
that have it, in rows of at most ``CHUNK`` items and in partitions by a hash of the run. Items are listed by run before the shuffle.
``texts`` has the texts themselves, in partitions by a hash of the item. A
search reads the partitions of the needle's runs, keeps the items that have all of them, reads the partitions of
those items, and checks the texts. A needle of up to three characters is a single run. What the scan of all texts would find is
found, and nothing else: letter case aside, any of the texts holds the trimmed needle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.catalog import matches_text
from basketry.session import spread

# executors get these functions with the job and need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 64
RUN = 3
CHUNK = 2000  # items listed by run at a time


def _runs(text: str) -> set[str]:
    """All different runs of one to ``RUN`` characters: the longest ones, and how they and the text's end begin."""
    longest = {text[i:i + RUN] for i in range(len(text) - RUN + 1)}
    tails = [text[i:] for i in range(max(0, len(text) - RUN + 1), len(text))]
    return {run[:n] for run in (*longest, *tails) for n in range(1, len(run) + 1)}


def _listed(batch: pa.RecordBatch, key: str, columns: list[str]) -> pa.RecordBatch:
    """The items of each run in the texts of a batch."""
    places: dict[str, list[int]] = {}
    for place, texts in enumerate(zip(*[batch.column(c).to_pylist() for c in columns])):
        for run in set().union(*map(_runs, texts)):
            places.setdefault(run, []).append(place)
    offsets, rows = [0], []
    for found in places.values():
        rows += found
        offsets.append(len(rows))
    ids = batch.column(key).take(pa.array(rows, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(places, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)], ["gram", key])


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def build_index(items: DataFrame, key: str, columns: list[str], folder: str, buckets: int = BUCKETS) -> None:
    """Write the index of the texts in ``columns``; null texts are empty."""
    texts = items.select(key, *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    kept = texts.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"_{i}" for i in range(len(columns))]
        waiting, count = [], 0  # batches may be far smaller than a chunk
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                waiting.append(batch.slice(start, CHUNK))
                count += waiting[-1].num_rows
                if count >= CHUNK:
                    yield _listed(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], "_key", names)
                    waiting, count = [], 0
        if count:
            yield _listed(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], "_key", names)

    kind = items.schema[key].dataType.simpleString()
    grams = spread(kept, "_key").mapInArrow(listed, f"gram string, _key array<{kind}>").withColumnRenamed("_key", key).withColumn(
        "bucket", _bucket("gram", buckets))
    for name, rows, order in (("grams", grams, ["gram"]),
                              ("texts", texts.withColumn("bucket", _bucket(key, buckets)), [key])):
        # sorted, so that row groups of other runs or items are passed over
        (rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(*order, key), F.lit(4))).sortWithinPartitions("bucket", *order)
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}"))


def candidates(spark: SparkSession, folder: str, key: str, needle: str, buckets: int = BUCKETS) -> DataFrame:
    """Items that have all runs of the needle, which has one character at least."""
    wanted = needle.strip().lower()
    runs = sorted({wanted[i:i + RUN] for i in range(max(1, len(wanted) - RUN + 1))})
    hashed = spark.createDataFrame([(r,) for r in runs], "gram string").select(_bucket("gram", buckets)).distinct().collect()
    rows = spark.read.parquet(f"{folder}/grams").where(
        F.col("bucket").isin([r[0] for r in hashed]) & F.col("gram").isin(runs))
    return rows.select(F.explode(key).alias(key)).groupBy(key).agg(F.count("*").alias("found")).where(F.col("found") == len(runs)).select(key)


def search_index(spark: SparkSession, folder: str, key: str, columns: list[str], needle: str,
                 buckets: int = BUCKETS) -> DataFrame:
    """Keys of the items any of whose texts hold the needle. An empty needle is in every text."""
    texts = spark.read.parquet(f"{folder}/texts")
    if not needle.strip():
        return texts.select(key)
    found = candidates(spark, folder, key, needle, buckets)
    places = found.select(_bucket(key, buckets)).distinct().collect()  # one row per bucket at most
    mine = texts.where(F.col("bucket").isin([r[0] for r in places])).join(found, key, "left_semi")
    return mine.where(matches_text(needle, columns)).select(key)
