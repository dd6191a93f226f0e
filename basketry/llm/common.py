"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import cut_lineage, scratch_path  # noqa: F401

# Python functions of this subpackage travel with the job: executors need the
# libraries they import, but not this package.
cloudpickle.register_pickle_by_value(sys.modules["basketry.llm"])

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 512  # rows of an Arrow batch: a few MB of ordinary texts

written = cut_lineage


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand texts to Python a few MB at a time, whatever their length."""
    spark.conf.set(ARROW_ROWS, str(rows))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    holder = sys.modules.setdefault("worker_cache_of_llm", types.ModuleType("worker_cache_of_llm"))
    return holder.__dict__.setdefault("entries", {})


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(column: Column) -> Column:
    """crc32 of an id written as text; null for null."""
    return F.crc32(column.cast("string"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores put before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def blocks(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut consecutive items into ranges whose lengths add up to ``most`` at most.

    An item longer than that is a range of its own.
    """
    begin, total, i = 0, 0, -1
    for i, n in enumerate(lengths):
        if total + n > most and i > begin:
            yield begin, i
            begin, total = i, 0
        total += n
    if i >= begin:
        yield begin, i + 1
