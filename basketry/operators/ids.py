"""Contiguous integer ids for string or sparse keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.session import cut_lineage


def with_contiguous_index(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Number the rows 0..n-1 in the given order, without a one-task sort.

    Rows are range-sorted; each partition numbers its own rows and starts at
    the count of all rows in earlier partitions. The sorted rows are written
    first: counts and numbers must see the same partitions.
    """
    sorted_rows = cut_lineage(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # one row per partition of the sort, so the single-task window stays small
    starts = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return (sorted_rows.withColumn("_part", part)
            .join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + within)
            .drop("_part", "_place", "_start"))


def id_map(df: DataFrame, key: str, name: str) -> DataFrame:
    """Map table from each distinct non-null key to an index 0..n-1."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return with_contiguous_index(keys, [key], name).select(key, F.col(name).cast("int").alias(name))
