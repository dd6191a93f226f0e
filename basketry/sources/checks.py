"""Data checks on a loaded table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from basketry.functions.scalars import is_web_url


def table_shape(df: DataFrame) -> DataFrame:
    """Per column: type, rows and rows with a value, in one pass."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    described = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("_rows").alias("row_count"), F.col(f.name).alias("filled_count"))
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*described)))


def sample_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by key, for a look at the data."""
    return df.orderBy(key).limit(n)


def image_coverage(items: DataFrame) -> DataFrame:
    """Items with and without images, and how many first images are web urls."""
    filled = F.size("valid_image_urls") > 0
    first = F.get("valid_image_urls", F.lit(0))
    return items.agg(
        F.count("*").alias("item_count"),
        F.count_if(filled).alias("with_images"),
        F.count_if(~F.coalesce(filled, F.lit(False))).alias("without_images"),
        F.count_if(F.coalesce(first, F.lit("")) != "").alias("non_empty_urls"),
        F.count_if(is_web_url(first)).alias("web_urls"),
    )


def observed_load(rows: DataFrame, path: str, images: str | None = None, **more: Column) -> dict:
    """Write ``rows`` and return what the write job itself has counted: rows, values per column, with the name of
    an image list also what ``image_coverage`` counts, and any other aggregates. Nothing is read twice."""
    counts = [F.count("*").alias("row_count"), *[F.count(F.col(f"`{c}`")).alias(f"filled_{c}") for c in rows.columns]]
    if images:
        filled, first = F.size(images) > 0, F.get(images, F.lit(0))
        counts += [F.count_if(filled).alias("with_images"), F.count_if(~F.coalesce(filled, F.lit(False))).alias("without_images"),
                   F.count_if(F.coalesce(first, F.lit("")) != "").alias("non_empty_urls"),
                   F.count_if(is_web_url(first)).alias("web_urls")]
    seen = Observation()
    rows.observe(seen, *counts, *[c.alias(n) for n, c in more.items()]).write.mode("overwrite").parquet(path)
    return seen.get
