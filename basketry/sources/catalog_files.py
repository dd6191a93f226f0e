"""Product and review files, one Parquet file (or folder) per category."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.scalars import parse_image_list
from basketry.operators.ids import with_contiguous_index

FILE_NAME = r"(?:products|reviews)_([^/]+?)_cleaned\.parquet"


def load_products(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """All product files under one schema; files that do not exist are skipped."""
    return _load_each(spark, paths, harmonise_products)


def load_reviews(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """All review files with asin, overall and category; missing files skipped."""
    return _load_each(spark, paths, harmonise_reviews)


def harmonise_products(df: DataFrame) -> DataFrame:
    """title, brand, price, item_id and image list from whatever a file offers."""
    have = set(df.columns)
    title = next((c for c in ("title", "product_title", "name") if c in have), None)
    if title and title != "title":
        df = df.withColumn("title", F.col(title))
    if "brand" not in have:
        df = df.withColumn("brand", F.lit("Unknown"))
    if "price" not in have:
        df = df.withColumn("price", F.lit(0.0))
    if "valid_image_urls" in have and _is_string(df, "valid_image_urls"):
        df = df.withColumn("valid_image_urls", parse_image_list(F.col("valid_image_urls")))
    if "description" in have and not _is_string(df, "description"):
        df = df.withColumn("description", F.array_join("description", " "))
    if "item_id" not in have:
        if "asin" in have:
            df = df.withColumn("item_id", F.col("asin").cast("string"))
        else:
            # all columns, so that only equal rows can change places between runs
            order = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
            df = with_contiguous_index(df, order, "row_index").withColumn(
                "item_id", F.concat_ws("_", "category", "row_index")).drop("row_index")
    return df


def harmonise_reviews(df: DataFrame) -> DataFrame:
    """asin and overall, taken from the first column that carries them."""
    have = set(df.columns)
    for target, sources in (("asin", ("item_id", "product_id")), ("overall", ("rating", "star_rating"))):
        source = next((c for c in sources if c in have), None)
        if target not in have and source:
            df = df.withColumn(target, F.col(source))
    return df


def save_combined(products: DataFrame, reviews: DataFrame, folder: str) -> None:
    """Write the combined catalog and interactions, partitioned by category."""
    products.write.mode("overwrite").partitionBy("category").parquet(f"{folder}/real_items.parquet")
    reviews.write.mode("overwrite").partitionBy("category").parquet(
        f"{folder}/real_interactions.parquet")


def _load_each(
    spark: SparkSession, paths: Iterable[str], harmonise: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    frames = []
    for path in paths:
        df = _read_if_present(spark, path)
        if df is not None:
            category = F.regexp_extract(F.col("_metadata.file_path"), FILE_NAME, 1)
            frames.append(harmonise(df.withColumn("category", category)))
    if not frames:
        raise FileNotFoundError("none of the category files exists")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _is_string(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() == "string"
