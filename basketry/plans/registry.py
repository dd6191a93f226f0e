"""The list of runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""
    def wrap(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder))
        QUERIES[function.__name__] = Query(function.__name__, tuple(covers.split()), run, sql)
        return function
    return wrap


HALF = 3.3e-10  # added before rounding where exact halves occur, so that they round alike


def rounded(df: DataFrame, digits: int = 6, lift: float = 0.0, **special: int) -> DataFrame:
    """Round every double column, for comparison across engines."""
    return df.select(*[
        F.round(F.col(f.name) + lift, special.get(f.name, digits)).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields])


def moment(text: str) -> Column:
    """A fixed time without zone."""
    return F.lit(text).cast("timestamp_ntz")


# The retail view of the tables, for the SQL side.
INTERACTIONS = """
interactions AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
         1 + 4 * (l.l_quantity - 1) / 49 AS rating, o.o_orderdate AS ts,
         l.l_extendedprice / l.l_quantity AS price, p.p_type AS category, p.p_brand AS brand,
         p.p_name AS title, o.o_orderstatus AS status
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey)"""
ITEM_STATS = """
item_stats AS (
  SELECT item_id, avg(rating) AS avg_rating, count(rating) AS review_count,
         count(DISTINCT user_id) AS unique_users,
         avg(rating) * ln(1 + count(rating)) AS popularity_score
  FROM interactions GROUP BY item_id)"""
REVIEWED = """
reviewed AS (
  SELECT p.p_partkey AS item_id, p.p_name AS title, p.p_type AS category, p.p_brand AS brand,
         p.p_retailprice AS price, coalesce(s.rating, 4.0) AS rating,
         coalesce(s.review_count, 0) AS review_count
  FROM part p LEFT JOIN (SELECT item_id, avg(rating) AS rating, count(*) AS review_count
                         FROM interactions GROUP BY item_id) s ON p.p_partkey = s.item_id)"""
ENTRIES = """
entries AS (
  SELECT user_id, CASE status WHEN 'F' THEN 'purchase' WHEN 'O' THEN 'wishlist' ELSE 'cart' END AS kind,
         item_id, title, category, brand, price, ts AS added_at FROM interactions)"""
