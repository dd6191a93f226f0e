"""How much the searches for similar users and items meet, at three sizes of made-up data.

    python tools/measure_search.py

Ratings: users in groups of like taste rate rare items of their group and popular ones by Zipf's law. Vectors: in
clusters, and without structure.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SIZES = (2000, 8000, 32000)


def ratings(spark, users: int):
    from pyspark.sql import functions as F

    def uniform(salt: int):
        return (F.pmod(F.xxhash64("user_id", "n", F.lit(salt)), F.lit(1_000_003)) + 1) / 1_000_003

    rows = spark.range(users).withColumnRenamed("id", "user_id").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(23))))
    group = F.floor(F.col("user_id") / 40)
    own = 1_000_000 + group * 30 + F.floor(30 * uniform(1))
    common = F.floor(F.pow(F.lit(float(users)), uniform(2)))  # the n-th item has a share of one in n
    return rows.select("user_id", F.when(F.col("n") < 12, own).otherwise(common).cast("long").alias("item_id"),
                       (1 + F.floor(5 * uniform(3))).cast("double").alias("rating")).dropDuplicates(["user_id", "item_id"])


def vectors(spark, n: int, clustered: bool, size: int = 64):
    from pyspark.sql import functions as F

    def spread(id, salt: int):
        return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.pmod(F.xxhash64(id, i, F.lit(salt)), F.lit(20_001)) / 10_000 - 1)
    rows = spark.range(n)
    if not clustered:
        return rows.select("id", spread(F.col("id"), 1).alias("vector"))
    centre, own = spread(F.floor(F.col("id") / 50), 2), spread(F.col("id"), 3)
    return rows.select("id", F.zip_with(centre, own, lambda a, b: a + b / 5).alias("vector"))


def main() -> None:
    from pyspark.sql import functions as F

    from basketry.operators import hashed_search, shared_ratings, similarity
    from basketry.session import build_session, cut_lineage

    spark = build_session("measure", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for n in SIZES:
        rows = cut_lineage(ratings(spark, n))
        shared = rows.groupBy("item_id").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        length = F.sqrt(F.sum(F.col("rating") * F.col("rating")))
        unit = cut_lineage(rows.join(rows.groupBy("user_id").agg(length.alias("l")), "user_id").select(
            F.col("user_id").alias("x"), F.col("item_id").alias("f"), (F.col("rating") / F.col("l")).alias("w")))
        popular = unit.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > shared_ratings.RARE)
        index, bounds = shared_ratings.bounded_index(unit, popular, 10)
        met = shared_ratings.meetings(shared_ratings._asked(index, bounds), index).agg(
            F.sum(F.size("a_i") * F.size("h_i"))).first()[0]
        began = time.time()
        found = shared_ratings.rating_neighbors(rows, "user_id", "item_id", 10).count()
        print(f"ratings {n} users, {rows.count()} ratings: {shared} products share an item, {met} met, "
              f"{found} neighbours, {time.time() - began:.1f} s", flush=True)
    for clustered in (True, False):
        for n in SIZES:
            rows = cut_lineage(vectors(spark, n, clustered))
            began = time.time()
            exact = cut_lineage(similarity.similar_items(rows, 10))
            middle = time.time()
            hashed = hashed_search.hash_vectors(rows, 10)
            told = hashed_search.recall_of(hashed_search.hashed_neighbors(hashed, 10), exact).first()
            print(f"vectors {n} {'clustered' if clustered else 'unstructured'}: exact {middle - began:.1f} s; hashed recall "
                  f"{told.found / told.entries:.3f}, candidates {100 * hashed.candidate_share:.1f} %, "
                  f"{hashed.joined} hashes, width {hashed.width}, {time.time() - middle:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
