"""Held-out evaluation of rankings and rating predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import hash_bucket

KS = (5, 10, 20)


def with_split(ratings: DataFrame, percent: int = 20) -> DataFrame:
    """Mark ``percent`` of the user-item pairs, by hash, as held out."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("item_id").cast("string"))
    return ratings.withColumn("held_out", hash_bucket(key) < percent)


def hits_of_lists(relevant: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Relevant pairs with their rank in the user's list, if they are in it."""
    return relevant.select("user_id", "item_id").join(
        recommendations.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left")


def hits_of_shared_list(relevant: DataFrame, ranked_items: DataFrame) -> DataFrame:
    """The same for one list shown to everybody (item_id, rank; a few rows)."""
    return relevant.select("user_id", "item_id").join(
        ranked_items.select("item_id", "rank"), "item_id", "left")


def ranking_metrics(hits: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Mean precision, recall and NDCG at each k over users with relevant items."""
    gains = []
    for k in ks:
        inside = F.col("rank") <= k
        gains += [F.count_if(inside).alias(f"hit{k}"),
                  F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0))
                  .alias(f"dcg{k}")]
    per_user = hits.groupBy("user_id").agg(F.count("*").alias("relevant"), *gains)
    ideal = [0.0]
    for position in range(1, max(ks) + 1):
        ideal.append(ideal[-1] + 1 / math.log2(position + 1))
    best = F.array(*[F.lit(v) for v in ideal])
    means = []
    for k in ks:
        means += [
            F.avg(F.col(f"hit{k}") / k).alias(f"p{k}"),
            F.avg(F.col(f"hit{k}") / F.col("relevant")).alias(f"r{k}"),
            F.avg(F.col(f"dcg{k}") / F.get(best, F.least(F.lit(k), F.col("relevant").cast("int"))))
            .alias(f"n{k}")]
    one = per_user.agg(F.count("*").alias("users"), *means)
    return one.select("users", F.inline(F.array(*[F.struct(
        F.lit(k).alias("k"), F.col(f"p{k}").alias("precision"), F.col(f"r{k}").alias("recall"),
        F.col(f"n{k}").alias("ndcg")) for k in ks])))


def rating_errors(predictions: DataFrame) -> DataFrame:
    """RMSE and MAE of column prediction against column rating, one row."""
    miss = F.col("prediction") - F.col("rating")
    return predictions.agg(
        F.count(miss).alias("pairs"), F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(F.abs(miss)).alias("mae"))


def compare_models(results: dict[str, DataFrame]) -> DataFrame:
    """Rows of several result frames, labelled by model."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("model"), "*") for name, df in results.items()])


def popularity_ranking(ratings: DataFrame, n: int) -> DataFrame:
    """The ``n`` most popular items (mean rating times log of count) with rank."""
    scores = ratings.groupBy("item_id").agg(
        (F.avg("rating") * F.log1p(F.count("*"))).alias("score"))
    top = scores.orderBy(F.desc(F.round("score", 9)), "item_id").limit(n)
    listed = top.agg(F.array_sort(F.collect_list(F.struct(
        (-F.round("score", 9)).alias("_s"), "item_id", "score"))).alias("listed"))
    return listed.select(F.posexplode("listed").alias("_p", "_i")).select(
        "_i.item_id", "_i.score", (F.col("_p") + 1).alias("rank"))
