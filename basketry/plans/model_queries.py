"""Trained models. Fitted numbers have no SQL side; what must hold for every fit has one."""

from functools import cached_property

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import evaluation, features, models, recommend
from basketry.operators.models import BiasedFactorModel, CollaborativeModel, FactorTreeModel, JointFactorModel
from basketry.plans.feature_queries import AS_OF
from basketry.plans.registry import INTERACTIONS, moment, query
from basketry.plans.user_queries import SPLIT, split_ratings
from basketry.session import cut_lineage, scratch_path
from basketry.sources.tables import Tables


class Trained:
    """The split ratings and the models a query asks for, each fitted once for it."""

    def __init__(self, t: Tables, planted: bool = False):
        split = split_ratings(t)
        split = cut_lineage(split.withColumn("rating", planted_rating()) if planted else split, "split")
        indexed, self.mappings = models.prepare_ratings(split.where("NOT held_out"))
        self.train = indexed
        self.held = split.where("held_out")

    @cached_property
    def cf(self) -> CollaborativeModel:
        return CollaborativeModel.train(self.train, self.mappings)

    @cached_property
    def pairs(self) -> DataFrame:
        return models.joined_pairs(self.train, self.cf)

    @cached_property
    def trees(self) -> FactorTreeModel:
        return FactorTreeModel.train(self.train, self.cf, joined=self.pairs)

    @cached_property
    def hybrid(self) -> FactorTreeModel:
        return FactorTreeModel.train(self.train, self.cf, on_residual=True, joined=self.pairs)

    @cached_property
    def biased(self) -> BiasedFactorModel:
        return BiasedFactorModel.train(self.train, self.mappings)


def _taste(of: str, number: int):
    """A number from -1 to 1 that belongs to an id."""
    return F.pmod(F.xxhash64(F.lit(number), F.col(of).cast("long")), F.lit(2001)) / 1000 - 1


def planted_rating():
    """A rating with a known cause: biases and two tastes of user and item."""
    return (3 + _taste("user_id", 1) / 2 + _taste("item_id", 2) / 2
            + _taste("user_id", 3) * _taste("item_id", 4) + _taste("user_id", 5) * _taste("item_id", 6))


def _users(t: Tables) -> DataFrame:
    return t.read("customer").select(F.col("c_custkey").alias("user_id"))


def _items(t: Tables) -> DataFrame:
    return t.catalog().select("item_id")


@query("M1 M4 P8")
def als_items_for_users(t: Tables) -> DataFrame:
    return Trained(t).cf.recommend_for_users(_users(t), 10)


@query("M5")
def als_users_for_items(t: Tables) -> DataFrame:
    return Trained(t).cf.recommend_for_items(_items(t), 10)


@query("M2")
def als_validation(t: Tables) -> DataFrame:
    model = Trained(t)
    return evaluation.rating_errors(model.cf.predict(model.held))


@query("M6 M7")
def als_factor_similarity(t: Tables) -> DataFrame:
    items = _items(t)
    pairs = items.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return Trained(t).cf.similarity(pairs, users=False)


@query("M3")
def als_tuning(t: Tables) -> DataFrame:
    """All points of the grid."""
    return models.tune(Trained(t).train, folds=3, parallelism=4)[1]


@query("S9")
def als_reloaded(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "model")
    Trained(t).cf.save(path)
    return CollaborativeModel.load(t.spark, path).recommend_for_users(_users(t), 5)


@query("M10 M14")
def biased_factor_predictions(t: Tables) -> DataFrame:
    model = Trained(t)
    return model.biased.predict(model.held).select("user_id", "item_id", "rating", "prediction")


@query("M11 M13 M14")
def factor_tree_predictions(t: Tables) -> DataFrame:
    model = Trained(t)
    return model.trees.predict(model.held).select("user_id", "item_id", "rating", "prediction")


@query("M12 M13 M14")
def factor_and_tree_predictions(t: Tables) -> DataFrame:
    model = Trained(t)
    return model.hybrid.predict(model.held).select("user_id", "item_id", "rating", "prediction")


@query("J6 W1")
def best_by_factor_product(t: Tables) -> DataFrame:
    return recommend.score_by_factors(Trained(t).cf, _users(t), _items(t), 10)


@query("M17 J6 J8 J11")
def batch_recommendations(t: Tables) -> DataFrame:
    model = Trained(t)
    rows = cut_lineage(t.interactions(discount=True), "interactions")
    users = features.user_features(rows, moment(AS_OF))
    items = features.item_features(t.catalog(), rows, moment(AS_OF))
    made = recommend.factor_and_tree_lists(model.cf, model.hybrid, _users(t), _items(t), 20)
    lists = {
        kind: recommend.batch_recommend(
            kind, _users(t), 10, cf=model.cf, deep=model.hybrid, candidates=_items(t),
            user_features=users, item_features=items, made=made).drop("model")
        for kind in ("collaborative", "deep_learning", "hybrid")
    }
    return evaluation.compare_models(lists)


@query("M18")
def model_comparison(t: Tables) -> DataFrame:
    model = Trained(t)
    relevant = model.held.where("rating >= 3")
    n = 20
    # the merged lists take the best 2 n of each side
    cf, deep = recommend.factor_and_tree_lists(model.cf, model.hybrid, _users(t), _items(t), 2 * n)
    top = evaluation.popularity_ranking(model.train, n)
    return evaluation.compare_models({
        "popularity": evaluation.ranking_metrics(evaluation.hits_of_shared_list(relevant, top)),
        "collaborative": evaluation.ranking_metrics(evaluation.hits_of_lists(relevant, cf.where(F.col("rank") <= n))),
        "deep_learning": evaluation.ranking_metrics(
            evaluation.hits_of_lists(relevant, deep.where(F.col("rank") <= n))),
        "hybrid": evaluation.ranking_metrics(
            evaluation.hits_of_lists(relevant, recommend.merge_scores(cf, deep, n))),
    })


KNOWN = f"""
{INTERACTIONS}, {SPLIT},
known_users AS (SELECT DISTINCT user_id FROM ratings WHERE NOT held_out),
known_items AS (SELECT DISTINCT item_id FROM ratings WHERE NOT held_out),
held AS (SELECT r.* FROM ratings r SEMI JOIN known_users USING (user_id) SEMI JOIN known_items USING (item_id)
         WHERE held_out)"""


def _sound(lists: DataFrame, key: str, listed: str, known: DataFrame) -> DataFrame:
    """Per list: its length, and whether it is ranked 1 to n by falling score, without
    repeats, over known ids."""
    marked = lists.join(known.select(listed).distinct().withColumn("_known", F.lit(True)), listed, "left")
    entry = F.array_sort(F.collect_list(F.struct("rank", F.col(listed), "score")))
    return marked.groupBy(key).agg(
        F.count("*").alias("entries"), F.every(F.coalesce("_known", F.lit(False))).alias("all_known"),
        entry.alias("_list")).select(
        key, "entries", "all_known",
        (F.transform("_list", lambda e: e["rank"].cast("int")) == F.sequence(
            F.lit(1), F.col("entries").cast("int"))).alias("ranked"),
        (F.size(F.array_distinct(F.transform("_list", lambda e: e[listed]))) == F.col("entries")).alias("distinct_ids"),
        (F.transform("_list", lambda e: e["score"]) == F.reverse(F.array_sort(
            F.transform("_list", lambda e: e["score"])))).alias("by_score"))


@query("M1 M4 P8", f"""
WITH {KNOWN} SELECT user_id, 10::BIGINT AS entries, TRUE AS all_known, TRUE AS ranked, TRUE AS distinct_ids, TRUE AS by_score
FROM known_users""")
def als_user_lists_sound(t: Tables) -> DataFrame:
    model = Trained(t)
    return _sound(model.cf.recommend_for_users(_users(t), 10), "user_id", "item_id", model.train)


@query("M5", f"""
WITH {KNOWN} SELECT item_id, 10::BIGINT AS entries, TRUE AS all_known, TRUE AS ranked, TRUE AS distinct_ids, TRUE AS by_score
FROM known_items""")
def als_item_lists_sound(t: Tables) -> DataFrame:
    model = Trained(t)
    return _sound(model.cf.recommend_for_items(_items(t), 10), "item_id", "user_id", model.train)


@query("M17 J6 J8", f"""
WITH {KNOWN} SELECT user_id, 10::BIGINT AS entries, TRUE AS all_known, TRUE AS ranked, TRUE AS distinct_ids, TRUE AS by_score
FROM known_users""")
def hybrid_lists_sound(t: Tables) -> DataFrame:
    """Merged lists over the whole catalog."""
    model = Trained(t)
    lists = recommend.batch_recommend("hybrid", _users(t), 10, cf=model.cf, deep=model.hybrid, candidates=_items(t))
    return _sound(lists, "user_id", "item_id", model.train)


@query("S9", f"""
WITH {KNOWN} SELECT count(*) * 5 AS entries, 0::BIGINT AS different FROM known_users""")
def als_reload_is_equal(t: Tables) -> DataFrame:
    """Lists of a saved and reloaded model that the model itself does not give."""
    path, model = scratch_path(t.spark, "model"), Trained(t)
    model.cf.save(path)
    own = model.cf.recommend_for_users(_users(t), 5).withColumnRenamed("score", "own")
    again = CollaborativeModel.load(t.spark, path).recommend_for_users(_users(t), 5)
    return own.join(again, ["user_id", "item_id", "rank"], "full").agg(
        F.count("*").alias("entries"), F.count_if(~F.col("own").eqNullSafe(F.col("score"))).alias("different"))


@query("M2 M10 M11 M12 M13 M14", f"""
WITH {KNOWN}, n AS (SELECT count(*) AS pairs FROM held), a AS (SELECT count(*) AS pairs FROM ratings WHERE held_out)
SELECT * FROM (SELECT 'als' AS model, pairs FROM n UNION ALL SELECT 'trees', pairs FROM n UNION ALL
               SELECT 'factors and trees', pairs FROM n UNION ALL SELECT 'biased factors', pairs FROM a UNION ALL
               SELECT 'joint factors', pairs FROM a),
              (SELECT TRUE AS better_than_mean, 0::BIGINT AS differing)""")
def predictions_of_planted_ratings(t: Tables) -> DataFrame:
    """Held-out pairs each model predicts, of ratings whose cause is known: whether its error is below that of the mean
    rating, and how many predictions differ from what the model's exported parts add up to."""
    model = Trained(t, planted=True)
    joint = JointFactorModel.train(model.train, model.mappings, rank=4)
    mean = model.train.agg(F.avg("rating")).first()[0]
    users, items = model.cf.user_factors(), model.cf.item_factors()
    product = F.aggregate(F.zip_with("u", "i", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def product_of(rows: DataFrame) -> DataFrame:
        return rows.join(users.withColumnRenamed("factors", "u"), "user_id").join(
            items.withColumnRenamed("factors", "i"), "item_id").withColumn("product", product)

    def trees_of(rows: DataFrame, m: FactorTreeModel) -> DataFrame:
        featured = product_of(rows).withColumn("features", array_to_vector(F.concat("u", "i")))
        return m.trees.transform(featured).withColumnRenamed("_trees", "tree")

    def biased_of(rows: DataFrame, overall, user_bias, item_bias, user_vectors, item_vectors) -> DataFrame:
        parts = rows.join(user_bias, "user_id", "left").join(item_bias, "item_id", "left").join(
            user_vectors, "user_id", "left").join(item_vectors, "item_id", "left")
        zero = F.lit(0.0)
        return parts.withColumn("own", overall + F.coalesce("user_bias", zero) + F.coalesce("item_bias", zero) + F.coalesce(product, zero))

    biased = model.biased
    made = {
        "als": product_of(model.cf.predict(model.held)).withColumn("own", F.col("product")),
        "trees": trees_of(model.trees.predict(model.held), model.trees).withColumn("own", F.col("tree")),
        "factors and trees": trees_of(model.hybrid.predict(model.held), model.hybrid).withColumn(
            "own", F.col("tree") + F.col("product")),
        "biased factors": biased_of(
            biased.predict(model.held), F.lit(biased.overall.first()[0]), biased.user_bias, biased.item_bias,
            biased.residual.user_factors().withColumnRenamed("factors", "u"),
            biased.residual.item_factors().withColumnRenamed("factors", "i")),
        "joint factors": biased_of(
            joint.predict(model.held), F.lit(joint.mean.first()[0]), joint.user_terms.drop("_uf"), joint.item_terms.drop("_if"),
            joint.user_terms.select("user_id", F.col("_uf").alias("u")),
            joint.item_terms.select("item_id", F.col("_if").alias("i"))),
    }
    found = None
    for name, rows in made.items():
        error = F.avg((F.col("prediction") - F.col("rating")) ** 2)
        one = rows.agg(
            F.count("prediction").alias("pairs"),
            (error < F.avg((F.col("rating") - mean) ** 2)).alias("better_than_mean"),
            F.count_if(~(F.abs(F.col("prediction") - F.col("own")) < 1e-9)).alias("differing")).withColumn("model", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


@query("M10 M13", f"""
WITH {KNOWN} SELECT count(*) AS pairs, TRUE AS below_biases, TRUE AS biases_below_mean FROM ratings WHERE held_out""")
def joint_factors_beat_biases(t: Tables) -> DataFrame:
    """On ratings with planted tastes: biases explain more than the mean, and the joint factors far more than biases."""
    model = Trained(t, planted=True)
    joint = JointFactorModel.train(model.train, model.mappings, rank=4)
    overall, users, items = models.bias_terms(model.train)
    both = models.baseline_prediction(joint.predict(model.held), overall, users, items)

    def error(prediction):
        return F.sqrt(F.avg((prediction - F.col("rating")) ** 2))
    return both.agg(
        F.count("prediction").alias("pairs"),
        (error(F.col("prediction")) < 0.8 * error(F.col("baseline"))).alias("below_biases"),
        (error(F.col("baseline")) < error(F.lit(model.train.agg(F.avg("rating")).first()[0]))).alias("biases_below_mean"))


@query("M6 M7", f"""
WITH {KNOWN}, pairs AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part),
seen AS (SELECT *, a IN (SELECT item_id FROM known_items) AND b IN (SELECT item_id FROM known_items) AS known FROM pairs)
SELECT a, b, known, 0::BIGINT AS wrong, 50 AS factors FROM seen""")
def als_factor_lookup(t: Tables) -> DataFrame:
    """Cosines of items numbered one after the other, against those of the exported factors; unknown ones have 0."""
    model = Trained(t).cf
    items = _items(t)
    pairs = items.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    told = model.similarity(pairs, users=False)
    factors = model.item_factors()
    left, right = factors.toDF("a", "u"), factors.toDF("b", "v")

    def summed(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = F.coalesce(F.try_divide(summed("u", "v"), F.sqrt(summed("u", "u")) * F.sqrt(summed("v", "v"))), F.lit(0.0))
    size = factors.agg(F.max(F.size("factors"))).first()[0]
    return told.join(left, "a", "left").join(right, "b", "left").select(
        "a", "b", (F.col("u").isNotNull() & F.col("v").isNotNull()).alias("known"),
        (~(F.abs(F.col("similarity") - cosine) < 1e-9)).cast("long").alias("wrong"), F.lit(size).alias("factors"))


@query("M3", """
SELECT rank::DOUBLE AS rank, reg::DOUBLE AS "regParam", iter::DOUBLE AS "maxIter", TRUE AS measured, TRUE AS best_kept
FROM (VALUES (10), (20), (50)) r(rank), (VALUES (0.01), (0.1), (0.5)) g(reg), (VALUES (5), (10), (20)) i(iter)""")
def als_tuning_grid(t: Tables) -> DataFrame:
    """All 27 points, each with an error that is a number above 0, and whether the model kept is that of the lowest."""
    model, table = models.tune(Trained(t).train, folds=3, parallelism=4)
    rows = cut_lineage(table, "tuning")
    best = rows.orderBy("rmse").first()
    return rows.select("rank", "regParam", "maxIter", (
        (F.col("rmse") > 0) & (F.col("rmse") < float("inf"))).alias("measured"), F.lit(model.rank == best["rank"]).alias("best_kept"))


@query("M2 M10 M11 M12 M13 M14", f"""
WITH {KNOWN}, n AS (SELECT count(*) AS pairs FROM held), a AS (SELECT count(*) AS pairs FROM ratings WHERE held_out)
SELECT * FROM (SELECT 'als' AS model, pairs FROM n UNION ALL SELECT 'trees', pairs FROM n UNION ALL
               SELECT 'factors and trees', pairs FROM n UNION ALL SELECT 'biased factors', pairs FROM a),
              (SELECT TRUE AS in_range)""")
def predictions_cover_held_pairs(t: Tables) -> DataFrame:
    """Held-out pairs each model predicts, and whether its mean absolute error is below the ratings' range."""
    model = Trained(t)
    parts = {"als": model.cf, "trees": model.trees, "factors and trees": model.hybrid, "biased factors": model.biased}
    made = None
    for name, m in parts.items():
        one = m.predict(model.held).agg(
            F.count("prediction").alias("pairs"),
            (F.avg(F.abs(F.col("prediction") - F.col("rating"))) < 4).alias("in_range")).withColumn("model", F.lit(name))
        made = one if made is None else made.unionByName(one)
    return made
