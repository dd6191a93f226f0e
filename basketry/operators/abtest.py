"""A/B tests: assignment, metrics, significance, planning, lifecycle, reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import stats
from basketry.functions.scalars import hash_bucket

# Metrics analysed as proportions; all others are continuous.
PROPORTION_METRICS = ("ctr", "conversion_rate", "bounce_rate")

# Wording of verdicts and advice.
VERDICT_BETTER = "Implement test group - shows significant improvement"
VERDICT_WORSE = "Keep control group - test group performs worse"
VERDICT_NONE = "No significant difference detected - continue testing or keep control"
ADVICE_BETTER = "Implement the test variant - shows significant improvement"
ADVICE_WORSE = "Keep control variant - test variant performs worse"
ADVICE_NONE = "No significant difference detected"
ADVICE_ENOUGH = "Test has adequate sample size - effects may be too small to detect"
ADVICE_SMALL = "Consider increasing sample size"
ADEQUATE_POWER = 0.8


@dataclass(frozen=True)
class TestConfig:
    """One A/B test; ``metrics`` are names, the first is the headline metric."""

    __test__ = False  # not a pytest class

    test_id: str
    name: str
    traffic_split: float
    minimum_sample_size: int
    description: str = ""
    confidence_level: float = 0.95
    power: float = 0.8
    expected_effect_size: float = 0.1
    test_duration_days: int = 14
    metrics: tuple[str, ...] = ("ctr",)


def config_frame(spark: SparkSession, tests: Sequence[TestConfig]) -> DataFrame:
    """The configurations as rows."""
    schema = ("test_id string, name string, description string, traffic_split double, "
              "minimum_sample_size int, confidence_level double, power double, "
              "expected_effect_size double, test_duration_days int, metrics array<string>")
    return spark.createDataFrame(
        [(t.test_id, t.name, t.description, t.traffic_split, t.minimum_sample_size,
          t.confidence_level, t.power, t.expected_effect_size, t.test_duration_days,
          list(t.metrics)) for t in tests], schema)


def group_of(test_id: Column, user_id: Column, traffic_split: Column) -> Column:
    """'test' for the share of users below the split, the same on every call."""
    bucket = hash_bucket(F.concat_ws(":", test_id, user_id.cast("string")))
    return F.when(bucket < traffic_split * 100, "test").otherwise("control")


def assign_users(users: DataFrame, tests: Sequence[TestConfig]) -> DataFrame:
    """Each user's group in each test."""
    return _with_tests(users.select("user_id").distinct(), tests).select(
        "test_id", "user_id",
        group_of(F.col("test_id"), F.col("user_id"), F.col("traffic_split")).alias("group"))


def record_interactions(interactions: DataFrame, tests: Sequence[TestConfig]) -> DataFrame:
    """Interactions with their group, once per test, keeping tracked metrics.

    ``interactions``: user_id, ts, metrics (map from name to value).
    """
    return _with_tests(interactions, tests).select(
        "test_id",
        group_of(F.col("test_id"), F.col("user_id"), F.col("traffic_split")).alias("group"),
        "user_id", "ts",
        F.map_filter("metrics", lambda name, _: F.array_contains("tracked", name)).alias("metrics"))


def _with_tests(rows: DataFrame, tests: Sequence[TestConfig]) -> DataFrame:
    """A few constants per row; the number of running tests is small."""
    listed = F.array(*[F.struct(
        F.lit(t.test_id).alias("test_id"), F.lit(float(t.traffic_split)).alias("traffic_split"),
        F.array(*[F.lit(m) for m in t.metrics]).alias("tracked")) for t in tests])
    return rows.select("*", F.inline(listed))


def group_sizes(recorded: DataFrame) -> DataFrame:
    """Recorded interactions per test and group."""
    return recorded.groupBy("test_id").agg(
        F.count_if(F.col("group") == "control").alias("sample_size_control"),
        F.count_if(F.col("group") == "test").alias("sample_size_test"))


def metric_stats(recorded: DataFrame) -> DataFrame:
    """n, sum, mean and both standard deviations per test, metric and group."""
    values = recorded.select("test_id", "group", F.explode("metrics").alias("metric", "value"))
    return values.groupBy("test_id", "metric", "group").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std_pop"), F.stddev_samp("value").alias("std_samp"))


def _side_by_side(grouped: DataFrame) -> DataFrame:
    """One row per test and metric; metrics without both groups are left out."""
    def pick(column: str, group: str) -> Column:
        return F.max(F.when(F.col("group") == group, F.col(column))).alias(f"{column}_{group}")
    columns = ("n", "total", "mean", "std_pop", "std_samp")
    return grouped.groupBy("test_id", "metric").agg(
        *[pick(c, g) for c in columns for g in ("control", "test")],
    ).where((F.col("n_control") > 0) & (F.col("n_test") > 0))


def compare_proportions(grouped: DataFrame) -> DataFrame:
    """Two-proportion z (test minus control), rates, unpooled error, lift."""
    n1, n2 = F.col("n_control"), F.col("n_test")
    p1, p2 = F.col("mean_control"), F.col("mean_test")
    pooled = (F.col("total_control") + F.col("total_test")) / (n1 + n2)
    pooled_error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return _side_by_side(grouped.where(F.col("metric").isin(*PROPORTION_METRICS))).select(
        "test_id", "metric", "n_control", "n_test",
        p1.alias("control_value"), p2.alias("test_value"), (p2 - p1).alias("difference"),
        F.try_divide(p2 - p1, pooled_error).alias("test_statistic"),
        F.lit(None).cast("double").alias("degrees_of_freedom"),
        F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2).alias("unpooled_error"),
        F.when(p1 > 0, (p2 - p1) / p1).otherwise(0.0).alias("relative_improvement"))


def compare_means(grouped: DataFrame) -> DataFrame:
    """Pooled two-sample t (test minus control), means, unpooled error, lift."""
    n1, n2 = F.col("n_control"), F.col("n_test")
    m1, m2 = F.col("mean_control"), F.col("mean_test")
    s1, s2 = F.col("std_samp_control"), F.col("std_samp_test")
    df = n1 + n2 - 2
    pooled_variance = F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, df)
    pooled_error = F.sqrt(pooled_variance * (1 / n1 + 1 / n2))
    return _side_by_side(grouped.where(~F.col("metric").isin(*PROPORTION_METRICS))).select(
        "test_id", "metric", "n_control", "n_test",
        m1.alias("control_value"), m2.alias("test_value"), (m2 - m1).alias("difference"),
        F.try_divide(m2 - m1, pooled_error).alias("test_statistic"),
        df.cast("double").alias("degrees_of_freedom"),
        F.sqrt(s1 * s1 / n1 + s2 * s2 / n2).alias("unpooled_error"),
        F.when(m1 != 0, (m2 - m1) / m1).otherwise(0.0).alias("relative_improvement"))


def analyze_metrics(grouped: DataFrame, configs: DataFrame) -> DataFrame:
    """Test statistic, p value, confidence interval and verdict per metric."""
    compared = compare_proportions(grouped).unionByName(compare_means(grouped))
    joined = compared.join(configs.select("test_id", "confidence_level", "metrics"), "test_id").where(
        F.array_contains("metrics", F.col("metric")))
    t, df = F.col("test_statistic"), F.col("degrees_of_freedom")
    tail = 1 - (1 - F.col("confidence_level")) / 2
    # Python functions run for the rows of either branch; without degrees of freedom
    # the costly ones return at once
    scored = (joined
              .withColumn("p_value", F.when(df.isNull(), stats.normal_p_value(t))
                          .otherwise(stats.t_p_value(t, df)))
              .withColumn("critical", F.when(df.isNull(), stats.normal_quantile_of(tail))
                          .otherwise(stats.t_quantile_of(tail, df))))
    margin = F.col("critical") * F.col("unpooled_error")
    return scored.select(
        "test_id", "metric", F.when(df.isNull(), "proportion").otherwise("continuous").alias("kind"),
        "n_control", "n_test", "control_value", "test_value", "difference", "test_statistic",
        "p_value", (F.col("difference") - margin).alias("ci_lower"),
        (F.col("difference") + margin).alias("ci_upper"), "relative_improvement",
        F.coalesce(F.col("p_value") < 1 - F.col("confidence_level"), F.lit(False)).alias("significant"))


def analyze_tests(
    metric_results: DataFrame, sizes: DataFrame, configs: DataFrame, completed_at: Column,
) -> DataFrame:
    """One result row per test that has interactions in both groups.

    The headline numbers are those of the first configured metric; a test is
    significant if any of its metrics is.
    """
    per_test = metric_results.groupBy("test_id").agg(
        F.max("significant").alias("any_significant"),
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct(
            "relative_improvement", "p_value", "test_statistic", "ci_lower", "ci_upper")))).alias("by_metric"))
    head = F.try_element_at(F.col("by_metric"), F.col("metrics")[0])
    joined = (configs.join(sizes, "test_id")
              .where((F.col("sample_size_control") > 0) & (F.col("sample_size_test") > 0))
              .join(per_test, "test_id", "left").withColumn("_head", head))
    effect = F.coalesce("_head.relative_improvement", F.lit(0.0))
    significant = F.coalesce("any_significant", F.lit(False))
    return joined.select(
        "test_id", "name", significant.alias("statistical_significance"),
        effect.alias("effect_size"), F.col("_head.p_value").alias("p_value"),
        F.col("_head.test_statistic").alias("test_statistic"),
        F.col("_head.ci_lower").alias("ci_lower"), F.col("_head.ci_upper").alias("ci_upper"),
        "sample_size_control", "sample_size_test", "minimum_sample_size",
        F.when(significant & (effect > 0), VERDICT_BETTER)
        .when(significant & (effect < 0), VERDICT_WORSE).otherwise(VERDICT_NONE)
        .alias("recommendation"),
        completed_at.alias("completed_at"))


def report_recommendations(results: DataFrame) -> DataFrame:
    """What a test report advises, including whether the sample was large enough."""
    enough = F.col("sample_size_control") + F.col("sample_size_test") >= F.col("minimum_sample_size")
    advice = F.when(
        F.col("statistical_significance"),
        F.array(F.when(F.col("effect_size") > 0, ADVICE_BETTER).otherwise(ADVICE_WORSE)),
    ).otherwise(F.array(
        F.lit(ADVICE_NONE), F.when(enough, ADVICE_ENOUGH).otherwise(ADVICE_SMALL)))
    return results.withColumn("recommendations", advice)


def required_sample_sizes(scenarios: DataFrame) -> DataFrame:
    """Rows per group needed; scenarios: metric, baseline_rate,
    expected_improvement, confidence_level, power.
    """
    p1 = F.col("baseline_rate")
    p2 = p1 * (1 + F.col("expected_improvement"))
    mean = (p1 + p2) / 2
    alpha = 1 - F.col("confidence_level")
    quantiles = stats.normal_quantile_of(1 - alpha / 2) + stats.normal_quantile_of(F.col("power"))
    rates = F.try_divide(2 * mean * (1 - mean) * quantiles * quantiles, (p2 - p1) * (p2 - p1))
    proportion = F.coalesce(F.col("metric").isin(*PROPORTION_METRICS), F.lit(False))
    # a Python function runs for the rows of either branch, and returns at once for null
    effect = F.when(~proportion, F.col("expected_improvement"))
    means = stats.t_sample_size_of(effect, alpha, F.col("power"))
    return scenarios.withColumn(
        "sample_size", F.when(proportion, F.ceil(rates)).otherwise(F.ceil(means)))


def power_analysis(scenarios: DataFrame) -> DataFrame:
    """Power of a t test; scenarios: expected_improvement, sample_size, alpha."""
    power = stats.t_power_of(
        F.col("expected_improvement"), F.col("sample_size").cast("double"), F.col("alpha"))
    return scenarios.withColumn("power", power).withColumn("adequate", F.col("power") >= ADEQUATE_POWER)


def test_statuses(log: DataFrame) -> DataFrame:
    """Current status of each test from its event log.

    ``log``: test_id, at, action (created, started, paused, stopped, completed).
    """
    def first(action: str) -> Column:
        return F.min(F.when(F.col("action") == action, F.col("at")))

    def last(action: str) -> Column:
        return F.max(F.when(F.col("action") == action, F.col("at")))

    status = F.max(F.struct("at", "action"))["action"]
    ended = F.greatest(last("stopped"), last("completed"))
    named = (F.when(status == "created", "draft").when(status == "started", "running")
             .otherwise(status))
    return log.groupBy("test_id").agg(
        named.alias("status"), first("created").alias("created_at"),
        first("started").alias("started_at"), ended.alias("ended_at"))


test_statuses.__test__ = False  # not a pytest test


def portfolio_counts(statuses: DataFrame) -> DataFrame:
    """Tests in total, not yet ended, running and ended."""
    over = F.col("status").isin("stopped", "completed")
    return statuses.agg(
        F.count("*").alias("total_tests"), F.count_if(~over).alias("active_tests"),
        F.count_if(F.col("status") == "running").alias("running_tests"),
        F.count_if(over).alias("completed_tests"))


def recent_results(results: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` finished analyses."""
    return results.orderBy(F.desc("completed_at"), F.desc("test_id")).limit(n)


def export_results(results: DataFrame, path: str, format: str = "json") -> None:
    """Write results as JSON lines or as CSV with nested fields as JSON text."""
    if format == "json":
        results.write.mode("overwrite").json(path)
    elif format == "csv":
        flat = [F.to_json(F.col(f.name)).alias(f.name)
                if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
                for f in results.schema.fields]
        results.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"Unsupported format: {format}")
