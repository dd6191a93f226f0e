"""A/B tests, indicators, sessions, stored results and streams over events."""

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import stats
from basketry.functions.scalars import hash_bucket, plain_key, result_key
from basketry.operators import abtest, catalog, kpi
from basketry.operators.abtest import TestConfig
from basketry.plans.feature_queries import USER_SNAPSHOTS, user_snapshots
from basketry.plans.registry import INTERACTIONS, ITEM_STATS, moment, query, rounded
from basketry.plans.user_queries import BASELINE, MERGED, SPLIT, baseline, merged_lists
from basketry.operators import features as feature_ops
from basketry.operators.evaluation import popularity_ranking
from basketry.session import cut_lineage, scratch_path
from basketry.sources import results
from basketry.sources.tables import Tables
from basketry.streaming import jobs, keyed_state

TESTS = (
    TestConfig("ranker_v2", "New ranker", 0.5, 1000,
               metrics=("ctr", "conversion_rate", "revenue_per_user")),
    TestConfig("cold_start", "Cold start boost", 0.3, 500, metrics=("ctr", "average_order_value")),
    TestConfig("blend", "Hybrid blend", 0.1, 100_000, metrics=("revenue_per_user", "ctr")),
)
Z95 = stats.normal_quantile(0.975)
Z80 = stats.normal_quantile(0.8)


def measured(t_events: DataFrame) -> DataFrame:
    """Events as A/B interactions: the metrics each kind of event speaks to."""
    kind = F.col("event_type")
    pairs = F.array_compact(F.array(
        F.when(kind.isin("view", "click"), F.struct(
            F.lit("ctr").alias("name"), (kind == "click").cast("double").alias("value"))),
        F.when(kind.isin("click", "purchase"), F.struct(
            F.lit("conversion_rate").alias("name"), (kind == "purchase").cast("double").alias("value"))),
        F.when(kind == "purchase", F.struct(
            F.lit("revenue_per_user").alias("name"), F.col("value").alias("value"))),
        F.when(kind == "purchase", F.struct(
            F.lit("average_order_value").alias("name"), F.col("value").alias("value")))))
    return t_events.select("user_id", "ts", F.map_from_entries(pairs).alias("metrics"))


def recorded(t: Tables) -> DataFrame:
    return abtest.record_interactions(measured(t.events()), TESTS)


_TEST_ROWS = ", ".join(
    f"('{c.test_id}', {c.traffic_split}, [{', '.join(repr(m) for m in c.metrics)}])" for c in TESTS)
RECORDED = f"""
tests(test_id, split, tracked) AS (VALUES {_TEST_ROWS}),
assigned AS (
  SELECT test_id, tracked, e.*,
         CASE WHEN ('0x' || substr(md5(test_id || ':' || user_id), 1, 8))::BIGINT % 100 < split * 100
              THEN 'test' ELSE 'control' END AS grp
  FROM events e, tests),
metric_rows AS (
  SELECT test_id, grp, ts, 'ctr' AS metric, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END::DOUBLE AS value
    FROM assigned WHERE event_type IN ('view', 'click') AND list_contains(tracked, 'ctr')
  UNION ALL
  SELECT test_id, grp, ts, 'conversion_rate', CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END::DOUBLE
    FROM assigned WHERE event_type IN ('click', 'purchase') AND list_contains(tracked, 'conversion_rate')
  UNION ALL
  SELECT test_id, grp, ts, m.metric, value FROM assigned,
    (VALUES ('revenue_per_user'), ('average_order_value')) m(metric)
    WHERE event_type = 'purchase' AND list_contains(tracked, m.metric)),
grouped AS (
  SELECT test_id, metric, grp, count(*) AS n, sum(value) AS total, avg(value) AS mean,
         stddev_pop(value) AS sp, stddev_samp(value) AS ss
  FROM metric_rows GROUP BY ALL),
wide AS (
  SELECT test_id, metric,
         max(n) FILTER (grp = 'control') AS n1, max(n) FILTER (grp = 'test') AS n2,
         max(total) FILTER (grp = 'control') AS x1, max(total) FILTER (grp = 'test') AS x2,
         max(mean) FILTER (grp = 'control') AS m1, max(mean) FILTER (grp = 'test') AS m2,
         max(ss) FILTER (grp = 'control') AS s1, max(ss) FILTER (grp = 'test') AS s2
  FROM grouped GROUP BY ALL)"""


@query("B1", f"""
WITH {RECORDED} SELECT DISTINCT test_id, user_id, grp AS "group" FROM assigned""")
def ab_assignment(t: Tables) -> DataFrame:
    return abtest.assign_users(t.events(), TESTS)


@query("B2 B8", f"""
WITH {RECORDED}
SELECT test_id, count(CASE WHEN grp = 'control' THEN 1 END) AS sample_size_control,
       count(CASE WHEN grp = 'test' THEN 1 END) AS sample_size_test FROM assigned GROUP BY 1""")
def ab_group_sizes(t: Tables) -> DataFrame:
    return abtest.group_sizes(recorded(t))


@query("A14 B2", f"""
WITH {RECORDED}
SELECT test_id, metric, grp AS "group", n, round(total, 4) AS total, round(mean, 6) AS mean,
       round(sp, 6) AS std_pop, round(ss, 6) AS std_samp FROM grouped""")
def ab_metric_stats(t: Tables) -> DataFrame:
    return rounded(abtest.metric_stats(recorded(t)), total=4)


@query("B3", f"""
WITH {RECORDED},
p AS (SELECT *, (x1 + x2) / (n1 + n2) AS pooled FROM wide WHERE metric IN ('ctr', 'conversion_rate'))
SELECT test_id, metric, n1 AS n_control, n2 AS n_test, round(m1, 6) AS control_value,
       round(m2, 6) AS test_value, round(m2 - m1, 6) AS difference,
       round((m2 - m1) / sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)), 6) AS test_statistic,
       round(sqrt(m1 * (1 - m1) / n1 + m2 * (1 - m2) / n2), 6) AS unpooled_error,
       round(m2 - m1 - {Z95} * sqrt(m1 * (1 - m1) / n1 + m2 * (1 - m2) / n2), 6) AS ci_lower,
       round(m2 - m1 + {Z95} * sqrt(m1 * (1 - m1) / n1 + m2 * (1 - m2) / n2), 6) AS ci_upper,
       round(CASE WHEN m1 > 0 THEN (m2 - m1) / m1 ELSE 0 END, 6) AS relative_improvement
FROM p""")
def ab_proportion_tests(t: Tables) -> DataFrame:
    compared = abtest.compare_proportions(abtest.metric_stats(recorded(t)))
    margin = Z95 * F.col("unpooled_error")
    return rounded(compared.drop("degrees_of_freedom").select(
        "*", (F.col("difference") - margin).alias("ci_lower"),
        (F.col("difference") + margin).alias("ci_upper")))


@query("B4", f"""
WITH {RECORDED},
c AS (SELECT *, ((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2) AS v FROM wide
      WHERE metric IN ('revenue_per_user', 'average_order_value'))
SELECT test_id, metric, n1 AS n_control, n2 AS n_test, round(m1, 6) AS control_value,
       round(m2, 6) AS test_value, round(m2 - m1, 6) AS difference,
       round((m2 - m1) / sqrt(v * (1 / n1 + 1 / n2)), 6) AS test_statistic,
       (n1 + n2 - 2)::DOUBLE AS degrees_of_freedom,
       round(sqrt(s1 * s1 / n1 + s2 * s2 / n2), 6) AS unpooled_error,
       round(CASE WHEN m1 <> 0 THEN (m2 - m1) / m1 ELSE 0 END, 6) AS relative_improvement
FROM c""")
def ab_mean_tests(t: Tables) -> DataFrame:
    return rounded(abtest.compare_means(abtest.metric_stats(recorded(t))))


def metric_results(t: Tables) -> DataFrame:
    configs = abtest.config_frame(t.spark, TESTS)
    return abtest.analyze_metrics(abtest.metric_stats(recorded(t)), configs)


@query("B3 B4")
def ab_metric_verdicts(t: Tables) -> DataFrame:
    return metric_results(t)


def test_results(t: Tables) -> DataFrame:
    return abtest.analyze_tests(
        metric_results(t), abtest.group_sizes(recorded(t)), abtest.config_frame(t.spark, TESTS),
        moment("2024-02-01 00:00:00"))


SIGNIFICANCE = f"""
stats AS (
  SELECT *, (x1 + x2) / (n1 + n2) AS pooled,
         ((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2) AS v, n1 + n2 - 2 AS df FROM wide),
tested AS (
  SELECT *, m2 - m1 AS d, metric IN ('ctr', 'conversion_rate') AS proportion,
    CASE WHEN metric IN ('ctr', 'conversion_rate') THEN (m2 - m1) / sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
         ELSE (m2 - m1) / sqrt(v * (1 / n1 + 1 / n2)) END AS statistic,
    CASE WHEN metric IN ('ctr', 'conversion_rate') THEN {Z95}
         ELSE {Z95} + ({Z95} ** 3 + {Z95}) / (4 * df) + (5 * {Z95} ** 5 + 16 * {Z95} ** 3 + 3 * {Z95}) / (96 * df * df)
    END AS critical,
    CASE WHEN metric IN ('ctr', 'conversion_rate') THEN sqrt(m1 * (1 - m1) / n1 + m2 * (1 - m2) / n2)
         ELSE sqrt(s1 * s1 / n1 + s2 * s2 / n2) END AS unpooled_error,
    CASE WHEN m1 <> 0 THEN (m2 - m1) / m1 ELSE 0 END AS lift FROM stats)"""


@query("B3 B4 B5", f"""
WITH {RECORDED}, {SIGNIFICANCE}
SELECT test_id, metric, coalesce(abs(statistic) > critical, FALSE) AS significant, d > 0 AS test_is_higher FROM tested""")
def ab_significance(t: Tables) -> DataFrame:
    """Significance at 95 %, which in SQL is the statistic against a critical value."""
    return metric_results(t).select(
        "test_id", "metric", "significant", (F.col("difference") > 0).alias("test_is_higher"))


@query("B3 B4", f"""
WITH {RECORDED}, {SIGNIFICANCE}
SELECT test_id, metric, CASE WHEN proportion THEN 'proportion' ELSE 'continuous' END AS kind, n1 AS n_control, n2 AS n_test,
       round(m1, 6) AS control_value, round(m2, 6) AS test_value, round(d, 6) AS difference,
       round(statistic, 6) AS test_statistic, round(d - critical * unpooled_error, 2) AS ci_lower,
       round(d + critical * unpooled_error, 2) AS ci_upper, round(lift, 6) AS relative_improvement,
       coalesce(abs(statistic) > critical, FALSE) AS significant, TRUE AS p_value_agrees
FROM tested""")
def ab_metric_table(t: Tables) -> DataFrame:
    """Everything the analysis says of each metric; the p value is held against the statistic."""
    rows = metric_results(t)
    agrees = (F.col("p_value") < 0.05) == F.col("significant")
    return rounded(rows.withColumn("p_value_agrees", agrees & F.col("p_value").between(0, 1)).drop("p_value"),
                   ci_lower=2, ci_upper=2)


@query("B5 B9", f"""
WITH {RECORDED}, {SIGNIFICANCE},
sized AS (
  SELECT test_id, count(CASE WHEN grp = 'control' THEN 1 END) AS sample_size_control,
         count(CASE WHEN grp = 'test' THEN 1 END) AS sample_size_test FROM assigned GROUP BY 1),
planned(test_id, head, minimum) AS (VALUES {", ".join(f"('{c.test_id}', '{c.metrics[0]}', {c.minimum_sample_size})" for c in TESTS)}),
judged AS (
  SELECT p.test_id, s.sample_size_control, s.sample_size_test, minimum,
         (SELECT coalesce(bool_or(abs(statistic) > critical), FALSE) FROM tested x WHERE x.test_id = p.test_id) AS significant,
         (SELECT lift FROM tested x WHERE x.test_id = p.test_id AND x.metric = p.head) AS effect
  FROM planned p JOIN sized s USING (test_id) WHERE sample_size_control > 0 AND sample_size_test > 0)
SELECT test_id, significant AS statistical_significance, round(coalesce(effect, 0), 6) AS effect_size,
       sample_size_control, sample_size_test, minimum AS minimum_sample_size,
       CASE WHEN significant AND effect > 0 THEN '{abtest.VERDICT_BETTER}' WHEN significant AND effect < 0 THEN '{abtest.VERDICT_WORSE}'
            ELSE '{abtest.VERDICT_NONE}' END AS recommendation,
       CASE WHEN significant AND effect > 0 THEN '{abtest.ADVICE_BETTER}' WHEN significant THEN '{abtest.ADVICE_WORSE}'
            ELSE '{abtest.ADVICE_NONE}; ' || CASE WHEN sample_size_control + sample_size_test >= minimum
              THEN '{abtest.ADVICE_ENOUGH}' ELSE '{abtest.ADVICE_SMALL}' END END AS recommendations
FROM judged""")
def ab_report_texts(t: Tables) -> DataFrame:
    """Verdict and advice of every test."""
    return rounded(abtest.report_recommendations(test_results(t)).select(
        "test_id", "statistical_significance", "effect_size", "sample_size_control", "sample_size_test",
        "minimum_sample_size", "recommendation", F.array_join("recommendations", "; ").alias("recommendations")))


@query("S10", f"""
WITH {RECORDED} SELECT DISTINCT test_id, TRUE AS same FROM assigned""")
def ab_export_round_trip(t: Tables) -> DataFrame:
    """Whether results come back from JSON and from CSV as they were."""
    path = scratch_path(t.spark, "export")
    report = cut_lineage(abtest.report_recommendations(test_results(t)), "report")
    abtest.export_results(report, f"{path}/json", "json")
    abtest.export_results(report, f"{path}/csv", "csv")
    back = t.spark.read.schema(report.schema).json(f"{path}/json")
    text = t.spark.read.option("header", True).csv(f"{path}/csv").select(
        F.col("test_id").alias("id"), F.col("recommendations").alias("advice"), F.col("effect_size").alias("effect"))
    told = report.select("test_id", F.col("effect_size").alias("was"), F.col("recommendations").alias("advised"))
    return told.join(back, "test_id").join(text, F.col("test_id") == F.col("id")).select(
        "test_id", (F.col("was").eqNullSafe(F.col("effect_size")) & (F.col("advised") == F.col("recommendations"))
                    & (F.from_json("advice", "array<string>") == F.col("advised"))
                    & (F.col("effect").cast("double").eqNullSafe(F.col("was")))).alias("same"))


@query("B5 B9")
def ab_reports(t: Tables) -> DataFrame:
    return abtest.report_recommendations(test_results(t)).withColumn(
        "recommendations", F.array_join("recommendations", "; "))


@query("S10")
def ab_exported_results(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "export")
    report = abtest.report_recommendations(test_results(t))
    abtest.export_results(report, f"{path}/json", "json")
    abtest.export_results(report, f"{path}/csv", "csv")
    from_json = t.spark.read.schema(report.schema).json(f"{path}/json").select("test_id", "effect_size")
    from_csv = t.spark.read.option("header", True).csv(f"{path}/csv").select("test_id", "recommendations")
    return from_json.join(from_csv, "test_id")


DAILY_RATES = """
daily AS (SELECT ts::DATE AS day, count(CASE WHEN event_type = 'click' THEN 1 END)
                 / count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS p1
          FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)"""


def daily_baselines(t: Tables) -> DataFrame:
    clicks_and_views = t.events().where(F.col("event_type").isin("click", "view"))
    return clicks_and_views.groupBy(F.to_date("ts").alias("day")).agg(
        F.try_divide(F.count_if(F.col("event_type") == "click"), F.count("*")).alias("baseline_rate"))


@query("B6", f"""
WITH {DAILY_RATES},
s AS (SELECT day, p1, p1 * 1.1 AS p2, (p1 + p1 * 1.1) / 2 AS m FROM daily)
SELECT day, round(p1, 6) AS baseline_rate,
       ceil(2 * m * (1 - m) * ({Z95} + {Z80}) * ({Z95} + {Z80}) / ((p2 - p1) * (p2 - p1)))::BIGINT AS sample_size
FROM s""")
def ab_sample_sizes(t: Tables) -> DataFrame:
    scenarios = daily_baselines(t).select(
        "day", F.lit("ctr").alias("metric"), "baseline_rate",
        F.lit(0.1).alias("expected_improvement"), F.lit(0.95).alias("confidence_level"),
        F.lit(0.8).alias("power"))
    return rounded(abtest.required_sample_sizes(scenarios).select(
        "day", "baseline_rate", F.col("sample_size").cast("bigint").alias("sample_size")))


# Effects, and rows per group that a two-sided t test at 0.05 needs to show them with a power of 0.8: fixed values.
SIZES_OF_MEANS = {"view": (0.1, 1571), "click": (0.2, 394), "purchase": (0.5, 64), "signup": (0.8, 26), "error": (1.0, 17)}


@query("B6", f"""
SELECT event_type, count(*) AS events, n::BIGINT AS sample_size, count(*) >= 2 * n AS enough FROM events JOIN (VALUES
  {", ".join(f"('{k}', {n})" for k, (_, n) in SIZES_OF_MEANS.items())}) t(event_type, n) USING (event_type) GROUP BY event_type, n""")
def ab_sample_sizes_of_means(t: Tables) -> DataFrame:
    """Sample sizes of continuous metrics, for the effect looked for in each type of event, and whether there are enough."""
    effect = None
    for kind, (size, _) in SIZES_OF_MEANS.items():
        effect = (F.when if effect is None else effect.when)(F.col("event_type") == kind, size)
    scenarios = t.events().groupBy("event_type").agg(F.count("*").alias("events")).select(
        "event_type", "events", F.lit("revenue_per_user").alias("metric"), F.lit(None).cast("double").alias("baseline_rate"),
        effect.alias("expected_improvement"), F.lit(0.95).alias("confidence_level"), F.lit(0.8).alias("power"))
    found = abtest.required_sample_sizes(scenarios.where("expected_improvement IS NOT NULL"))
    size = F.col("sample_size").cast("bigint")
    return found.select("event_type", "events", size.alias("sample_size"), (F.col("events") >= 2 * size).alias("enough"))


@query("B7")
def ab_power(t: Tables) -> DataFrame:
    per_day = t.events().groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("sample_size"))
    return abtest.power_analysis(per_day.select(
        "day", "sample_size", F.lit(0.2).alias("expected_improvement"), F.lit(0.05).alias("alpha")))


@query("B7", """
WITH sizes AS (SELECT ts::DATE::VARCHAR AS label, count(*) AS sample_size FROM events GROUP BY 1
               UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1)
SELECT label, sample_size, sample_size >= 394 AS adequate FROM sizes""")
def ab_power_adequate(t: Tables) -> DataFrame:
    """Whether groups of these sizes show an effect of 0.2 with a power of 0.8: from 394 on."""
    labels = (F.to_date("ts").cast("string"), F.col("event_type"))
    sizes = [t.events().groupBy(c.alias("label")).agg(F.count("*").alias("sample_size")) for c in labels]
    scenarios = sizes[0].unionByName(sizes[1])
    return abtest.power_analysis(scenarios.select(
        "label", "sample_size", F.lit(0.2).alias("expected_improvement"), F.lit(0.05).alias("alpha"))).select(
        "label", "sample_size", "adequate")


def test_log(t: Tables) -> DataFrame:
    """Events as a log of test actions, one test per value of k."""
    action = (F.when(F.col("event_type") == "signup", "created")
              .when(F.col("event_type") == "view", "started")
              .when(F.col("event_type") == "click", "paused")
              .when(F.col("event_type") == "purchase", "stopped").otherwise("completed"))
    return t.events().select(
        F.get_json_object("props", "$.k").alias("test_id"), F.col("ts").alias("at"),
        action.alias("action"))


STATUSES = """
log AS (
  SELECT json_extract_string(props, '$.k') AS test_id, ts,
         CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'started'
              WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'stopped' ELSE 'completed' END AS action
  FROM events),
statuses AS (
  SELECT test_id,
         CASE arg_max(action, ts) WHEN 'created' THEN 'draft' WHEN 'started' THEN 'running'
              ELSE arg_max(action, ts) END AS status,
         min(ts) FILTER (action = 'created') AS created_at,
         min(ts) FILTER (action = 'started') AS started_at,
         max(ts) FILTER (action IN ('stopped', 'completed')) AS ended_at
  FROM log GROUP BY 1)"""


@query("B8 W2", f"WITH {STATUSES} SELECT * FROM statuses")
def ab_test_statuses(t: Tables) -> DataFrame:
    return abtest.test_statuses(test_log(t))


@query("A15", f"""
WITH {STATUSES}
SELECT count(*) AS total_tests,
       count(CASE WHEN status NOT IN ('stopped', 'completed') THEN 1 END) AS active_tests,
       count(CASE WHEN status = 'running' THEN 1 END) AS running_tests,
       count(CASE WHEN status IN ('stopped', 'completed') THEN 1 END) AS completed_tests FROM statuses""")
def ab_portfolio(t: Tables) -> DataFrame:
    return abtest.portfolio_counts(abtest.test_statuses(test_log(t)))


@query("A15", f"""
WITH {STATUSES}
SELECT test_id, status, ended_at AS completed_at FROM statuses WHERE status IN ('stopped', 'completed')
ORDER BY ended_at DESC, test_id DESC LIMIT 5""")
def ab_recent_results(t: Tables) -> DataFrame:
    ended = abtest.test_statuses(test_log(t)).where(F.col("status").isin("stopped", "completed"))
    return abtest.recent_results(ended.select("test_id", "status", F.col("ended_at").alias("completed_at")))


# --------------------------------------------------------------------------
# indicators


@query("A12", """
WITH u AS (
  SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS v,
         count(CASE WHEN event_type = 'click' THEN 1 END) AS c,
         count(CASE WHEN event_type = 'purchase' THEN 1 END) AS p
  FROM events GROUP BY 1)
SELECT sum(v)::BIGINT AS views, sum(c)::BIGINT AS clicks, sum(p)::BIGINT AS purchases,
       count(*) AS known_users, count(CASE WHEN p > 0 THEN 1 END) AS active_users,
       round(100 * sum(c) / sum(v), 6) AS ctr, round(100 * sum(p) / sum(c), 6) AS conversion_rate,
       round(100 * (sum(c) + sum(p)) / sum(v), 6) AS engagement_rate,
       round(100 * count(CASE WHEN p > 0 THEN 1 END) / count(*), 6) AS retention_rate
FROM u""")
def business_kpis(t: Tables) -> DataFrame:
    return rounded(kpi.business_kpis(t.events()))


@query("A16", """
WITH last AS (SELECT max(ts)::DATE AS d FROM events),
spine AS (SELECT (d - i::INTEGER)::DATE AS day FROM last, range(0, 30) r(i)),
n AS (SELECT ts::DATE AS day, count(*) AS activity,
             count(CASE WHEN event_type = 'view' THEN 1 END) AS v,
             count(CASE WHEN event_type = 'click' THEN 1 END) AS c,
             count(CASE WHEN event_type = 'purchase' THEN 1 END) AS p FROM events GROUP BY 1)
SELECT day, coalesce(activity, 0) AS activity, coalesce(v, 0) AS views, coalesce(c, 0) AS clicks,
       coalesce(p, 0) AS purchases,
       coalesce(round(100 * c / nullif(v, 0), 6), 0) AS ctr,
       coalesce(round(100 * p / nullif(c, 0), 6), 0) AS conversion_rate,
       coalesce(round(100 * (c + p) / nullif(v, 0), 6), 0) AS engagement_rate
FROM spine LEFT JOIN n USING (day)""")
def daily_trend(t: Tables) -> DataFrame:
    return rounded(kpi.daily_trend(t.events()))


@query("A16", f"""
WITH {INTERACTIONS}
SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM interactions GROUP BY 1""")
def category_share(t: Tables) -> DataFrame:
    return rounded(catalog.category_share(t.interactions()))


def requests(t: Tables) -> DataFrame:
    """Events as requests: value is the latency, k tells whether it was stored."""
    return t.events().select(
        "ts", F.col("value").alias("latency_ms"),
        (F.get_json_object("props", "$.k").cast("int") < 80).alias("cached"),
        (F.col("event_type") == "error").alias("failed"))


@query("A17", """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS requests,
       round(avg(value), 6) AS latency_avg,
       quantile_disc(value, 0.95) AS latency_p95, quantile_disc(value, 0.99) AS latency_p99,
       round(count(CASE WHEN json_extract_string(props, '$.k')::INTEGER < 80 THEN 1 END) / count(*), 6) AS hit_rate,
       round(count(*) / 86400, 6) AS requests_per_second,
       round(count(CASE WHEN event_type = 'error' THEN 1 END) / count(*), 6) AS error_rate
FROM events GROUP BY 1""")
def service_metrics(t: Tables) -> DataFrame:
    return rounded(kpi.service_metrics(requests(t)))


@query("R5", """
SELECT count(CASE WHEN k < 80 THEN 1 END) AS hits, count(CASE WHEN k >= 80 THEN 1 END) AS misses,
       round(count(CASE WHEN k < 80 THEN 1 END) / count(k), 6) AS hit_rate
FROM (SELECT json_extract_string(props, '$.k')::INTEGER AS k FROM events)""")
def stored_result_hit_rate(t: Tables) -> DataFrame:
    return rounded(kpi.hit_rate(requests(t)))


SESSIONS = """
marked AS (
  SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked),
sessions AS (
  SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count,
         sum(value) AS total_value, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS duration_seconds
  FROM numbered GROUP BY user_id, s)"""


@query("T5", f"""
WITH {SESSIONS}
SELECT user_id, session_start, session_end, event_count, round(total_value, 6) AS total_value,
       round(duration_seconds, 6) AS duration_seconds FROM sessions""")
def user_sessions(t: Tables) -> DataFrame:
    return rounded(kpi.sessions(t.events()))


@query("T5", f"""
WITH {SESSIONS}
SELECT count(*) AS session_count, round(avg(duration_seconds), 6) AS session_duration,
       round(count(CASE WHEN event_count = 1 THEN 1 END) / count(*), 6) AS bounce_rate FROM sessions""")
def session_metrics(t: Tables) -> DataFrame:
    return rounded(kpi.session_metrics(kpi.sessions(t.events())))


# --------------------------------------------------------------------------
# stored results


@query("R6", """
SELECT c_custkey AS user_id,
       'recs:' || c_custkey || ':' || substr(md5('{"model": "hybrid", "segment": "' || c_mktsegment || '"}'), 1, 8)
         AS result_key,
       'features:user:' || c_custkey || ':segment=' || c_mktsegment AS plain_key
FROM customer""")
def result_keys(t: Tables) -> DataFrame:
    return t.read("customer").select(
        F.col("c_custkey").alias("user_id"),
        result_key("recs", F.col("c_custkey"), {"model": "hybrid", "segment": F.col("c_mktsegment")})
        .alias("result_key"),
        plain_key("features", F.lit("user"), F.col("c_custkey"), segment=F.col("c_mktsegment"))
        .alias("plain_key"))


def _stored_lists(t: Tables) -> results.ResultStore:
    """Merged lists under two model names, each stored when the user last came."""
    lists = merged_lists(t)
    served = F.when(hash_bucket(F.col("user_id").cast("string")) < 25, "hybrid").otherwise("collaborative")
    lists = lists.withColumn("model", served)
    rows = results.recommendation_rows(lists)
    seen = t.interactions(catalog=False).groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    store = results.ResultStore(t.spark, scratch_path(t.spark, "results"))
    store.write("recommendations", results.stamped(
        rows.join(seen, "user_id"), "recommendations", F.col("last_seen"), 180 * 86400,
    ).drop("last_seen"), "model")
    return store


STORED = """
seen AS (SELECT user_id, max(ts) AS cached_at FROM interactions GROUP BY 1),
stored AS (
  SELECT m.user_id, CASE WHEN ('0x' || substr(md5(m.user_id::VARCHAR), 1, 8))::BIGINT % 100 < 25
              THEN 'hybrid' ELSE 'collaborative' END AS model,
         m.rank::INTEGER AS rank, m.item_id, cached_at
  FROM merged m JOIN seen USING (user_id))"""


@query("R1 R2 T4", f"""
WITH {INTERACTIONS}, {MERGED}, {STORED}
SELECT user_id, model, rank, item_id, 'recs:' || user_id || ':' || substr(md5('{{"model": "' || model || '"}}'), 1, 8) AS key
FROM stored WHERE cached_at + INTERVAL 180 DAY > TIMESTAMP '2001-09-01'""")
def stored_recommendations(t: Tables) -> DataFrame:
    rows = _stored_lists(t).read("recommendations", moment("2001-09-01 00:00:00"))
    return rows.select("user_id", "model", "key", F.explode("recommendations").alias("r")).select(
        "user_id", "model", "r.rank", "r.item_id", "key")


@query("R3", f"""
WITH {INTERACTIONS}, {MERGED}, {STORED}
SELECT user_id, model, count(*) AS entries FROM stored
WHERE model <> 'hybrid' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
GROUP BY ALL""")
def recommendations_after_invalidation(t: Tables) -> DataFrame:
    store = _stored_lists(t)
    gone = t.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    store.drop_rows("recommendations", "model", gone, "user_id")
    store.drop_partition("recommendations", "model", "hybrid")
    return store.read("recommendations").select(
        "user_id", "model", F.size("recommendations").cast("bigint").alias("entries"))


@query("R4 R2", f"""
WITH {INTERACTIONS}, {ITEM_STATS},
top AS (SELECT item_id FROM item_stats ORDER BY round(popularity_score, 9) DESC, item_id LIMIT 100)
SELECT item_id, round(avg_rating, 6) AS avg_rating, review_count, 1800 AS ttl_seconds
FROM item_stats WHERE item_id IN (SELECT item_id FROM top)""")
def warmed_item_features(t: Tables) -> DataFrame:
    interactions = t.interactions(catalog=False)
    warm = results.warm(feature_ops.item_stats(interactions), popularity_ranking(interactions, 100), "item_id")
    store = results.ResultStore(t.spark, scratch_path(t.spark, "warm"))
    rows = results.stamped(warm, "features", moment("2001-09-01 00:00:00")).withColumn("kind", F.lit("item"))
    store.write("features", rows, "kind")
    return rounded(store.read("features", moment("2001-09-01 00:20:00")).select(
        "item_id", "avg_rating", "review_count", "ttl_seconds"))


@query("R4 R2", f"""
WITH {INTERACTIONS}
SELECT user_id, round(avg(rating), 6) AS avg_rating, count(*) AS rating_count, 1800 AS ttl_seconds
FROM interactions GROUP BY 1 ORDER BY rating_count DESC, user_id LIMIT 100""")
def warmed_user_features(t: Tables) -> DataFrame:
    """Features of the most active users, beside those of other users that have expired."""
    stats = t.interactions(catalog=False).groupBy("user_id").agg(
        F.avg("rating").alias("avg_rating"), F.count("*").alias("rating_count"))
    active = stats.orderBy(F.desc("rating_count"), "user_id").limit(100)
    store = results.ResultStore(t.spark, scratch_path(t.spark, "warm"))
    cold = stats.join(active, "user_id", "left_anti")
    rows = results.stamped(results.warm(stats, active, "user_id"), "features", moment("2001-09-01 00:00:00")).unionByName(
        results.stamped(cold, "features", moment("2001-08-31 23:50:00"))).withColumn("kind", F.lit("user"))
    store.write("features", rows, "kind")
    return rounded(store.read("features", moment("2001-09-01 00:20:00")).select(
        "user_id", "avg_rating", "rating_count", "ttl_seconds"))


@query("R2 T4", f"""
WITH {INTERACTIONS}, {SPLIT}, {BASELINE}
SELECT user_id, item_id, round(prediction, 6) AS prediction, 7200 AS ttl_seconds FROM predicted
WHERE user_id % 2 = 0""")
def stored_predictions(t: Tables) -> DataFrame:
    """Batch predictions read back an hour later; those of odd users are three hours old by then."""
    stored = F.when(F.col("user_id") % 2 == 0, moment("2001-09-01 00:00:00")).otherwise(moment("2001-08-31 22:00:00"))
    rows = results.stamped(baseline(t).select("user_id", "item_id", "prediction"), "predictions", stored)
    store = results.ResultStore(t.spark, scratch_path(t.spark, "predictions"))
    store.write("predictions", rows.withColumn("model", F.lit("bias")), "model")
    return rounded(store.read("predictions", moment("2001-09-01 01:00:00")).select(
        "user_id", "item_id", "prediction", "ttl_seconds"))


@query("R2 T4", f"""
WITH {RECORDED}
SELECT test_id, metric, grp AS "group", n, round(total, 4) AS total, 86400 AS ttl_seconds FROM grouped
WHERE metric <> 'ctr'""")
def stored_ab_results(t: Tables) -> DataFrame:
    """A/B results read back twelve hours later; those of one metric are older than a day by then."""
    stored = F.when(F.col("metric") != "ctr", moment("2001-09-01 00:00:00")).otherwise(moment("2001-08-31 00:00:00"))
    rows = results.stamped(abtest.metric_stats(recorded(t)), "ab_test", stored)
    store = results.ResultStore(t.spark, scratch_path(t.spark, "ab"))
    store.write("ab_test", rows, "test_id")
    return rounded(store.read("ab_test", moment("2001-09-01 12:00:00")).select(
        "test_id", "metric", "group", "n", "total", "ttl_seconds"), total=4)


@query("S8 W2", f"""
WITH {INTERACTIONS}, {USER_SNAPSHOTS}
SELECT user_id, event_timestamp, round(avg_rating, 6) AS avg_rating, rating_count FROM snapshots
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1""")
def ingested_user_features(t: Tables) -> DataFrame:
    store = results.ResultStore(t.spark, scratch_path(t.spark, "features"))
    latest = results.ingest_features(store, "user_features", "user_id", user_snapshots(t))
    return rounded(latest.select("user_id", "event_timestamp", "avg_rating", "rating_count"))


# --------------------------------------------------------------------------
# streams: the event log replayed


def _replay(t: Tables) -> DataFrame:
    # written as a pattern, the path may be one file or a folder of files
    return jobs.event_stream(t.spark, t.path("event[s]"))


@query("T1", f"""
WITH {RECORDED},
closed AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events)
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, test_id, metric, grp AS "group", count(*) AS n,
       round(sum(value), 4) AS total, round(sum(value * value), 4) AS squares
FROM metric_rows, closed WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= w GROUP BY ALL""")
def ab_metrics_stream(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "ab-stream")
    stream = jobs.windowed_metrics(abtest.record_interactions(measured(_replay(t)), TESTS))
    jobs.run_to_files(stream, f"{out}/rows", f"{out}/state")
    rows = t.spark.read.parquet(f"{out}/rows")
    return rounded(rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 4)


@query("T3", """
SELECT user_id, count(*) AS event_count,
       round(count(*) / (date_sub('day', min(ts), max(ts)) + 1), 6) AS activity_level,
       date_sub('day', max(ts), TIMESTAMP '2024-02-01') AS days_since_last
FROM events GROUP BY 1""")
def user_activity_stream(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "activity")
    jobs.run_updates_to_files(jobs.activity_per_user(_replay(t)), f"{out}/rows", f"{out}/state")
    activity = jobs.latest_of_batches(t.spark, f"{out}/rows", "user_id")
    return rounded(jobs.with_activity_features(activity, F.lit("2024-02-01 00:00:00").cast("timestamp")))


@query("T2 W2", """
SELECT user_id, event_type, max(ts) AS event_timestamp, arg_max(value, ts) AS last_value
FROM events GROUP BY ALL""")
def pushed_features_stream(t: Tables) -> DataFrame:
    """The last value of every user and type of event, pushed twice and kept as a history."""
    entity = F.concat_ws(":", "user_id", "event_type")
    update = _replay(t).select(
        entity.alias("entity"), "user_id", "event_type", F.col("ts").alias("event_timestamp"),
        F.col("ts").alias("created_timestamp"), F.col("value").alias("last_value"))
    out = scratch_path(t.spark, "push")
    twice = update.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_again")
    jobs.push_features(twice, "entity", f"{out}/rows", f"{out}/state")
    latest = jobs.latest_pushed(t.spark, f"{out}/rows", "entity")
    return latest.select("user_id", "event_type", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"),
                         "last_value")


@query("T2 W2", """
SELECT user_id, ts AS event_timestamp, event_type, value AS last_value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC NULLS LAST) = 1""")
def pushed_events_state(t: Tables) -> DataFrame:
    """The last event of every user as the state store holds it, after two runs: the second brings the other half of the log,
    late, and a third of the first half again."""
    out = scratch_path(t.spark, "state")
    update = t.events().select("user_id", F.col("ts").cast("timestamp").alias("event_timestamp"), "event_type",
                               F.col("value").alias("last_value"))
    part = F.pmod(F.xxhash64("user_id", "event_timestamp", "event_type"), F.lit(6))
    for some in (part < 3, part > 1):
        update.where(some).write.mode("append").parquet(f"{out}/log")
        pushed = t.spark.readStream.schema(update.schema).parquet(f"{out}/log")
        keyed_state.run_state(keyed_state.newest_rows(pushed, "user_id"), f"{out}/state")
    latest = keyed_state.state_table(t.spark, f"{out}/state", "newest")
    return latest.select("user_id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"),
                         "event_type", "last_value")


@query("T3", """
WITH seen AS (
  SELECT user_id, count(*) AS event_count,
         round(count(*) / (date_sub('day', min(ts), max(ts)) + 1), 6) AS activity_level, max(ts) AS last_ts
  FROM events GROUP BY 1)
SELECT user_id, event_count, activity_level, last_ts,
       last_ts + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS retired FROM seen""")
def user_activity_state(t: Tables) -> DataFrame:
    """Running activity of every user from the state store; users idle for six hours were given out and forgotten."""
    out = scratch_path(t.spark, "activity-state")
    stream = keyed_state.activity_rows(_replay(t), idle=timedelta(hours=6))
    keyed_state.run_state(stream, f"{out}/state", f"{out}/retired")
    live = keyed_state.state_table(t.spark, f"{out}/state", "activity").withColumn("retired", F.lit(False))
    gone = t.spark.read.schema(live.drop("retired").schema).parquet(f"{out}/retired").withColumn("retired", F.lit(True))
    span = F.timestamp_diff("DAY", F.col("first_ts"), F.col("last_ts")) + 1
    return rounded(live.unionByName(gone).select(
        "user_id", "event_count", (F.col("event_count") / span).alias("activity_level"),
        F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "retired"))


@query("T5", f"""
WITH {SESSIONS}, closed AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events)
SELECT user_id, session_start, session_end, event_count, round(total_value, 6) AS total_value
FROM sessions, closed WHERE session_end + INTERVAL 30 MINUTE <= w""")
def sessions_stream(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "sessions")
    jobs.run_to_files(jobs.session_stream(_replay(t)), f"{out}/rows", f"{out}/state")
    rows = t.spark.read.parquet(f"{out}/rows")
    return rounded(rows.select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"), "event_count", "total_value"))


@query("T1", f"""
WITH {RECORDED}
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, test_id, metric, grp AS "group", count(*) AS n,
       round(sum(value), 4) AS total, round(sum(value * value), 4) AS squares
FROM metric_rows GROUP BY ALL""")
def ab_metrics_stream_to_end(t: Tables) -> DataFrame:
    """All windows of the log, the open ones as far as they have come."""
    out = scratch_path(t.spark, "ab-stream")
    stream = jobs.windowed_metrics(abtest.record_interactions(measured(_replay(t)), TESTS))
    jobs.run_updates_to_files(stream, f"{out}/rows", f"{out}/state")
    rows = jobs.latest_of_batches(t.spark, f"{out}/rows", "window_start", "test_id", "metric", "group")
    return rounded(rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 4)


@query("T2 W2", """
SELECT user_id, ts AS event_timestamp, event_type, value AS last_value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC NULLS LAST) = 1""")
def pushed_events_stream(t: Tables) -> DataFrame:
    """The last event of every user, of any type, kept in a latest table."""
    update = _replay(t).select("user_id", F.col("ts").alias("event_timestamp"), "event_type",
                               F.col("value").alias("last_value"))
    out = scratch_path(t.spark, "push")
    jobs.upsert_latest(update, "user_id", f"{out}/latest", f"{out}/state")
    latest = jobs.latest_upserted(t.spark, f"{out}/latest")
    return latest.select("user_id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"),
                         "event_type", "last_value")


@query("T5", f"""
WITH {SESSIONS}
SELECT user_id, session_start, session_end, event_count, round(total_value, 6) AS total_value FROM sessions""")
def sessions_stream_to_end(t: Tables) -> DataFrame:
    """All sessions of the log, those open at its end too."""
    out = scratch_path(t.spark, "sessions")
    jobs.run_to_end(t.spark, t.path("event[s]"), jobs.session_stream, f"{out}/rows", f"{out}/state")
    rows = t.spark.read.parquet(f"{out}/rows")
    return rounded(rows.select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"), "event_count", "total_value"))
