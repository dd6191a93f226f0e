from datetime import datetime

import pytest
from pyspark.sql import functions as F

from basketry.functions import stats
from basketry.operators import abtest
from basketry.operators.abtest import TestConfig

TESTS = (TestConfig("t", "Test", 0.5, 100, metrics=("ctr", "revenue_per_user")),
         TestConfig("empty", "No test group", 0.0, 10, metrics=("ctr",)))


def test_tails_match_tables():
    assert stats.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert stats.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    for df, value in ((1, 12.706205), (5, 2.570582), (10, 2.228139), (30, 2.042272), (120, 1.979930)):
        assert stats.t_quantile(0.975, df) == pytest.approx(value, abs=1e-5)
        assert stats.t_two_sided(value, df) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_two_sided(0, 7) == pytest.approx(1.0)


def test_power_matches_tables():
    # two-sided t test, alpha .05, power .8
    assert stats.t_test_sample_size(0.5, 0.05, 0.8) == pytest.approx(63.7656, abs=1e-2)
    assert stats.t_test_sample_size(0.2, 0.05, 0.8) == pytest.approx(393.4057, abs=1e-1)
    assert stats.t_test_sample_size(0.8, 0.05, 0.8) == pytest.approx(25.5246, abs=1e-2)
    assert stats.t_test_power(0.5, 64, 0.05) == pytest.approx(0.8015, abs=1e-4)


def test_sample_sizes(spark):
    rows = spark.createDataFrame(
        [("ctr", 0.1, 0.1, 0.95, 0.8), ("session_duration", 0.0, 0.2, 0.95, 0.8), ("ctr", 0.1, 0.0, 0.95, 0.8)],
        "metric string, baseline_rate double, expected_improvement double, confidence_level double, power double")
    sizes = [r["sample_size"] for r in abtest.required_sample_sizes(rows).collect()]
    # 2 * .105 * .895 * (1.959964 + .841621)^2 / .01^2 = 14751.6...
    assert sizes == [14752, 394, None]


def test_power_rows(spark):
    rows = spark.createDataFrame([(0.5, 64, 0.05), (0.1, 64, 0.05)],
                                 "expected_improvement double, sample_size int, alpha double")
    assert [r["adequate"] for r in abtest.power_analysis(rows).collect()] == [True, False]


def test_assignment_is_stable_and_near_the_split(spark):
    users = spark.range(4000).select(F.col("id").alias("user_id"))
    tests = (TestConfig("x", "x", 0.3, 1), TestConfig("y", "y", 0.3, 1))
    groups = {}
    for r in abtest.assign_users(users, tests).collect():
        groups.setdefault(r["test_id"], {})[r["user_id"]] = r["group"]
    for by_user in groups.values():
        assert sum(g == "test" for g in by_user.values()) == pytest.approx(1200, abs=120)
    assert groups["x"] != groups["y"]  # a user's groups in two tests are unrelated


def recorded(spark, rows):
    return spark.createDataFrame(rows, "test_id string, group string, metrics map<string,double>")


def test_z_and_t_by_hand(spark):
    rows = [("t", "control", {"ctr": 1.0 if i < 20 else 0.0}) for i in range(100)]
    rows += [("t", "test", {"ctr": 1.0 if i < 35 else 0.0}) for i in range(100)]
    rows += [("t", "control", {"revenue_per_user": v}) for v in (1.0, 2.0, 3.0, 4.0)]
    rows += [("t", "test", {"revenue_per_user": v}) for v in (3.0, 4.0, 5.0, 6.0)]
    grouped = abtest.metric_stats(recorded(spark, rows))
    out = {r["metric"]: r for r in abtest.analyze_metrics(grouped, abtest.config_frame(spark, TESTS)).collect()}
    z = out["ctr"]
    assert z["test_statistic"] == pytest.approx(0.15 / (0.275 * 0.725 * 0.02) ** 0.5)
    assert z["p_value"] == pytest.approx(0.017533, abs=1e-5) and z["significant"]
    error = (0.2 * 0.8 / 100 + 0.35 * 0.65 / 100) ** 0.5
    assert z["ci_lower"] == pytest.approx(0.15 - 1.959964 * error, abs=1e-6)
    assert z["relative_improvement"] == pytest.approx(0.75)
    t = out["revenue_per_user"]
    assert t["test_statistic"] == pytest.approx(2.19089, abs=1e-5)
    assert t["p_value"] == pytest.approx(0.070988, abs=1e-5) and not t["significant"]
    assert t["ci_upper"] == pytest.approx(2 + 2.446912 * (2 * (5 / 3) / 4) ** 0.5, abs=1e-5)


def test_analysis_and_report(spark):
    rows = [("t", "control", {"ctr": 1.0 if i < 200 else 0.0}) for i in range(1000)]
    rows += [("t", "test", {"ctr": 1.0 if i < 350 else 0.0}) for i in range(1000)]
    rows += [("empty", "control", {"ctr": 1.0}), ("empty", "control", {"ctr": 0.0})]
    events = recorded(spark, rows)
    configs = abtest.config_frame(spark, TESTS)
    metrics = abtest.analyze_metrics(abtest.metric_stats(events), configs)
    results = abtest.analyze_tests(metrics, abtest.group_sizes(events), configs, F.lit(datetime(2024, 1, 1)))
    (row,) = abtest.report_recommendations(results).collect()  # a test without test group has no result
    assert row["test_id"] == "t" and row["statistical_significance"]
    assert row["effect_size"] == pytest.approx(0.75)
    assert row["recommendation"] == "Implement test group - shows significant improvement"
    assert row["recommendations"] == ["Implement the test variant - shows significant improvement"]


def test_zero_control_mean_and_small_sample(spark):
    rows = [("t", "control", {"ctr": 0.0})] * 5 + [("t", "test", {"ctr": 0.0})] * 5
    events = recorded(spark, rows)
    configs = abtest.config_frame(spark, TESTS)
    metrics = abtest.analyze_metrics(abtest.metric_stats(events), configs)
    row = metrics.first()
    assert row["relative_improvement"] == 0 and row["test_statistic"] is None and not row["significant"]
    results = abtest.analyze_tests(metrics, abtest.group_sizes(events), configs, F.lit(datetime(2024, 1, 1)))
    report = abtest.report_recommendations(results).first()
    assert report["recommendations"] == ["No significant difference detected", "Consider increasing sample size"]


def test_lifecycle(spark):
    day = [datetime(2024, 1, d) for d in range(1, 8)]
    log = spark.createDataFrame(
        [("a", day[0], "created"), ("a", day[1], "started"), ("a", day[3], "stopped"),
         ("b", day[0], "created"), ("b", day[2], "started"), ("c", day[0], "created")],
        "test_id string, at timestamp_ntz, action string")
    statuses = abtest.test_statuses(log)
    assert {r["test_id"]: r["status"] for r in statuses.collect()} == {"a": "stopped", "b": "running", "c": "draft"}
    assert tuple(abtest.portfolio_counts(statuses).first()) == (3, 2, 1, 1)


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("t", ["x", "y"])], "test_id string, notes array<string>")
    abtest.export_results(rows, f"{tmp_path}/j", "json")
    abtest.export_results(rows, f"{tmp_path}/c", "csv")
    assert spark.read.json(f"{tmp_path}/j").first()["notes"] == ["x", "y"]
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c").first()
    assert "x" in back["notes"]
    with pytest.raises(ValueError):
        abtest.export_results(rows, f"{tmp_path}/x", "xml")
