"""Time the headline queries.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1), runs on local[$BENCH_CPUS],
prints one JSON line. Every query runs once to warm up, then $BENCH_RUNS times
(default 3); the median counts. The sink discards rows, so only the query is
timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "popular_items", "user_features", "item_features", "user_behavior", "item_trends",
    "user_features_at_order_time", "item_features_at_ship_time", "latest_user_features",
    "search_documents", "search_page", "items_for_target_categories", "new_wishlist_entries",
    "cold_start", "similar_items", "similar_users_by_ratings", "similar_items_by_ratings",
    "hybrid_lists", "explained_lists", "popularity_ranking_metrics", "bias_prediction_errors",
    "ab_metric_stats", "ab_mean_tests", "business_kpis", "daily_trend", "service_metrics",
    "user_sessions", "stored_recommendations", "als_items_for_users",
]


def main() -> None:
    from basketry.plans import QUERIES
    from basketry.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    timings = {}
    for name in HEADLINE:
        once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
