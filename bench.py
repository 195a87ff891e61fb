"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from visitledger.checks import CHECKS

HEADLINE = (
    "charges_loaded", "clinical_rules", "exam_fees", "unique_lines", "drafts_not_confirmed", "merge_by_line_id",
    "lines_to_append", "fact_rows", "provider_trend", "company_weekly_view", "provider_comparison_view",
    "current_quarter_bonus", "past_quarter_bonus", "revenue_per_rvu", "provider_scorecards", "owner_company_trends",
    "owner_insights", "new_patients_weekly", "patient_metrics_monthly", "revenue_drivers", "growth_trend",
    "provider_visits_weekly", "exam_volume_weekly", "half_month_revenue", "receivables", "weekly_revenue",
    "group_revenue_history", "charge_forecast", "free_slots", "charge_quality", "total_patients",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries (warm, median)", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
