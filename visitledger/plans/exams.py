"""Exam volume and half-month exam revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig
from visitledger.functions import dates, money, rules


def appointments_of(exams: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """One row per patient, date and provider (the first case), with a flag `is_<group>` per exam group."""
    first = F.min(F.struct("case_id", "is_no_show")).alias("first")
    unique = exams.groupBy("patient_id", "service_date", "provider_raw").agg(first)
    return unique.select(
        "patient_id", "service_date", "provider_raw", F.col("first.is_no_show").alias("is_no_show"),
        *[rules.name_matches(F.col("provider_raw"), fragment).alias(f"is_{group}") for group, fragment in cfg.exam_groups],
    )


def exam_volume_weekly(exams: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Appointments and no-shows per week and group, capped and raw, in one pass."""
    groups = [group for group, _ in cfg.exam_groups]
    visits = appointments_of(exams.filter(F.col("service_date") >= F.lit(cfg.exam_start)), cfg)
    weekly = visits.groupBy(dates.week_end(F.col("service_date")).alias("week")).agg(
        F.count(F.lit(1)).alias("all_appts"),
        *[F.count_if(F.col(f"is_{g}")).alias(f"raw_{g}") for g in groups],
        *[F.count_if(F.col(f"is_{g}") & F.col("is_no_show")).alias(f"no_shows_{g}") for g in groups],
    )
    capped = weekly.withColumns({f"appts_{g}": money.clip(F.col(f"raw_{g}"), high=cfg.exam_cap) for g in groups})

    def total(prefix: str):
        value = F.col(f"{prefix}_{groups[0]}")
        for g in groups[1:]:
            value = value + F.col(f"{prefix}_{g}")
        return value

    return capped.withColumns({
        "combined_appts": total("appts"), "combined_no_shows": total("no_shows"),
        "others": F.col("all_appts") - total("raw"),
    })


def exam_volume_monthly(weekly: DataFrame, cfg: PracticeConfig) -> DataFrame:
    groups = [group for group, _ in cfg.exam_groups]
    return weekly.groupBy(dates.month_start(F.col("week")).alias("month")).agg(
        *[F.sum(f"appts_{g}").alias(f"appts_{g}") for g in groups],
        F.sum("all_appts").alias("all_appts"), F.sum("combined_appts").alias("combined_appts"))


def exam_volume_stats(weekly: DataFrame, cfg: PracticeConfig) -> DataFrame:
    zero = F.lit(0)
    names = [f"appts_{group}" for group, _ in cfg.exam_groups] + ["combined_appts", "all_appts"]
    return weekly.agg(
        *[F.coalesce(F.sum(name), zero).alias(f"total_{name}") for name in names],
        F.coalesce(F.avg("combined_appts"), F.lit(0.0)).alias("avg_week"), F.count(F.lit(1)).alias("n_weeks"))


def half_month_revenue(exams: DataFrame) -> DataFrame:
    """Exam revenue per half month."""
    return exams.groupBy(dates.half_month_key(F.col("service_date")).alias("half_month")).agg(
        F.sum("exam_revenue").alias("exam_revenue"))
