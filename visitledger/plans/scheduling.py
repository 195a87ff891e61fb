"""Schedule reads: offered providers, requests, bookings, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig
from visitledger.functions import rules
from visitledger.operators.topk import newest
from visitledger.sources.files import five_star


def schedule_list(schedule: DataFrame) -> DataFrame:
    return schedule.orderBy("provider", "day_of_week")


def active_providers(schedule: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Providers with an active schedule row and the name shown to patients."""
    shown = F.col("provider")
    for canonical, display in cfg.display_names:
        shown = F.when(F.col("provider") == canonical, F.lit(display)).otherwise(shown)
    return schedule.filter("is_active").select("provider").distinct().withColumn("display", shown)


def recent_requests(requests: DataFrame, k: int = 20) -> DataFrame:
    return newest(requests, "created_at", k, "request_id")


def recent_bookings(bookings: DataFrame, k: int = 50) -> DataFrame:
    return newest(bookings.withColumn("status", rules.booking_status(F.col("external_id"))), "created_at", k, "booking_id")


def best_reviews(reviews: DataFrame, k: int = 10) -> DataFrame:
    """Newest five-star reviews with text."""
    return newest(five_star(reviews), "time", k, "author_name")
