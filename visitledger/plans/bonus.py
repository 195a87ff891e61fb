"""Quarterly bonus reports. The current quarter prorates the manual credit by the weeks of its rows; a past
quarter counts the credit weeks whose Friday falls into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig, literal_table
from visitledger.functions import dates, money
from visitledger.plans.facts import CONFIRMED, PIPELINE


def _per_provider(df: DataFrame, cfg: PracticeConfig, values: list[str], totals: list[str]) -> DataFrame:
    """Roll-up rows -> one row per listed provider with the grand-total columns attached.

    `df` holds provider rows and the grand-total row (`is_total`). Only listed providers are collected,
    so the map is as small as the registry.
    """
    listed = F.when(~F.col("is_total") & F.col("provider").isin(*cfg.providers),
                    F.struct("provider", F.struct(*values)))
    summary = df.agg(
        F.map_from_entries(F.collect_list(listed)).alias("_own"),
        *[F.max(F.when(F.col("is_total"), F.col(name))).alias(name) for name in totals],
    )
    names = F.posexplode(F.array(*[F.lit(name) for name in cfg.providers])).alias("seq", "provider")
    rows = summary.select("*", names)
    own = F.try_element_at(F.col("_own"), F.col("provider"))
    return rows.select(
        "seq", "provider", *totals, *[F.coalesce(own.getField(name), F.lit(0)).alias(name) for name in values])


def current_quarter_bonus(fact: DataFrame, cfg: PracticeConfig, with_pipeline: bool = False) -> DataFrame:
    """Earned, projected and draft points with payouts for the quarter of `cfg.as_of`, per listed provider.

    `fact` carries drafts, whatever the caller shows; `with_pipeline` adds the draft columns to the output.
    """
    start, end = dates.quarter_bounds(cfg.as_of)
    elapsed, length = (cfg.as_of - start).days + 1, (end - start).days
    in_quarter = (F.col("service_date") >= F.lit(start)) & (F.col("service_date") < F.lit(end))
    weekly = fact.groupBy("provider", "week", "source", in_quarter.alias("in_quarter")).agg(F.sum("rvu").alias("rvu"))

    confirmed, drafted = F.col("source") == CONFIRMED, F.col("source") == PIPELINE
    rolled = weekly.rollup("provider").agg(
        F.grouping("provider").cast("boolean").alias("is_total"),
        F.sum(F.when(confirmed & F.col("in_quarter"), F.col("rvu"))).alias("earned"),
        F.sum(F.when(drafted & F.col("in_quarter"), F.col("rvu"))).alias("drafted"),
        F.sum(F.when(confirmed, F.col("rvu"))).alias("all_confirmed"),
        F.sum(F.when(drafted, F.col("rvu"))).alias("all_drafted"),
        F.count_distinct(F.when(confirmed, F.col("week"))).alias("all_weeks"),
        F.count_distinct(F.when(confirmed & F.col("in_quarter"), F.col("week"))).alias("quarter_weeks"),
    )
    rows = _per_provider(
        rolled, cfg, ["earned", "drafted"], ["all_confirmed", "all_drafted", "all_weeks", "quarter_weeks"])

    credit = F.when(
        (F.col("provider") == cfg.adjusted_provider) & (F.col("all_weeks") > 0),
        F.lit(float(cfg.adjustment_rvu)) * F.col("quarter_weeks") / F.col("all_weeks"),
    ).otherwise(F.lit(0.0))
    whole_confirmed = F.coalesce("all_confirmed", F.lit(0)).cast("double")
    whole = whole_confirmed + F.coalesce("all_drafted", F.lit(0)).cast("double")
    rate = F.when(whole == 0, F.lit(cfg.draft_rate_default)).otherwise(
        money.clip(F.try_divide(whole_confirmed, whole), 0.5, 1.0))

    points = rows.withColumns({
        "rvus_earned": F.floor(F.col("earned").cast("double") + credit),
        "conversion_rate": rate,
        "draft_rvus": F.col("drafted").cast("double"),
    }).withColumns({
        "projected_rvus": F.col("rvus_earned") * float(length) / float(elapsed),
        "estimated_total_rvus": F.col("rvus_earned") + F.floor(F.col("draft_rvus") * F.col("conversion_rate")),
    })
    extra = [
        F.col("draft_rvus").alias("pipeline_rvus"),
        (F.col("rvus_earned") + F.col("draft_rvus")).alias("total_with_pipeline"),
    ] if with_pipeline else []
    return points.orderBy("seq").select(
        dates.quarter_label(F.lit(cfg.as_of)).alias("quarter_label"),
        F.lit(elapsed).alias("days_elapsed"), F.lit(length).alias("days_in_quarter"), "provider", "rvus_earned",
        money.tier_payout(F.col("rvus_earned"), cfg.tiers).alias("bonus_earned"), "projected_rvus",
        money.tier_payout(F.floor("projected_rvus"), cfg.tiers).alias("projected_bonus"),
        "draft_rvus", "conversion_rate", "estimated_total_rvus", *extra,
    )


def past_quarter_bonus(fact: DataFrame, cfg: PracticeConfig, year: int, quarter: int) -> DataFrame:
    """Floored points and payout of one quarter per listed provider; the confirmed rows of `fact` count."""
    label = F.lit(f"{year}Q{quarter}")
    weekly = fact.filter(F.col("source") == CONFIRMED).groupBy(
        "provider", "week", (dates.quarter_key(F.col("service_date")) == label).alias("in_quarter")
    ).agg(F.sum("rvu").alias("rvu"))
    rolled = weekly.rollup("provider").agg(
        F.grouping("provider").cast("boolean").alias("is_total"),
        F.sum(F.when(F.col("in_quarter"), F.col("rvu"))).alias("earned"),
        F.count_distinct("week").alias("all_weeks"),
        F.count_distinct(F.when(dates.quarter_key(F.col("week")) == label, F.col("week"))).alias("quarter_weeks"),
    )
    rows = _per_provider(rolled, cfg, ["earned"], ["all_weeks", "quarter_weeks"])
    credit = F.when(
        (F.col("provider") == cfg.adjusted_provider) & (F.col("all_weeks") > 0),
        F.lit(float(cfg.adjustment_rvu)) * F.col("quarter_weeks") / F.col("all_weeks"),
    ).otherwise(F.lit(0.0))
    total = F.floor(F.col("earned").cast("double") + credit)
    return rows.orderBy("seq").select(
        F.lit(f"Q{quarter} {year}").alias("quarter_label"), "provider", total.alias("total_rvus"),
        F.lit(cfg.tiers[0].floor).alias("threshold_rvus"),
        money.tier_payout(total, cfg.tiers).alias("bonus_earned"),
    )


def available_quarters(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Quarters present, newest first; the quarter of `cfg.as_of` is always among them."""
    current = literal_table(fact.sparkSession, [(f"{cfg.as_of.year}Q{(cfg.as_of.month + 2) // 3}",)], ("quarter",))
    present = fact.filter("service_date is not null").select(dates.quarter_key(F.col("service_date")).alias("quarter"))
    return present.unionByName(current).distinct().orderBy(F.col("quarter").desc())
