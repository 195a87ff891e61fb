"""Weekly productivity views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig
from visitledger.functions import rules
from visitledger.operators import series
from visitledger.plans.facts import CONFIRMED, PIPELINE

RECENT_WEEKS = 3


def weekly_points(fact: DataFrame) -> DataFrame:
    """Points per week."""
    return fact.groupBy("week").agg(F.sum("rvu").alias("rvu"))


def provider_weekly_points(fact: DataFrame) -> DataFrame:
    """Points per provider and week."""
    return fact.groupBy("provider", "week").agg(F.sum("rvu").alias("rvu"))


def provider_pivot(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Week x provider table with 0 for empty cells; the listed providers fix the columns."""
    wide = fact.groupBy("week").pivot("provider", list(cfg.providers)).agg(F.sum("rvu"))
    return wide.select("week", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(p) for p in cfg.providers])


def manual_adjustment_rows(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """The manual credit of one provider, spread evenly over the confirmed weeks, one row per week."""
    weeks = fact.filter(F.col("source") == CONFIRMED).select("week").distinct()
    share = F.lit(float(cfg.adjustment_rvu)) / F.count(F.lit(1)).over(Window.partitionBy())
    return weeks.select(
        F.col("week").alias("service_date"), F.lit(cfg.adjusted_provider).alias("provider"), share.alias("rvu"),
        F.lit("Manual Adjustment").alias("category"), F.lit(CONFIRMED).alias("source"), "week",
    )


def _per_source(fact: DataFrame) -> DataFrame:
    """Provider-week totals with confirmed and draft points side by side, one pass over the fact."""
    def total(source: str) -> Column:
        return F.sum(F.when(F.col("source") == source, F.col("rvu")))

    return fact.groupBy("provider", "week").agg(
        total(CONFIRMED).alias("confirmed"), total(PIPELINE).alias("draft"),
        F.bool_or(F.col("source") == CONFIRMED).alias("is_confirmed"),
    )


def _week_values(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """One row per week with the listed providers' values as maps, the credit already added."""
    listed = F.col("provider").isin(*cfg.providers)
    weeks = _per_source(fact).groupBy("week").agg(
        F.bool_or("is_confirmed").alias("has_confirmed"),
        F.map_from_entries(F.collect_list(F.when(listed & F.col("confirmed").isNotNull(), F.struct(
            "provider", F.col("confirmed").cast("double").alias("v"))))).alias("confirmed"),
        F.map_from_entries(F.collect_list(F.when(listed & F.col("draft").isNotNull(), F.struct(
            "provider", F.col("draft").cast("double").alias("v"))))).alias("draft"),
    )
    confirmed_weeks = F.sum(F.col("has_confirmed").cast("int")).over(Window.partitionBy())
    credit = F.when(F.col("has_confirmed"), F.lit(float(cfg.adjustment_rvu)) / confirmed_weeks)
    return weeks.withColumn("credit", credit)


def _provider_weeks(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """(week, provider) rows of the registry: confirmed incl. credit (null if none), draft (null if none)."""
    rows = _week_values(fact, cfg).select(
        "*", F.explode(F.array(*[F.lit(name) for name in cfg.providers])).alias("provider"))
    own = F.try_element_at(F.col("confirmed"), F.col("provider"))
    credit = F.when(F.col("provider") == cfg.adjusted_provider, F.col("credit"))
    confirmed = F.when(own.isNotNull() | credit.isNotNull(), F.coalesce(own, F.lit(0.0)) + F.coalesce(credit, F.lit(0.0)))
    draft = F.try_element_at(F.col("draft"), F.col("provider"))
    return rows.select("week", "provider", "has_confirmed", confirmed.alias("confirmed"), draft.alias("draft"))


def _flag_recent(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`may_be_incomplete` on the last weeks that carry confirmed points, if there are enough of them."""
    keys = [F.col(name) for name in by]
    shown = F.col("confirmed_rvu").isNotNull()
    newest = F.row_number().over(Window.partitionBy(*keys, shown).orderBy(F.col("week").desc()))
    total = F.count(F.when(shown, 1)).over(Window.partitionBy(*keys))
    return df.withColumn("may_be_incomplete", shown & (newest <= RECENT_WEEKS) & (total >= RECENT_WEEKS))


def company_weekly(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Company points per week, with drafts on top, targets and the incomplete flag. Hidden providers count."""
    totals = _provider_weeks(fact, cfg).groupBy("week").agg(
        F.sum("confirmed").alias("confirmed_rvu"), F.sum("draft").alias("draft_rvu"))
    kept = totals.filter("confirmed_rvu is not null or draft_rvu is not null")
    return _flag_recent(kept).select(
        "week", "confirmed_rvu",
        (F.coalesce("confirmed_rvu", F.lit(0.0)) + F.coalesce("draft_rvu", F.lit(0.0))).alias("combined_rvu"),
        rules.threshold(F.col("week"), "company_breakeven", cfg).alias("breakeven"),
        rules.threshold(F.col("week"), "company_target", cfg).alias("target"),
        "may_be_incomplete",
    )


def provider_comparison(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Visible providers side by side on the weeks with confirmed points; drafts may add weeks."""
    visible = [p for p in cfg.providers if p not in cfg.hidden_providers]
    rows = _provider_weeks(fact, cfg).filter(F.col("provider").isin(*visible))
    on_axis = rows.withColumn(
        "confirmed_rvu", F.coalesce("confirmed", F.when(F.col("has_confirmed"), F.lit(0.0))))
    kept = on_axis.filter("confirmed_rvu is not null or draft is not null")
    return _flag_recent(kept, ("provider",)).select(
        "week", "provider", "confirmed_rvu",
        (F.coalesce("confirmed_rvu", F.lit(0.0)) + F.coalesce("draft", F.lit(0.0))).alias("combined_rvu"),
        rules.threshold(F.col("week"), "provider_breakeven", cfg).alias("breakeven"),
        rules.threshold(F.col("week"), "provider_target", cfg).alias("target"),
        "may_be_incomplete",
    )


def provider_weekly(fact: DataFrame, cfg: PracticeConfig, provider: str | None = None) -> DataFrame:
    """Each provider on the weeks with own points; hidden providers have no rows."""
    rows = _provider_weeks(fact, cfg).filter(~F.col("provider").isin(*cfg.hidden_providers)
                                             if cfg.hidden_providers else F.lit(True))
    if provider is not None:
        rows = rows.filter(F.col("provider") == provider.upper())
    kept = rows.withColumnRenamed("confirmed", "confirmed_rvu").filter(
        "confirmed_rvu is not null or draft is not null")
    return _flag_recent(kept, ("provider",)).select(
        "week", "provider", "confirmed_rvu",
        (F.coalesce("confirmed_rvu", F.lit(0.0)) + F.coalesce("draft", F.lit(0.0))).alias("combined_rvu"),
        rules.threshold(F.col("week"), "provider_breakeven", cfg).alias("breakeven"),
        rules.threshold(F.col("week"), "provider_target", cfg).alias("target"),
        "may_be_incomplete",
    )


def provider_trend(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Provider-week grid with 4-week mean, running sum and distance to the provider target."""
    grid = series.provider_week_grid(provider_weekly_points(fact), cfg.providers, "rvu")
    by = ("provider",)
    return grid.select(
        "provider", "week", "rvu",
        series.rolling_mean(F.col("rvu"), "week", 4, by).alias("rolling4"),
        series.running_sum(F.col("rvu"), "week", by).alias("cumulative"),
        (F.col("rvu") - rules.threshold(F.col("week"), "provider_breakeven", cfg)).alias("distance"),
    )
