"""Revenue per point, weekly revenue and profit, group revenue history, receivables, bank."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig
from visitledger.functions import dates, money, rules
from visitledger.operators import series
from visitledger.plans.exams import appointments_of

# -- revenue per point --------------------------------------------------------------------------------------


def revenue_per_rvu(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Weekly, per-provider, current-quarter and overall points, revenue and revenue per point in one pass.

    `section` is weekly, provider, quarter or summary; `subject` names the week or provider.
    """
    start, _ = dates.quarter_bounds(cfg.as_of)
    current = F.col("service_date") >= F.lit(start)
    pre = fact.groupBy("week", "provider").agg(
        F.sum("rvu").alias("rvu"), F.sum("revenue").alias("revenue"),
        F.sum(F.when(current, F.col("rvu"))).alias("q_rvu"),
        F.sum(F.when(current, F.col("revenue"))).alias("q_revenue"),
        F.count_if(current).alias("q_rows"),
    )
    sets = pre.groupingSets([["week"], ["provider"], []], "week", "provider").agg(
        F.grouping_id("week", "provider").alias("level"),
        *[F.sum(name).alias(name) for name in ("rvu", "revenue", "q_rvu", "q_revenue", "q_rows")],
    )
    section = (
        F.when(F.col("level") == 1, F.lit("weekly")).when(F.col("level") == 2, F.lit("provider"))
        .otherwise(F.lit("summary"))
    )
    subject = F.coalesce(F.date_format("week", "yyyy-MM-dd"), "provider", F.lit("ALL"))
    lines = F.array_compact(F.array(
        F.struct(section.alias("section"), subject.alias("subject"), F.col("rvu").alias("total_rvus"),
                 F.col("revenue").alias("total_revenue")),
        F.when((F.col("level") == 2) & (F.col("q_rows") > 0), F.struct(
            F.lit("quarter").alias("section"), subject.alias("subject"), F.col("q_rvu").alias("total_rvus"),
            F.col("q_revenue").alias("total_revenue"))),
    ))
    rate = money.ratio_or_zero(F.col("total_revenue"), F.col("total_rvus"))
    rows = sets.filter("level <> 0 and rvu is not null").select(F.inline(lines)).withColumn("dollars_per_rvu", rate)
    return rows.withColumn("benchmark_delta", F.when(
        F.col("section") == "summary", F.col("dollars_per_rvu") - F.lit(float(cfg.revenue_per_rvu_benchmark))))


# -- weekly revenue -----------------------------------------------------------------------------------------


def week_sums(charges: DataFrame, exams: DataFrame, supplemental: DataFrame | None = None) -> DataFrame:
    """`(week, va_revenue, pc_charges, pc_revenue)`. `supplemental` holds extra exam payments `(pay_date, amount)`.

    The sources are stacked and summed once instead of outer-joined, so a week may occur in any of them.
    """
    nothing = F.lit(0).cast(money.MONEY)
    parts = [
        exams.select("week", F.col("exam_revenue").alias("va_revenue"), nothing.alias("pc_charges"), nothing.alias("pc_revenue")),
        charges.select("week", nothing.alias("va_revenue"), F.col("charge_amount").alias("pc_charges"),
                       F.col("revenue").cast(money.MONEY).alias("pc_revenue")),
    ]
    if supplemental is not None:
        parts.append(supplemental.select(
            dates.week_end(F.col("pay_date")).alias("week"), F.col("amount").cast(money.MONEY).alias("va_revenue"),
            nothing.alias("pc_charges"), nothing.alias("pc_revenue")))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.filter("week is not null").groupBy("week").agg(
        *[F.sum(name).alias(name) for name in ("va_revenue", "pc_charges", "pc_revenue")])


def weekly_report(weekly: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Totals, cost, profit and 8-week means of `week_sums`.

    The newest weeks are not collected yet, so their charge revenue is estimated from the charges.
    """
    lag = cfg.collection_lag_weeks
    rate = F.lit(cfg.collection_rate).cast("decimal(3,2)")
    uncollected = (series.recency("week") <= lag) & (F.count(F.lit(1)).over(Window.partitionBy()) >= lag)
    estimated = weekly.withColumn("pc_revenue", F.when(
        uncollected, (F.col("pc_charges") * rate).cast("decimal(28,4)")).otherwise(
        F.col("pc_revenue").cast("decimal(28,4)")))
    costed = estimated.withColumn("total_revenue", F.col("va_revenue") + F.col("pc_revenue")).withColumn(
        "cost", rules.weekly_cost(F.col("week"), cfg)).withColumn("profit", F.col("total_revenue") - F.col("cost"))
    return costed.withColumns({
        "va_revenue_ma8": series.rolling_mean(F.col("va_revenue"), "week", 8),
        "total_revenue_ma8": series.rolling_mean(F.col("total_revenue"), "week", 8),
        "profit_ma8": series.rolling_mean(F.col("profit"), "week", 8),
    })


def weekly_revenue(
    charges: DataFrame, exams: DataFrame, cfg: PracticeConfig, supplemental: DataFrame | None = None
) -> DataFrame:
    """Exam and charge revenue per week, cost, profit and 8-week means."""
    return weekly_report(week_sums(charges, exams, supplemental), cfg)


def weekly_revenue_summary(weekly: DataFrame) -> DataFrame:
    weeks = F.count(F.lit(1))
    return weekly.agg(
        *[F.sum(name).alias(f"sum_{name}") for name in ("va_revenue", "pc_revenue", "total_revenue")],
        *[(F.sum(name).cast("double") / weeks).alias(f"avg_{name}") for name in ("va_revenue", "pc_revenue", "total_revenue")],
        weeks.alias("weeks"), F.min("week").alias("first_week"), F.max("week").alias("last_week"),
    )


# -- exam groups: history and baseline ----------------------------------------------------------------------


def revenue_per_exam(weekly: DataFrame, visits: DataFrame, start: date) -> DataFrame:
    """Exam revenue since `start` over the distinct exam appointments since `start`, one row."""
    total = weekly.filter(F.col("week") >= F.lit(start)).agg(F.sum("va_revenue")).scalar()
    return visits.filter(F.col("service_date") >= F.lit(start)).agg(
        F.count(F.lit(1)).alias("exams")
    ).withColumn("revenue", total.cast("double")).withColumn(
        "revenue_per_exam", F.try_divide(F.col("revenue"), F.col("exams")))


def group_revenue_history(
    weekly: DataFrame, exams: DataFrame, charges: DataFrame, cfg: PracticeConfig, pc_group: str
) -> DataFrame:
    """Full months since `cfg.exam_start`: group exams, capped group revenue, charge revenue of one group.

    `pc_group` is the label in `cfg.exam_groups` whose charge revenue is added.
    """
    fragments = dict(cfg.exam_groups)
    visits = appointments_of(exams, cfg).filter(F.col("service_date") >= F.lit(cfg.exam_start))
    month = dates.month_start(F.col("service_date")).alias("month")
    counts = visits.groupBy(month).agg(
        *[F.count_if(F.col(f"is_{g}")).alias(f"exams_{g}") for g in fragments], F.count(F.lit(1)).alias("exams_all"))
    months = weekly.filter(F.col("week") >= F.lit(cfg.exam_start)).groupBy(
        dates.month_start(F.col("week")).alias("month")
    ).agg(F.sum("va_revenue").alias("total_va_revenue"), F.sum("pc_revenue").alias("total_pc_revenue"),
          F.count(F.lit(1)).alias("weeks")).filter("weeks >= 3")
    group_pc = charges.filter(
        rules.name_matches(F.col("provider_raw"), fragments[pc_group])
        & F.col("patient_id").isNotNull() & (F.col("service_date") >= F.lit(cfg.exam_start))
    ).groupBy(month).agg(F.sum("revenue").alias("group_pc_revenue"))
    per_exam = revenue_per_exam(weekly, visits, cfg.exam_start).select("revenue_per_exam").scalar()

    joined = months.join(counts, "month", "left").join(group_pc, "month", "left").fillna(
        0, [f"exams_{g}" for g in fragments])
    own = [F.col(f"exams_{g}") for g in fragments]
    capped: Column = F.lit(0)
    total: Column = F.lit(0)
    for column in own:
        capped = capped + F.least(column, F.col("weeks") * cfg.exam_cap)
        total = total + column
    return joined.select(
        "month", "weeks", *[f"exams_{g}" for g in fragments],
        money.ratio_or_zero(total, F.coalesce("exams_all", F.lit(1))).alias("group_share"),
        (capped * per_exam).alias("group_va_revenue"), "total_va_revenue", "total_pc_revenue",
        F.coalesce("group_pc_revenue", F.lit(0)).alias("group_pc_revenue"),
    ).withColumn("group_total_revenue", F.col("group_va_revenue") + F.col("group_pc_revenue").cast("double"))


def group_baseline(history: DataFrame, months: int = 6) -> DataFrame:
    """Mean and spread of the newest months."""
    recent = history.withColumn("age", series.recency("month")).filter(F.col("age") <= months)
    pc = F.col("group_pc_revenue").cast("double")
    return recent.agg(
        F.avg("group_va_revenue").alias("va_mean"), F.stddev_samp("group_va_revenue").alias("va_std"),
        F.avg(pc).alias("pc_mean"), F.stddev_samp(pc).alias("pc_std"), F.count(F.lit(1)).alias("months"))


def weekly_exam_spread(exams: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Mean and population spread of capped weekly exams per group, weeks ending on Sunday."""
    visits = appointments_of(exams, cfg).filter(F.col("service_date") >= F.lit(cfg.exam_start))
    groups = F.array(*[F.when(F.col(f"is_{g}"), F.lit(g)) for g, _ in cfg.exam_groups])
    weekly = visits.select(
        dates.week_end(F.col("service_date"), "SUN").alias("week"), F.explode(F.array_compact(groups)).alias("exam_group")
    ).groupBy("exam_group", "week").agg(F.least(F.count(F.lit(1)), F.lit(cfg.exam_cap)).alias("n"))
    return weekly.groupBy("exam_group").agg(
        F.count(F.lit(1)).alias("weeks"), F.avg("n").alias("mean_exams"), F.stddev_pop("n").alias("std_exams"))


def panel_value(charges: DataFrame, cfg: PracticeConfig, group: str) -> DataFrame:
    """Mean revenue per charge line and the distinct patients of one group."""
    dated = charges.filter("service_date is not null and patient_id is not null")
    own = rules.name_matches(F.col("provider_raw"), dict(cfg.exam_groups)[group])
    pairs = dated.groupBy("patient_id").agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("lines"), F.bool_or(own).alias("own"))
    return pairs.agg(
        (F.sum("revenue").cast("double") / F.sum("lines")).alias("revenue_per_line"),
        F.count_if(F.col("own")).alias("group_panel"))


def crossover_month(series_a: DataFrame, series_b: DataFrame, month: str, value: str) -> DataFrame:
    """First month in which the running total of B reaches that of A (null if it never does)."""
    both = series_a.select(month, F.col(value).alias("a"), F.lit(0).cast("double").alias("b")).unionByName(
        series_b.select(month, F.lit(0).cast("double").alias("a"), F.col(value).alias("b"))
    ).groupBy(month).agg(F.sum(F.col("a").cast("double")).alias("a"), F.sum(F.col("b").cast("double")).alias("b"))
    running = both.select(month, series.running_sum(F.col("a"), month).alias("a"), series.running_sum(F.col("b"), month).alias("b"))
    return running.agg(F.min(F.when(F.col("b") >= F.col("a"), F.col(month))).alias("crossover"))


# -- receivables and bank -----------------------------------------------------------------------------------

BLOCK_DAYS, BLOCKS = 15, 3


def receivables(exams: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Revenue earned but not yet due for payment: the total and the three payment blocks."""
    cutoff = cfg.as_of - timedelta(days=cfg.receivable_lag_days)
    spans = [("total", cutoff, cfg.as_of)]
    for i in range(BLOCKS):
        begin = cutoff + timedelta(days=BLOCK_DAYS * i)
        spans.append((f"block {i + 1}", begin, begin + timedelta(days=BLOCK_DAYS)))
    last = max(end for _, _, end in spans)
    day = F.col("service_date")
    sums = exams.filter((day > F.lit(cutoff)) & (day <= F.lit(last))).agg(*[
        F.coalesce(F.sum(F.when((day > F.lit(begin)) & (day <= F.lit(end)), F.col("exam_revenue"))),
                   F.lit(0).cast(money.MONEY)).alias(name)
        for name, begin, end in spans])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("block"), F.lit(begin).alias("after"), F.lit(end).alias("until"),
                 F.col(f"`{name}`").alias("expected_revenue"))
        for name, begin, end in spans])))


def bank_by_month(bank: DataFrame) -> DataFrame:
    """Amounts and number of entries per month of the bank table."""
    dated = bank.filter("entry_date is not null")
    return dated.groupBy(dates.month_start(F.col("entry_date")).alias("month")).agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("entries"))
