"""New patients, panel metrics, growth and visit analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitledger import config as C
from visitledger.config import PracticeConfig
from visitledger.functions import dates, money
from visitledger.operators import series
from visitledger.operators.dedup import present


def patient_days(charges: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """`(patient_id, service_date)` of confirmed and draft lines with a patient and a date."""
    rows = charges.select("patient_id", "service_date")
    if drafts is not None:
        rows = rows.unionByName(drafts.select("patient_id", "service_date"))
    return rows.filter(F.col("service_date").isNotNull() & present(F.col("patient_id")))


def first_visits(days: DataFrame) -> DataFrame:
    """First date of each patient over all history."""
    return days.groupBy("patient_id").agg(F.min("service_date").alias("first_visit"))


def total_patients(days: DataFrame) -> DataFrame:
    return days.agg(F.count_distinct("patient_id").alias("total_patients"))


def total_patients_approx(days: DataFrame, error: float = 0.02) -> DataFrame:
    """Sketch-based count for very large tables; the exact count above is the report."""
    return days.agg(F.approx_count_distinct("patient_id", error).alias("total_patients"))


def patient_sketches(charges: DataFrame, bits: int = 14) -> DataFrame:
    """`(month, provider_raw, sketch)`: mergeable patient counts, to be stored beside the charges. A new month adds its rows;
    `bits` 14 errs by less than 1 % at one standard deviation."""
    rows = charges.filter(F.col("service_date").isNotNull() & present(F.col("patient_id")))
    return rows.groupBy(dates.month_start(F.col("service_date")).alias("month"), "provider_raw").agg(
        F.hll_sketch_agg("patient_id", F.lit(bits)).alias("sketch"))


def patients_from_sketches(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Estimated distinct patients of any union of months and providers, from the stored sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimated_patients"))


def new_patients_weekly(days: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """New patients per week since the reporting start, 4-week mean and running total."""
    fresh = first_visits(days).filter(F.col("first_visit") >= F.lit(cfg.fact_start))
    weekly = fresh.groupBy(dates.week_end(F.col("first_visit")).alias("week")).agg(F.count(F.lit(1)).alias("new_patients"))
    return weekly.select(
        "week", "new_patients",
        series.rolling_mean(F.col("new_patients"), "week", 4).alias("ma4"),
        series.running_sum(F.col("new_patients"), "week").alias("cumulative"),
    )


def campaign_comparison(weekly: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Weeks, totals and means before and after the campaign start, and the change in percent."""
    before = F.col("week") < F.lit(cfg.campaign_start)
    n = F.col("new_patients")
    sums = weekly.agg(
        F.sum(n).alias("total_new_patients"), F.avg(n).alias("avg_per_week"),
        F.count_if(before).alias("pre_weeks"), F.count_if(~before).alias("post_weeks"),
        F.coalesce(F.sum(F.when(before, n)), F.lit(0)).alias("pre_total"),
        F.coalesce(F.sum(F.when(~before, n)), F.lit(0)).alias("post_total"),
    ).withColumns({
        "pre_avg": F.round(money.ratio_or_zero(F.col("pre_total"), F.col("pre_weeks")), 1),
        "post_avg": F.round(money.ratio_or_zero(F.col("post_total"), F.col("post_weeks")), 1),
    })
    return sums.withColumn("percent_change", money.ratio_or_zero(
        (F.col("post_avg") - F.col("pre_avg")) * 100.0, F.col("pre_avg")))


MONEY_SUMS = {"allowed": "allowed", "revenue": "revenue", "revenue_model": "revenue_model", "charge_amount": "charges"}


def patient_metrics_weekly(charges: DataFrame) -> DataFrame:
    """New patients, panel size and money per week.

    The panel is carried over weeks without new patients. New patients and money are stacked and summed
    once, which gives the same weeks as an outer join.
    """
    dated = charges.filter(F.col("service_date").isNotNull() & F.col("patient_id").isNotNull())
    fresh = first_visits(dated).groupBy(dates.week_end(F.col("first_visit")).alias("week")).agg(
        F.count(F.lit(1)).alias("new_patients"))
    sums = dated.groupBy("week").agg(*[F.sum(c).alias(name) for c, name in MONEY_SUMS.items()])
    weekly = fresh.unionByName(sums, allowMissingColumns=True).groupBy("week").agg(
        F.max("new_patients").alias("_new"), *[F.max(name).alias(name) for name in MONEY_SUMS.values()])
    panel = F.when(F.col("_new").isNotNull(), series.running_sum(F.coalesce("_new", F.lit(0)), "week"))
    staged = weekly.withColumn("_panel", panel)
    return staged.select(
        "week", F.coalesce("_new", F.lit(0)).alias("new_patients"),
        F.coalesce(series.forward_fill(F.col("_panel"), "week"), F.lit(0)).alias("cumulative_patients"),
        *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in MONEY_SUMS.values()],
    )


def patient_metrics_monthly(weekly: DataFrame) -> DataFrame:
    """The weekly metrics by month: money summed, panel of the last week, revenue per panel patient."""
    monthly = weekly.groupBy(dates.month_start(F.col("week")).alias("month")).agg(
        *[F.sum(name).alias(name) for name in ("revenue", "revenue_model", "charges", "allowed", "new_patients")],
        F.max_by("cumulative_patients", "week").alias("panel_eom"), F.count(F.lit(1)).alias("weeks_in_month"),
    )
    return monthly.withColumn("rev_per_active_patient", money.ratio_or_zero(F.col("revenue_model"), F.col("panel_eom")))


def revenue_drivers(monthly: DataFrame) -> DataFrame:
    """Model revenue regressed on panel size and on new patients, over full months after the start-up months.

    No rows when fewer than three months remain.
    """
    full = monthly.filter("weeks_in_month >= 3").withColumns({
        "pos": series.position("month"), "months": F.count(F.lit(1)).over(Window.partitionBy())})
    settled = full.filter("months <= 4 or pos >= 4")
    drivers = F.array(
        F.struct(F.lit("panel").alias("driver"), F.col("panel_eom").cast("double").alias("x")),
        F.struct(F.lit("new_patients").alias("driver"), F.col("new_patients").cast("double").alias("x")),
    )
    points = settled.select(F.col("revenue_model").cast("double").alias("y"), F.inline(drivers))
    fits = points.groupBy("driver").agg(
        *[column.alias(name) for name, column in series.regression(F.col("y"), F.col("x")).items()])
    return fits.filter("n >= 3").withColumn("p_value", series.regression_p_value(F.col("r2"), F.col("n")))


SUSTAINED_BELOW, SUSTAINED_WEEKS = 5, 4


def growth_weeks(charges: DataFrame, cfg: PracticeConfig, exclude_outliers: bool = True) -> DataFrame:
    """The trailing 52 weeks of new patients with growth rate and 4-row mean; listed outlier weeks left out."""
    dated = charges.filter(F.col("service_date").isNotNull() & F.col("patient_id").isNotNull())
    weekly = first_visits(dated).groupBy(dates.week_end(F.col("first_visit")).alias("week")).agg(
        F.count(F.lit(1)).alias("new_patients"))
    whole = weekly.withColumns({
        "cumulative_patients": series.running_sum(F.col("new_patients"), "week"),
        "newest": F.max("week").over(Window.partitionBy()),
    })
    recent = whole.filter(F.col("week") >= F.date_sub("newest", 364))
    if exclude_outliers and cfg.outlier_weeks:
        recent = recent.filter(~F.col("week").isin(*cfg.outlier_weeks))
    rate = money.ratio_or_zero(F.col("new_patients") * 100.0, F.col("cumulative_patients"))
    return recent.select(
        "week", "new_patients", "cumulative_patients", rate.alias("growth_rate"),
        series.rolling_mean(F.col("new_patients"), "week", 4).alias("ma4"),
    )


def growth_trend(weeks: DataFrame) -> DataFrame:
    """Trend over the weeks, spread around it, and the longest run of weak weeks."""
    y = F.col("new_patients").cast("double")
    indexed = weeks.withColumn("x", series.position("week").cast("double"))
    whole = Window.partitionBy()
    fitted = indexed.withColumns({
        "slope": F.regr_slope(y, F.col("x")).over(whole), "intercept": F.regr_intercept(y, F.col("x")).over(whole)})
    weak = F.col("new_patients") < SUSTAINED_BELOW
    runs = series.longest_run(weeks, "week", weak).select("longest_run").scalar()
    return fitted.agg(
        F.count(F.lit(1)).alias("weeks"), F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
        F.coalesce(F.regr_r2(y, F.col("x")), F.lit(0.0)).alias("r2"),
        F.stddev_pop(y - (F.col("slope") * F.col("x") + F.col("intercept"))).alias("residual_std"),
    ).withColumn("longest_weak_run", F.coalesce(runs, F.lit(0))).withColumn(
        "sustained_drop", F.col("longest_weak_run") >= SUSTAINED_WEEKS)


# -- visits -------------------------------------------------------------------------------------------------

NEW, PHYSICAL = C.NEW_PATIENT_CODES, C.PHYSICAL_CODES
FACE_TIME = C.ESTABLISHED_CODES + C.NEW_PATIENT_CODES + C.PHYSICAL_CODES


def _visit_lines(charges: DataFrame, provider: str) -> DataFrame:
    return charges.withColumn("provider", F.upper(F.trim(F.col(provider))))


def encounters(charges: DataFrame, provider: str = "provider_raw") -> DataFrame:
    """One row per provider and encounter: its code flags, first date and patient.

    Flags are boolean aggregates, so an encounter with any number of lines takes constant memory. Lines fold by patient too at
    first: fixed-width values aggregate by hash, the patient of the first date is picked from the few rows left. A line without
    a date or patient gives way to one with it.
    """
    code = F.trim(F.col("procedure_code"))
    lines = _visit_lines(charges, provider).filter(F.col("encounter_id").isNotNull())
    per_patient = lines.groupBy("provider", "encounter_id", "patient_id").agg(
        F.bool_or(F.coalesce(code.isin(*FACE_TIME), F.lit(False))).alias("face_time"),
        F.bool_or(F.coalesce(code.isin(*NEW), F.lit(False))).alias("new_code"),
        F.bool_or(F.coalesce(code.isin(*PHYSICAL), F.lit(False))).alias("physical"),
        F.min("service_date").alias("service_date"))
    order = F.struct(F.col("service_date").isNull(), "service_date", F.col("patient_id").isNull(), "patient_id")
    return per_patient.groupBy("provider", "encounter_id").agg(
        *[F.bool_or(name).alias(name) for name in ("face_time", "new_code", "physical")],
        F.min("service_date").alias("service_date"), F.min_by("patient_id", order).alias("patient_id"))


def provider_visits_weekly(charges: DataFrame, provider: str = "provider_raw") -> DataFrame:
    """Visits, new and recurring patients and money per provider and week, for all providers at once.

    A visit is an encounter with a face-time code. It is new with a new-patient code, or with a physical on
    the patient's first date in the clinic. Visits are counted per patient and date before they meet the
    first dates, so a patient with very many lines is one row per date there.
    """
    visits = encounters(charges, provider).filter("face_time")
    per_day = visits.groupBy("provider", "patient_id", "service_date").agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_if("new_code").alias("by_code"),
        F.count_if(F.col("physical") & ~F.col("new_code")).alias("by_physical"),
    )
    started = charges.filter(F.col("service_date").isNotNull() & F.col("patient_id").isNotNull())
    judged = per_day.join(first_visits(started), "patient_id", "left")
    new_by_date = F.when(F.col("service_date") == F.col("first_visit"), F.col("by_physical")).otherwise(0)
    counts = judged.groupBy("provider", dates.week_end(F.col("service_date")).alias("week")).agg(
        F.sum("visits").alias("total_visits"), F.sum(F.col("by_code") + new_by_date).alias("new_patients"))
    sums = _visit_lines(charges, provider).groupBy("provider", "week").agg(
        F.sum("charge_amount").alias("total_charges"), F.sum("allowed").alias("total_allowed"),
        F.sum("revenue").alias("total_collected"))
    both = counts.unionByName(sums, allowMissingColumns=True).filter("week is not null and provider is not null")
    names = ("total_visits", "new_patients", "total_charges", "total_allowed", "total_collected")
    merged = both.groupBy("provider", "week").agg(*[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in names])
    return merged.withColumn("recurring_patients", F.col("total_visits") - F.col("new_patients"))


def provider_visit_totals(charges: DataFrame, provider: str = "provider_raw") -> DataFrame:
    """Encounters, visits and distinct patients per provider.

    Distinct patients are counted after a (provider, patient) pre-aggregation, encounters after the
    encounter one, so a provider with a large share of all lines is never expanded in one task.
    """
    visits = encounters(charges, provider).groupBy("provider").agg(
        F.count(F.lit(1)).alias("encounters"), F.count_if("face_time").alias("visits"))
    patients = _visit_lines(charges, provider).filter("patient_id is not null").groupBy("provider", "patient_id").agg(
        F.lit(1).alias("one")).groupBy("provider").agg(F.count(F.lit(1)).alias("unique_patients"))
    merged = visits.unionByName(patients, allowMissingColumns=True).filter("provider is not null")
    return merged.groupBy("provider").agg(
        *[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in ("encounters", "visits", "unique_patients")])
