"""Cross-checks of patient, growth and visit reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from visitledger.checks.oracle import build, friday
from visitledger.checks.registry import check
from visitledger.operators import series
from visitledger.plans import patients
from visitledger.sources import shared_tables as V

CFG = V.CONFIG


def _days(spark, sf):
    return patients.patient_days(V.lines(spark, sf, "F"), V.lines(spark, sf, "O"))


@check("total_patients", "R7 A4 F4", build("SELECT count(DISTINCT patient_id) AS total_patients FROM lines"))
def total_patients(spark, sf):
    return patients.total_patients(_days(spark, sf))


@check("first_visits", "A5", build("SELECT patient_id, min(service_date) AS first_visit FROM lines GROUP BY 1"))
def first_visits(spark, sf):
    return patients.first_visits(_days(spark, sf))


_WEEKLY_NEW = f"""
    SELECT {friday('first_visit')} AS week, count(*) AS new_patients
    FROM (SELECT patient_id, min(service_date) AS first_visit FROM lines GROUP BY 1) WHERE first_visit >= DATE '1995-03-01' GROUP BY 1"""


@check("new_patients_weekly", "R6 A6 U2 W1 W3 F1", build(f"""
    SELECT week, new_patients, avg(new_patients) OVER (ORDER BY week ROWS 3 PRECEDING) AS ma4,
           sum(new_patients) OVER (ORDER BY week) AS cumulative FROM ({_WEEKLY_NEW})""", ratio=("ma4",), ints=("cumulative",)))
def new_patients_weekly(spark, sf):
    return patients.new_patients_weekly(_days(spark, sf), CFG)


@check("campaign_comparison", "R6 A28", build(f"""
    SELECT total_new_patients, avg_per_week, pre_weeks, post_weeks, pre_total, post_total, pre_avg, post_avg,
           CASE WHEN pre_avg > 0 THEN (post_avg - pre_avg) * 100 / pre_avg ELSE 0 END AS percent_change
    FROM (SELECT sum(new_patients) AS total_new_patients, avg(new_patients) AS avg_per_week,
                 count(*) FILTER (week < DATE '1995-07-01') AS pre_weeks, count(*) FILTER (week >= DATE '1995-07-01') AS post_weeks,
                 coalesce(sum(new_patients) FILTER (week < DATE '1995-07-01'), 0) AS pre_total,
                 coalesce(sum(new_patients) FILTER (week >= DATE '1995-07-01'), 0) AS post_total,
                 CASE WHEN pre_weeks > 0 THEN round(CAST(pre_total AS DOUBLE) / pre_weeks, 1) ELSE 0 END AS pre_avg,
                 CASE WHEN post_weeks > 0 THEN round(CAST(post_total AS DOUBLE) / post_weeks, 1) ELSE 0 END AS post_avg
          FROM ({_WEEKLY_NEW}))""",
    ratio=("avg_per_week", "pre_avg", "post_avg", "percent_change"), ints=("total_new_patients", "pre_total", "post_total")))
def campaign_comparison(spark, sf):
    return patients.campaign_comparison(patients.new_patients_weekly(_days(spark, sf), CFG), CFG)


_METRICS_WEEKLY = f"""
    SELECT coalesce(n.week, m.week) AS week, coalesce(new_patients, 0) AS new_patients,
           coalesce(last_value(panel IGNORE NULLS) OVER (ORDER BY coalesce(n.week, m.week)), 0) AS cumulative_patients,
           coalesce(m.allowed, 0) AS allowed, coalesce(m.revenue, 0) AS revenue, coalesce(m.revenue_model, 0) AS revenue_model, coalesce(m.charges, 0) AS charges
    FROM (SELECT week, new_patients, sum(new_patients) OVER (ORDER BY week) AS panel
          FROM (SELECT {friday('first_visit')} AS week, count(*) AS new_patients FROM first_visit GROUP BY 1)) n
    FULL OUTER JOIN (SELECT week, sum(allowed) AS allowed, sum(revenue) AS revenue, sum(revenue_model) AS revenue_model, sum(charge_amount) AS charges
                     FROM charges GROUP BY week) m ON m.week = n.week"""

_METRICS_MONTHLY = f"""
    SELECT CAST(date_trunc('month', week) AS DATE) AS month, sum(revenue) AS revenue, sum(revenue_model) AS revenue_model, sum(charges) AS charges,
           sum(allowed) AS allowed, sum(new_patients) AS new_patients, max_by(cumulative_patients, week) AS panel_eom, count(*) AS weeks_in_month,
           CASE WHEN max_by(cumulative_patients, week) > 0 THEN CAST(sum(revenue_model) AS DOUBLE) / CAST(max_by(cumulative_patients, week) AS DOUBLE) ELSE 0 END AS rev_per_active_patient
    FROM ({_METRICS_WEEKLY}) GROUP BY 1"""


@check("patient_metrics_weekly", "R14 J4 A7 W3 W5", build(
    _METRICS_WEEKLY, money=("allowed", "revenue", "revenue_model", "charges"), ints=("new_patients", "cumulative_patients")))
def patient_metrics_weekly(spark, sf):
    return patients.patient_metrics_weekly(V.charges(spark, sf))


@check("patient_metrics_monthly", "R14 A9 P22 P32", build(
    _METRICS_MONTHLY, money=("revenue", "revenue_model", "charges", "allowed"), ratio=("rev_per_active_patient",), digits=4,
    ints=("new_patients", "panel_eom")), digits=4)
def patient_metrics_monthly(spark, sf):
    return patients.patient_metrics_monthly(patients.patient_metrics_weekly(V.charges(spark, sf)))


_FIT = f"""
    SELECT driver, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n
    FROM (SELECT 'panel' AS driver, CAST(panel_eom AS DOUBLE) AS x, CAST(revenue_model AS DOUBLE) AS y, * EXCLUDE (panel_eom, revenue_model)
          FROM (SELECT *, row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS months FROM ({_METRICS_MONTHLY}) WHERE weeks_in_month >= 3) WHERE months <= 4 OR i > 4
          UNION ALL BY NAME
          SELECT 'new_patients' AS driver, CAST(new_patients AS DOUBLE) AS x, CAST(revenue_model AS DOUBLE) AS y
          FROM (SELECT *, row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS months FROM ({_METRICS_MONTHLY}) WHERE weeks_in_month >= 3) WHERE months <= 4 OR i > 4)
    GROUP BY driver HAVING count(*) >= 3"""


@check("revenue_drivers", "R15 A18 F7", build(f"""
    SELECT driver, round(slope, 2) AS slope, round(intercept, 1) AS intercept, r2, n,
           1 - 2 / sqrt({math.pi}) * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) * angle / 6000
               * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                                        * pow(cos(angle * i / 2000), n - 3))) AS p_value
    FROM (SELECT *, atan2(sqrt(r2), sqrt(1 - r2)) AS angle FROM ({_FIT}))""", ratio=("slope", "intercept", "r2", "p_value")))
def revenue_drivers(spark, sf):
    fits = patients.revenue_drivers(patients.patient_metrics_monthly(patients.patient_metrics_weekly(V.charges(spark, sf))))
    return fits.select("driver", F.round("slope", 2).alias("slope"), F.round("intercept", 1).alias("intercept"), "r2", "n", "p_value")


_GROWTH = f"""
    SELECT week, new_patients, cumulative_patients, CAST(new_patients AS DOUBLE) * 100 / cumulative_patients AS growth_rate,
           avg(new_patients) OVER (ORDER BY week ROWS 3 PRECEDING) AS ma4
    FROM (SELECT week, new_patients, sum(new_patients) OVER (ORDER BY week) AS cumulative_patients, max(week) OVER () AS newest
          FROM (SELECT {friday('first_visit')} AS week, count(*) AS new_patients
                FROM (SELECT min(service_date) AS first_visit FROM charges GROUP BY encounter_id) GROUP BY 1))
    WHERE week >= newest - 364 AND week NOT IN (DATE '2001-03-02', DATE '2001-05-04', DATE '2001-06-15')"""


def _growth(spark, sf):
    """The customers of the shared tables all start early, so each encounter counts as a patient here."""
    return patients.growth_weeks(V.charges(spark, sf, False).withColumn("patient_id", F.col("encounter_id")), CFG)


@check("growth_weeks", "R16 W8 F6 P35 W1", build(_GROWTH, ratio=("growth_rate", "ma4"), ints=("cumulative_patients",)))
def growth_weeks(spark, sf):
    return _growth(spark, sf)


@check("growth_trend", "R16 A18 W9 W11 G21", build(f"""
    WITH g AS (SELECT week, CAST(new_patients AS DOUBLE) AS y, CAST(row_number() OVER (ORDER BY week) - 1 AS DOUBLE) AS x FROM ({_GROWTH})),
    f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS weeks FROM g),
    runs AS (SELECT count(*) AS n FROM (SELECT x - row_number() OVER (ORDER BY x) AS island FROM g WHERE y < 5) GROUP BY island)
    SELECT weeks, slope, intercept, coalesce(r2, 0) AS r2, (SELECT stddev_pop(y - (slope * x + intercept)) FROM g, f) AS residual_std,
           coalesce((SELECT max(n) FROM runs), 0) AS longest_weak_run, coalesce((SELECT max(n) FROM runs), 0) >= 4 AS sustained_drop
    FROM f""", ratio=("slope", "intercept", "r2", "residual_std")))
def growth_trend(spark, sf):
    return patients.growth_trend(_growth(spark, sf))


@check("weak_provider_runs", "W11", build("""
    SELECT provider_raw, max(n) AS longest_run FROM (
        SELECT provider_raw, island, count(*) AS n
        FROM (SELECT provider_raw, x - row_number() OVER (PARTITION BY provider_raw ORDER BY x) AS island
              FROM (SELECT provider_raw, week, total, row_number() OVER (PARTITION BY provider_raw ORDER BY week) AS x
                    FROM (SELECT provider_raw, week, count(*) AS total FROM charges GROUP BY ALL)) WHERE total < 2)
        GROUP BY ALL) GROUP BY provider_raw"""))
def weak_provider_runs(spark, sf):
    weekly = V.charges(spark, sf, False).groupBy("provider_raw", "week").agg(F.count(F.lit(1)).alias("total"))
    return series.longest_run(weekly, "week", F.col("total") < 2, ("provider_raw",))


_FACE = "procedure_code IN ('99213', '99203', '99395', 'G0438')"


@check("provider_visits_weekly", "R17 P30 J6 J7 A14 A19 A7 J4", build(f"""
    WITH enc AS (SELECT upper(trim(provider_raw)) AS provider, encounter_id, bool_or(procedure_code = '99203') AS new_code,
                        bool_or(procedure_code IN ('99395', 'G0438')) AS physical, min(service_date) AS d, min(patient_id) AS patient_id
                 FROM charges GROUP BY 1, 2 HAVING bool_or({_FACE})),
    v AS (SELECT provider, {friday('d')} AS week, count(*) AS total_visits,
                 count(*) FILTER (new_code OR (physical AND d = first_visit)) AS new_patients
          FROM enc JOIN first_visit USING (patient_id) GROUP BY 1, 2),
    m AS (SELECT upper(trim(provider_raw)) AS provider, week, sum(charge_amount) AS total_charges, sum(allowed) AS total_allowed, sum(revenue) AS total_collected
          FROM charges GROUP BY 1, 2)
    SELECT provider, week, coalesce(total_visits, 0) AS total_visits, coalesce(new_patients, 0) AS new_patients,
           coalesce(total_visits, 0) - coalesce(new_patients, 0) AS recurring_patients, coalesce(total_charges, 0) AS total_charges,
           coalesce(total_allowed, 0) AS total_allowed, coalesce(total_collected, 0) AS total_collected
    FROM v FULL OUTER JOIN m USING (provider, week)""", money=("total_charges", "total_allowed", "total_collected")))
def provider_visits_weekly(spark, sf):
    return patients.provider_visits_weekly(V.charges(spark, sf))


@check("provider_visit_totals", "R17 A4 P30", build(f"""
    SELECT upper(trim(provider_raw)) AS provider, count(DISTINCT encounter_id) AS encounters,
           count(DISTINCT CASE WHEN {_FACE} THEN encounter_id END) AS visits, count(DISTINCT patient_id) AS unique_patients
    FROM charges GROUP BY 1"""))
def provider_visit_totals(spark, sf):
    return patients.provider_visit_totals(V.charges(spark, sf))
