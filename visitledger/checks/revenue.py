"""Cross-checks of exam, revenue and forecast reports."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from visitledger.checks.oracle import build, friday
from visitledger.checks.registry import check
from visitledger.operators import series, topk
from visitledger.plans import exams, forecast, revenue
from visitledger.plans.weekly_store import WeeklyStore
from visitledger.session import shared_dir
from visitledger.sources import shared_tables as V

CFG = V.CONFIG


@check("exam_groups", "P29 U4", build("""
    SELECT provider_raw, provider_raw = 'click' AS is_a, provider_raw = 'view' AS is_b, count(*) AS appointments,
           count(*) FILTER (is_no_show) AS no_shows FROM visits_unique GROUP BY ALL"""))
def exam_groups(spark, sf):
    visits = exams.appointments_of(V.exams(spark, sf).withColumn("provider_raw", F.upper("provider_raw")), CFG)
    return visits.groupBy(F.lower("provider_raw").alias("provider_raw"), "is_a", "is_b").agg(
        F.count(F.lit(1)).alias("appointments"), F.count_if("is_no_show").alias("no_shows"))


_VOLUME = f"""
    SELECT {friday('service_date')} AS week, count(*) AS all_appts, count(*) FILTER (provider_raw = 'click') AS raw_a,
           count(*) FILTER (provider_raw = 'view') AS raw_b, count(*) FILTER (provider_raw = 'click' AND is_no_show) AS no_shows_a,
           count(*) FILTER (provider_raw = 'view' AND is_no_show) AS no_shows_b,
           CAST(least(raw_a, 300) AS BIGINT) AS appts_a, CAST(least(raw_b, 300) AS BIGINT) AS appts_b, appts_a + appts_b AS combined_appts,
           no_shows_a + no_shows_b AS combined_no_shows, all_appts - raw_a - raw_b AS others
    FROM visits_unique GROUP BY 1"""


@check("exam_volume_weekly", "R18 J5 A20 P28 P29 P31 U4", build(_VOLUME))
def exam_volume_weekly(spark, sf):
    return exams.exam_volume_weekly(V.exams(spark, sf), CFG)


@check("exam_volume_monthly", "R18 P22", build(f"""
    SELECT CAST(date_trunc('month', week) AS DATE) AS month, sum(appts_a) AS appts_a, sum(appts_b) AS appts_b, sum(all_appts) AS all_appts,
           sum(combined_appts) AS combined_appts FROM ({_VOLUME}) GROUP BY 1""", ints=("appts_a", "appts_b", "all_appts", "combined_appts")))
def exam_volume_monthly(spark, sf):
    return exams.exam_volume_monthly(exams.exam_volume_weekly(V.exams(spark, sf), CFG), CFG)


@check("exam_volume_stats", "R18 A17", build(f"""
    SELECT sum(appts_a) AS total_appts_a, sum(appts_b) AS total_appts_b, sum(combined_appts) AS total_combined_appts,
           sum(all_appts) AS total_all_appts, avg(combined_appts) AS avg_week, count(*) AS n_weeks FROM ({_VOLUME})""",
    ratio=("avg_week",), ints=("total_appts_a", "total_appts_b", "total_combined_appts", "total_all_appts")))
def exam_volume_stats(spark, sf):
    return exams.exam_volume_stats(exams.exam_volume_weekly(V.exams(spark, sf), CFG), CFG)


@check("half_month_revenue", "R19 A21 P21", build("""
    SELECT strftime(service_date, '%Y-%m') || CASE WHEN day(service_date) <= 15 THEN '-H1' ELSE '-H2' END AS half_month,
           sum(exam_revenue) AS exam_revenue FROM exams GROUP BY 1""", money=("exam_revenue",)))
def half_month_revenue(spark, sf):
    return exams.half_month_revenue(V.exams(spark, sf))


@check("receivables", "R20 A13 F13", build("""
    SELECT block, d1 AS after, d2 AS until, coalesce(sum(exam_revenue), 0) AS expected_revenue
    FROM (VALUES ('total', DATE '2024-01-05', DATE '2024-01-25'), ('block 1', DATE '2024-01-05', DATE '2024-01-20'),
                 ('block 2', DATE '2024-01-20', DATE '2024-02-04'), ('block 3', DATE '2024-02-04', DATE '2024-02-19')) b(block, d1, d2)
    LEFT JOIN exams ON service_date > d1 AND service_date <= d2 GROUP BY ALL""", money=("expected_revenue",)))
def receivables(spark, sf):
    return revenue.receivables(V.exams(spark, sf), replace(CFG, as_of=date(2024, 1, 25), receivable_lag_days=20))


_WEEKLY = f"""
    WITH sums AS (
        SELECT coalesce(v.week, p.week) AS week, coalesce(va, 0) AS va_revenue, coalesce(ch, 0) AS pc_charges, coalesce(rev, 0) AS pc_revenue
        FROM (SELECT coalesce(e.week, s.week) AS week, coalesce(e.va, 0) + coalesce(s.amount, 0) AS va
              FROM (SELECT week, sum(exam_revenue) AS va FROM exams GROUP BY week) e
              FULL OUTER JOIN (SELECT {friday('CAST(o_orderdate AS DATE)')} AS week, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount
                               FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) s ON s.week = e.week) v
        FULL OUTER JOIN (SELECT week, sum(charge_amount) AS ch, sum(revenue) AS rev FROM charges GROUP BY week) p ON p.week = v.week),
    est AS (SELECT week, va_revenue, pc_charges, CASE WHEN row_number() OVER (ORDER BY week DESC) <= 10 AND count(*) OVER () >= 10
                        THEN CAST(pc_charges * 0.33 AS DECIMAL(28,4)) ELSE CAST(pc_revenue AS DECIMAL(28,4)) END AS pc_revenue FROM sums),
    costed AS (SELECT *, va_revenue + pc_revenue AS total_revenue,
                      CASE year(week) * 10 + quarter(week) WHEN 19951 THEN 9569 WHEN 19962 THEN 11223 WHEN 19983 THEN 13752
                           WHEN 20013 THEN 13063 WHEN 20241 THEN 13063 ELSE 9569 END AS cost FROM est)
    SELECT *, total_revenue - cost AS profit, CAST(sum(va_revenue) OVER w AS DOUBLE) / count(*) OVER w AS va_revenue_ma8,
           CAST(sum(total_revenue) OVER w AS DOUBLE) / count(*) OVER w AS total_revenue_ma8,
           CAST(sum(total_revenue - cost) OVER w AS DOUBLE) / count(*) OVER w AS profit_ma8
    FROM costed WINDOW w AS (ORDER BY week ROWS 7 PRECEDING)"""


def _weekly(spark, sf):
    return revenue.weekly_revenue(V.charges(spark, sf, False), V.exams(spark, sf), CFG, V.supplemental(spark, sf))


@check("weekly_revenue", "R22 A7 J4 W2 W7 P26", build(
    _WEEKLY, money=("va_revenue", "pc_charges", "pc_revenue", "total_revenue", "cost", "profit"),
    ratio=("va_revenue_ma8", "total_revenue_ma8", "profit_ma8"), digits=7), digits=7)
def weekly_revenue(spark, sf):
    return _weekly(spark, sf)


@check("weekly_revenue_summary", "R22 A27", build(f"""
    SELECT sum(va_revenue) AS sum_va_revenue, sum(pc_revenue) AS sum_pc_revenue, sum(total_revenue) AS sum_total_revenue,
           CAST(sum(va_revenue) AS DOUBLE) / count(*) AS avg_va_revenue, CAST(sum(pc_revenue) AS DOUBLE) / count(*) AS avg_pc_revenue,
           CAST(sum(total_revenue) AS DOUBLE) / count(*) AS avg_total_revenue, count(*) AS weeks, min(week) AS first_week, max(week) AS last_week
    FROM ({_WEEKLY})""", money=("sum_va_revenue", "sum_pc_revenue", "sum_total_revenue"),
    ratio=("avg_va_revenue", "avg_pc_revenue", "avg_total_revenue"), digits=3), digits=3)
def weekly_revenue_summary(spark, sf):
    return revenue.weekly_revenue_summary(_weekly(spark, sf))


_PER_EXAM = f"""
    SELECT exams, revenue, revenue / exams AS revenue_per_exam
    FROM (SELECT count(*) AS exams FROM visits_unique),
         (SELECT CAST(sum(va_revenue) AS DOUBLE) AS revenue FROM ({_WEEKLY}) WHERE week >= DATE '2024-01-01')"""


@check("revenue_per_exam", "R23 A23", build(_PER_EXAM, ratio=("revenue", "revenue_per_exam"), digits=3), digits=3)
def revenue_per_exam(spark, sf):
    return revenue.revenue_per_exam(_weekly(spark, sf), exams.appointments_of(V.exams(spark, sf), CFG), CFG.exam_start)


#: The history starts with the oldest charges, so that it has months with and without exams.
_WHOLE = replace(CFG, exam_start=date(1995, 1, 1))


def _history_charges(spark, sf):
    """Charges, those of one procedure under the name of the first exam group."""
    name = F.when(F.col("procedure_code") == "99213", F.lit("Click")).otherwise(F.col("provider_raw"))
    return V.charges(spark, sf).withColumn("provider_raw", name)


_ALL_EXAMS = f"""
    SELECT revenue / exams AS revenue_per_exam
    FROM (SELECT count(*) AS exams FROM visits_unique),
         (SELECT CAST(sum(va_revenue) AS DOUBLE) AS revenue FROM ({_WEEKLY}) WHERE week >= DATE '1995-01-01')"""

_MONTHS = f"""
    SELECT month, weeks, coalesce(c.exams_a, 0) AS exams_a, coalesce(c.exams_b, 0) AS exams_b,
           (coalesce(c.exams_a, 0) + coalesce(c.exams_b, 0)) / CAST(coalesce(c.exams_all, 1) AS DOUBLE) AS group_share,
           (least(coalesce(c.exams_a, 0), weeks * 300) + least(coalesce(c.exams_b, 0), weeks * 300)) * (SELECT revenue_per_exam FROM ({_ALL_EXAMS})) AS group_va_revenue,
           total_va_revenue, total_pc_revenue, coalesce(g.revenue, 0) AS group_pc_revenue
    FROM (SELECT CAST(date_trunc('month', week) AS DATE) AS month, sum(va_revenue) AS total_va_revenue, sum(pc_revenue) AS total_pc_revenue, count(*) AS weeks
          FROM ({_WEEKLY}) WHERE week >= DATE '1995-01-01' GROUP BY 1 HAVING count(*) >= 3)
    LEFT JOIN (SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, count(*) FILTER (provider_raw = 'click') AS exams_a,
                      count(*) FILTER (provider_raw = 'view') AS exams_b, count(*) AS exams_all FROM visits_unique GROUP BY 1) c USING (month)
    LEFT JOIN (SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, sum(revenue) AS revenue FROM charges
               WHERE procedure_code = '99213' GROUP BY 1) g USING (month)"""


def _stored_weekly(spark, sf):
    """The weekly report over its stored table, computed once for all its readers."""
    store = WeeklyStore(shared_dir(spark, "weekly"), "", "", CFG)
    store.replace(revenue.week_sums(V.charges(spark, sf, False), V.exams(spark, sf), V.supplemental(spark, sf)))
    return store.read(spark)


def _history(spark, sf):
    return revenue.group_revenue_history(_stored_weekly(spark, sf), V.exams(spark, sf), _history_charges(spark, sf), _WHOLE, "a")


@check("group_revenue_history", "R23 A24 J8 P31 F7", build(
    f"SELECT *, group_va_revenue + CAST(group_pc_revenue AS DOUBLE) AS group_total_revenue FROM ({_MONTHS})",
    money=("total_va_revenue", "total_pc_revenue", "group_pc_revenue"), ratio=("group_share", "group_va_revenue", "group_total_revenue"), digits=3), digits=3)
def group_revenue_history(spark, sf):
    return _history(spark, sf)


@check("group_baseline", "R23", build(f"""
    SELECT avg(group_va_revenue) AS va_mean, stddev_samp(group_va_revenue) AS va_std, avg(CAST(group_pc_revenue AS DOUBLE)) AS pc_mean,
           stddev_samp(CAST(group_pc_revenue AS DOUBLE)) AS pc_std, count(*) AS months
    FROM (SELECT * FROM ({_MONTHS}) QUALIFY row_number() OVER (ORDER BY month DESC) <= 6)""",
    ratio=("va_mean", "va_std", "pc_mean", "pc_std"), digits=3), digits=3)
def group_baseline(spark, sf):
    return revenue.group_baseline(_history(spark, sf))


@check("weekly_exam_spread", "R23 A17 G21 G22", build("""
    SELECT exam_group, count(*) AS weeks, avg(n) AS mean_exams, stddev_pop(n) AS std_exams
    FROM (SELECT CASE provider_raw WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' END AS exam_group,
                 CAST(service_date + ((7 - isodow(service_date)) % 7)::INT AS DATE) AS week, least(count(*), 300) AS n
          FROM visits_unique WHERE provider_raw IN ('click', 'view') GROUP BY 1, 2) GROUP BY 1""", ratio=("mean_exams", "std_exams")))
def weekly_exam_spread(spark, sf):
    return revenue.weekly_exam_spread(V.exams(spark, sf), CFG)


@check("panel_value", "R23 A29 A4 P29", build("""
    SELECT CAST(sum(revenue) AS DOUBLE) / count(*) AS revenue_per_line,
           count(DISTINCT CASE WHEN procedure_code = '99213' THEN patient_id END) AS group_panel FROM charges""", ratio=("revenue_per_line",)))
def panel_value(spark, sf):
    return revenue.panel_value(_history_charges(spark, sf), CFG, "a")


@check("crossover_month", "R23 W14", build("""
    SELECT min(month) AS crossover FROM (
        SELECT month, sum(a) OVER (ORDER BY month) AS a, sum(b) OVER (ORDER BY month) AS b
        FROM (SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, sum(charge_amount) FILTER (procedure_code = '99213') AS a,
                     sum(charge_amount) FILTER (procedure_code IN ('99203', '99395', 'G0438')) AS b
              FROM charges GROUP BY 1)) WHERE b >= a"""))
def crossover_month(spark, sf):
    charges = V.charges(spark, sf, False)
    month = F.trunc("service_date", "MM").alias("month")
    a = charges.filter("procedure_code = '99213'").groupBy(month).agg(F.sum("charge_amount").alias("v"))
    b = charges.filter("procedure_code in ('99203', '99395', 'G0438')").groupBy(month).agg(
        F.sum("charge_amount").alias("v"))
    return revenue.crossover_month(a, b, "month", "v")


@check("monday_week_calendar", "A22 G22 F1", build("""
    WITH t AS (SELECT CAST(service_date + ((1 - isodow(service_date) + 7) % 7)::INT AS DATE) AS week, sum(charge_amount) AS v
               FROM charges GROUP BY 1)
    SELECT CAST(w AS DATE) AS week, coalesce(v, 0) AS v
    FROM (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS w FROM t) LEFT JOIN t ON t.week = w""", money=("v",)))
def monday_week_calendar(spark, sf):
    from visitledger.functions import dates

    weekly = V.charges(spark, sf, False).groupBy(dates.week_end(F.col("service_date"), "MON").alias("week")).agg(F.sum("charge_amount").alias("v"))
    return series.weekly_calendar(weekly, "week", "v")


@check("largest_charge_weeks", "T3", build("""
    SELECT week, sum(charge_amount) AS charges FROM charges GROUP BY week ORDER BY charges DESC, week LIMIT 3""", money=("charges",)))
def largest_charge_weeks(spark, sf):
    weekly = V.charges(spark, sf, False).groupBy("week").agg(F.sum("charge_amount").alias("charges"))
    return topk.largest(weekly, "charges", 3, "week")


def _grid_values() -> str:
    from itertools import product

    points = product(forecast.ALPHAS, forecast.BETAS, forecast.GAMMAS, forecast.PHIS)
    return ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE, {p}::DOUBLE)" for a, b, g, p in points)


def _fits(lines: str = "charges") -> str:
    return f"""
    WITH RECURSIVE s AS (
        SELECT provider_raw, first(v ORDER BY t) AS v1, list(v ORDER BY t) AS vals, max(week) AS last_week FROM (
            SELECT g.provider_raw, g.week, coalesce(x.v, 0) AS v, row_number() OVER (PARTITION BY g.provider_raw ORDER BY g.week) AS t
            FROM (SELECT provider_raw, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week
                  FROM (SELECT provider_raw, CAST(service_date + ((1 - isodow(service_date) + 7) % 7)::INT AS DATE) AS week FROM {lines}) GROUP BY provider_raw) g
            LEFT JOIN (SELECT provider_raw, CAST(service_date + ((1 - isodow(service_date) + 7) % 7)::INT AS DATE) AS week, CAST(sum(charge_amount) AS DOUBLE) AS v
                       FROM {lines} GROUP BY ALL) x ON x.provider_raw = g.provider_raw AND x.week = g.week)
        GROUP BY provider_raw HAVING count(*) >= 8),
    fold AS (
        SELECT provider_raw, vals, last_week, alpha, beta, gamma, phi, 0 AS t, (vals[1] + vals[2] + vals[3] + vals[4]) / 4.0::DOUBLE AS level,
               ((vals[5] + vals[6] + vals[7] + vals[8]) / 4.0::DOUBLE - (vals[1] + vals[2] + vals[3] + vals[4]) / 4.0::DOUBLE) / 4.0::DOUBLE AS trend,
               [vals[1] - (vals[1] + vals[2] + vals[3] + vals[4]) / 4.0::DOUBLE, vals[2] - (vals[1] + vals[2] + vals[3] + vals[4]) / 4.0::DOUBLE,
                vals[3] - (vals[1] + vals[2] + vals[3] + vals[4]) / 4.0::DOUBLE, vals[4] - (vals[1] + vals[2] + vals[3] + vals[4]) / 4.0::DOUBLE] AS season,
               0.0::DOUBLE AS sse
        FROM s, (VALUES {_grid_values()}) p(alpha, beta, gamma, phi)
        UNION ALL
        SELECT provider_raw, vals, last_week, alpha, beta, gamma, phi, t + 1, new_level,
               beta * (new_level - level) + (1.0 - beta) * damped,
               [season[2], season[3], season[4], gamma * (v - level - damped) + (1.0 - gamma) * season[1]],
               sse + (v - (level + damped + season[1])) * (v - (level + damped + season[1]))
        FROM (SELECT *, vals[t + 1] AS v, phi * trend AS damped, alpha * (vals[t + 1] - season[1]) + (1.0 - alpha) * (level + phi * trend) AS new_level
              FROM fold WHERE t < len(vals)))
    SELECT * FROM fold WHERE t = len(vals) QUALIFY row_number() OVER (PARTITION BY provider_raw ORDER BY sse, alpha, beta, gamma, phi) = 1"""


@check("charge_forecast", "R21 A22", build(f"""
    SELECT provider_raw, CAST(k AS INT) AS step, CAST(last_week + 7 * k AS DATE) AS week,
           level + list_sum(list_transform(range(1, k + 1), lambda i: pow(phi, i))) * trend + season[(k - 1) % 4 + 1] AS forecast
    FROM ({_fits()}) CROSS JOIN (SELECT CAST(unnest(range(1, 27)) AS INT) AS k)""", ratio=("forecast",), digits=2), digits=2)
def charge_forecast(spark, sf):
    weeks = forecast.charge_weeks(V.charges(spark, sf, False), CFG, ("provider_raw",))
    return forecast.forecast(forecast.fit(weeks, ("provider_raw",)), ("provider_raw",))


_COMPANY = "(SELECT 'ALL' AS provider_raw, service_date, charge_amount FROM charges)"
_AHEAD = f"""
    SELECT CAST(last_week + 7 * k AS DATE) AS week, list_sum(vals) / len(vals) AS avg_hist,
           level + list_sum(list_transform(range(1, k + 1), lambda i: pow(phi, i))) * trend + season[(k - 1) % 4 + 1] AS forecast
    FROM ({_fits(_COMPANY)}) CROSS JOIN (SELECT CAST(unnest(range(1, 27)) AS INT) AS k)"""


def _company_fit(spark, sf):
    return forecast.fit(forecast.charge_weeks(V.charges(spark, sf, False), CFG))


@check("charge_forecast_stats", "R21", build(f"""
    SELECT any_value(avg_hist) AS avg_hist, avg(forecast) AS avg_forecast, (avg(forecast) - any_value(avg_hist)) / any_value(avg_hist) * 100 AS growth_pct
    FROM ({_AHEAD})""", ratio=("avg_hist", "avg_forecast", "growth_pct"), digits=2), digits=2)
def charge_forecast_stats(spark, sf):
    fitted = _company_fit(spark, sf)
    return forecast.forecast_stats(fitted, forecast.forecast(fitted))


@check("charge_forecast_top_weeks", "R21 T3", build(
    f"SELECT week, forecast FROM ({_AHEAD}) ORDER BY forecast DESC, week LIMIT 3", ratio=("forecast",), digits=2), digits=2)
def charge_forecast_top_weeks(spark, sf):
    return forecast.top_weeks(forecast.forecast(_company_fit(spark, sf)))
