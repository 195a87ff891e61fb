"""Cross-checks of productivity, bonus and owner reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitledger.checks.oracle import build, payout, threshold
from visitledger.checks.registry import check
from visitledger.plans import bonus, facts, owner, productivity, revenue
from visitledger.sources import shared_tables as V

CFG = V.CONFIG


def confirmed_fact(spark, sf):
    return facts.rvu_fact(V.charges(spark, sf, False), V.exams(spark, sf), V.aliases(spark, sf), CFG)


def whole_fact(spark, sf):
    return facts.rvu_fact(
        V.charges(spark, sf, False), V.exams(spark, sf), V.aliases(spark, sf), CFG, V.drafts(spark, sf, False))


def grid_of(spark, sf):
    return owner.owner_grid(confirmed_fact(spark, sf), CFG)


@check("weekly_points", "A1 F4", build(
    "SELECT week, sum(rvu) AS rvu FROM fact WHERE source = 'confirmed' GROUP BY week", money=("rvu",)))
def weekly_points(spark, sf):
    return productivity.weekly_points(confirmed_fact(spark, sf))


@check("provider_weekly_points", "A2", build(
    "SELECT provider, week, sum(rvu) AS rvu FROM fact WHERE source = 'confirmed' GROUP BY ALL", money=("rvu",)))
def provider_weekly_points(spark, sf):
    return productivity.provider_weekly_points(confirmed_fact(spark, sf))


@check("provider_pivot", "A3", build(
    "SELECT week, " + ", ".join(f"coalesce(sum(rvu) FILTER (provider = 'NATION_{i}'), 0) AS NATION_{i}" for i in range(25))
    + " FROM fact WHERE source = 'confirmed' GROUP BY week", money=tuple(f"NATION_{i}" for i in range(25))))
def provider_pivot(spark, sf):
    return productivity.provider_pivot(confirmed_fact(spark, sf), CFG)


@check("manual_adjustment", "U7 G15", build("""
    SELECT week AS service_date, 'NATION_0' AS provider, 216::DOUBLE / count(*) OVER () AS rvu, 'Manual Adjustment' AS category,
           'confirmed' AS source, week
    FROM (SELECT DISTINCT week FROM fact WHERE source = 'confirmed')""", ratio=("rvu",)))
def manual_adjustment(spark, sf):
    return productivity.manual_adjustment_rows(whole_fact(spark, sf), CFG)


@check("provider_trend", "R9 R10 A2 J12 W1 W3 W15 P25", build(f"""
    SELECT provider, week, rvu, CAST(sum(rvu) OVER w4 AS DOUBLE) / count(*) OVER w4 AS rolling4,
           sum(rvu) OVER (PARTITION BY provider ORDER BY week) AS cumulative, rvu - {threshold('week', 6, 7)} AS distance
    FROM (SELECT w.week, r.provider, coalesce(s.rvu, 0) AS rvu
          FROM (SELECT DISTINCT week FROM fact WHERE source = 'confirmed') w CROSS JOIN registry r
          LEFT JOIN (SELECT provider, week, sum(rvu) AS rvu FROM fact WHERE source = 'confirmed' GROUP BY ALL) s
                 ON s.week = w.week AND s.provider = r.provider)
    WINDOW w4 AS (PARTITION BY provider ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    money=("rvu", "cumulative", "distance"), ratio=("rolling4",)))
def provider_trend(spark, sf):
    return productivity.provider_trend(confirmed_fact(spark, sf), CFG)


_WEEK_SPLIT = """
    SELECT week, provider, CASE WHEN own IS NULL AND credit IS NULL THEN NULL ELSE coalesce(own, 0) + coalesce(credit, 0) END AS confirmed,
           draft, has_confirmed
    FROM (SELECT w.week, r.provider, CAST(sum(f.rvu) FILTER (f.source = 'confirmed') AS DOUBLE) AS own,
                 CAST(sum(f.rvu) FILTER (f.source = 'pipeline') AS DOUBLE) AS draft, any_value(w.has_confirmed) AS has_confirmed,
                 CASE WHEN r.provider = 'NATION_0' AND any_value(w.has_confirmed) THEN 216::DOUBLE / any_value(w.n) END AS credit
          FROM (SELECT week, has_confirmed, count(*) FILTER (has_confirmed) OVER () AS n
                FROM (SELECT week, bool_or(source = 'confirmed') AS has_confirmed FROM fact GROUP BY week)) w
          CROSS JOIN registry r LEFT JOIN fact f ON f.week = w.week AND f.provider = r.provider
          GROUP BY w.week, r.provider)"""

_COMPANY = f"""
    SELECT week, confirmed_rvu, coalesce(confirmed_rvu, 0) + coalesce(draft_rvu, 0) AS combined_rvu,
           {threshold('week', 190, 150)} AS breakeven, {threshold('week', 330, 280)} AS target,
           confirmed_rvu IS NOT NULL AND row_number() OVER (PARTITION BY confirmed_rvu IS NOT NULL ORDER BY week DESC) <= 3
               AND count(confirmed_rvu) OVER () >= 3 AS may_be_incomplete
    FROM (SELECT week, sum(confirmed) AS confirmed_rvu, sum(draft) AS draft_rvu FROM ({_WEEK_SPLIT}) GROUP BY week)
    WHERE confirmed_rvu IS NOT NULL OR draft_rvu IS NOT NULL"""

_PER_PROVIDER = """
    SELECT week, provider, confirmed_rvu, coalesce(confirmed_rvu, 0) + coalesce(draft, 0) AS combined_rvu,
           {breakeven} AS breakeven, {target} AS target,
           confirmed_rvu IS NOT NULL AND row_number() OVER (PARTITION BY provider, confirmed_rvu IS NOT NULL ORDER BY week DESC) <= 3
               AND count(confirmed_rvu) OVER (PARTITION BY provider) >= 3 AS may_be_incomplete
    FROM (SELECT week, provider, {shown} AS confirmed_rvu, draft FROM ({split}) WHERE provider <> 'NATION_7')
    WHERE confirmed_rvu IS NOT NULL OR draft IS NOT NULL"""


@check("company_weekly_view", "R2 A1 J10 P25 W16 U7 F2 G25", build(_COMPANY, ratio=("confirmed_rvu", "combined_rvu")))
def company_weekly_view(spark, sf):
    return productivity.company_weekly(whole_fact(spark, sf), CFG)


@check("provider_comparison_view", "R2 A3 F8 J10", build(_PER_PROVIDER.format(
    breakeven=threshold("week", 6, 7), target=threshold("week", 10, 12),
    shown="coalesce(confirmed, CASE WHEN has_confirmed THEN 0 END)", split=_WEEK_SPLIT), ratio=("confirmed_rvu", "combined_rvu")))
def provider_comparison_view(spark, sf):
    return productivity.provider_comparison(whole_fact(spark, sf), CFG)


@check("provider_weekly_view", "R2 F8 J10", build(_PER_PROVIDER.format(
    breakeven=threshold("week", 6, 7), target=threshold("week", 10, 12), shown="confirmed", split=_WEEK_SPLIT),
    ratio=("confirmed_rvu", "combined_rvu")))
def provider_weekly_view(spark, sf):
    return productivity.provider_weekly(whole_fact(spark, sf), CFG)


@check("current_quarter_bonus", "R3 P20 F9 A8 A15 P27 P33 P34", build(f"""
    SELECT 'Q3 2001' AS quarter_label, 46 AS days_elapsed, 92 AS days_in_quarter, provider, rvus_earned,
           {payout('rvus_earned')} AS bonus_earned, projected_rvus, {payout('floor(projected_rvus)')} AS projected_bonus,
           draft_rvus, conversion_rate, rvus_earned + floor(draft_rvus * conversion_rate) AS estimated_total_rvus,
           draft_rvus AS pipeline_rvus, rvus_earned + draft_rvus AS total_with_pipeline
    FROM (SELECT r.provider, floor(coalesce(CAST(earned AS DOUBLE), 0) + CASE WHEN r.provider = 'NATION_0' THEN 216::DOUBLE * quarter_weeks / all_weeks ELSE 0 END) AS rvus_earned,
                 rvus_earned * 92::DOUBLE / 46 AS projected_rvus, coalesce(CAST(drafted AS DOUBLE), 0) AS draft_rvus,
                 least(greatest(CAST(c AS DOUBLE) / (CAST(c AS DOUBLE) + CAST(p AS DOUBLE)), 0.5), 1.0) AS conversion_rate
          FROM registry r
          LEFT JOIN (SELECT provider, sum(rvu) FILTER (source = 'confirmed') AS earned, sum(rvu) FILTER (source = 'pipeline') AS drafted
                     FROM fact WHERE service_date >= DATE '2001-07-01' AND service_date < DATE '2001-10-01' GROUP BY provider) q USING (provider)
          CROSS JOIN (SELECT sum(rvu) FILTER (source = 'confirmed') AS c, sum(rvu) FILTER (source = 'pipeline') AS p,
                             count(DISTINCT week) FILTER (source = 'confirmed') AS all_weeks,
                             count(DISTINCT week) FILTER (source = 'confirmed' AND service_date >= DATE '2001-07-01' AND service_date < DATE '2001-10-01') AS quarter_weeks
                      FROM fact))""",
    ratio=("bonus_earned", "projected_rvus", "projected_bonus", "draft_rvus", "conversion_rate", "pipeline_rvus", "total_with_pipeline"),
    ints=("rvus_earned", "estimated_total_rvus")))
def current_quarter_bonus(spark, sf):
    return bonus.current_quarter_bonus(whole_fact(spark, sf), CFG, with_pipeline=True)


@check("past_quarter_bonus", "R4 A8 P27 G13", build(f"""
    SELECT 'Q2 2000' AS quarter_label, provider, total_rvus, 80 AS threshold_rvus, {payout('total_rvus')} AS bonus_earned
    FROM (SELECT r.provider, floor(coalesce(CAST(earned AS DOUBLE), 0) + CASE WHEN r.provider = 'NATION_0' THEN 216::DOUBLE * quarter_weeks / all_weeks ELSE 0 END) AS total_rvus
          FROM registry r
          LEFT JOIN (SELECT provider, sum(rvu) AS earned FROM fact WHERE source = 'confirmed' AND service_date BETWEEN DATE '2000-04-01' AND DATE '2000-06-30' GROUP BY 1) q USING (provider)
          CROSS JOIN (SELECT count(DISTINCT week) AS all_weeks, count(DISTINCT week) FILTER (week BETWEEN DATE '2000-04-01' AND DATE '2000-06-30') AS quarter_weeks
                      FROM fact WHERE source = 'confirmed'))""", ratio=("bonus_earned",), ints=("total_rvus",)))
def past_quarter_bonus(spark, sf):
    return bonus.past_quarter_bonus(confirmed_fact(spark, sf), CFG, 2000, 2)


@check("available_quarters", "T5", build("""
    SELECT DISTINCT year(service_date) || 'Q' || quarter(service_date) AS quarter FROM fact WHERE source = 'confirmed'
    UNION SELECT '2001Q3'"""))
def available_quarters(spark, sf):
    return bonus.available_quarters(confirmed_fact(spark, sf), CFG)


@check("revenue_per_rvu", "R5 A10 P32 F2", build("""
    SELECT *, CASE WHEN total_rvus > 0 THEN CAST(total_revenue AS DOUBLE) / CAST(total_rvus AS DOUBLE) ELSE 0 END AS dollars_per_rvu,
           CASE WHEN section = 'summary' THEN CAST(total_revenue AS DOUBLE) / CAST(total_rvus AS DOUBLE) - 80 END AS benchmark_delta
    FROM (SELECT 'weekly' AS section, strftime(week, '%Y-%m-%d') AS subject, sum(rvu) AS total_rvus, sum(revenue) AS total_revenue FROM money_fact GROUP BY week
          UNION ALL SELECT 'provider', provider, sum(rvu), sum(revenue) FROM money_fact GROUP BY provider
          UNION ALL SELECT 'quarter', provider, sum(rvu), sum(revenue) FROM money_fact WHERE service_date >= DATE '2001-07-01' GROUP BY provider
          UNION ALL SELECT 'summary', 'ALL', sum(rvu), sum(revenue) FROM money_fact)""",
    money=("total_rvus", "total_revenue"), ratio=("dollars_per_rvu", "benchmark_delta")))
def revenue_per_rvu(spark, sf):
    fact = facts.revenue_fact(V.charges(spark, sf, False), V.exams(spark, sf), V.aliases(spark, sf), CFG)
    return revenue.revenue_per_rvu(fact, CFG)


_CARDS = f"""
    SELECT provider, sum(rvu) AS total_rvus, avg(rvu) AS avg_weekly,
           avg(CASE WHEN rvu >= {threshold('week', 6, 7)} THEN 1.0 ELSE 0.0 END) * 100 AS breakeven_hit_rate,
           avg(CASE WHEN rvu >= {threshold('week', 10, 12)} THEN 1.0 ELSE 0.0 END) * 100 AS industry_hit_rate,
           max(rvu) AS best_week, min(rvu) AS worst_week, stddev_samp(rvu) AS std_dev,
           avg(rvu) FILTER (age <= 4) AS recent, avg(rvu) FILTER (age BETWEEN 5 AND 8) AS prior, count(*) AS weeks_count
    FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY week DESC) AS age FROM owner_grid) GROUP BY provider"""


@check("provider_scorecards", "R8 F5 J12 A16 A17 W6 G21", build(f"""
    SELECT * EXCLUDE (recent, prior), CASE WHEN prior > 0 THEN (recent - prior) * 100 / prior ELSE 0 END AS trend_pct,
           CASE WHEN trend_pct > 5 THEN 'Improving' WHEN trend_pct < -5 THEN 'Declining' ELSE 'Stable' END AS trend
    FROM ({_CARDS})""", ratio=("total_rvus", "avg_weekly", "breakeven_hit_rate", "industry_hit_rate", "best_week", "worst_week", "std_dev", "trend_pct")))
def provider_scorecards(spark, sf):
    return owner.scorecards(grid_of(spark, sf), CFG)


@check("owner_provider_trends", "R9 W1 W3 J12", build(f"""
    SELECT provider, week, rvu, avg(rvu) OVER (PARTITION BY provider ORDER BY week ROWS 3 PRECEDING) AS rolling4,
           sum(rvu) OVER (PARTITION BY provider ORDER BY week) AS cumulative, {threshold('week', 6, 7)} AS ind_breakeven,
           {threshold('week', 10, 12)} AS ind_industry
    FROM owner_grid""", ratio=("rvu", "rolling4", "cumulative")))
def owner_provider_trends(spark, sf):
    return owner.provider_trends(grid_of(spark, sf), CFG)


@check("owner_company_trends", "R9 W4 G17", build(f"""
    SELECT week, rvu, least(greatest(CASE WHEN before IS NULL OR (before = 0 AND rvu = 0) THEN 0 WHEN before = 0 THEN 200 ELSE (rvu / before - 1) * 100 END, -200), 200) AS wow_pct,
           {threshold('week', 190, 150)} AS co_breakeven, {threshold('week', 330, 280)} AS co_industry
    FROM (SELECT *, lag(rvu) OVER (ORDER BY week) AS before FROM owner_company)""", ratio=("rvu", "wow_pct")))
def owner_company_trends(spark, sf):
    return owner.company_trends(grid_of(spark, sf), CFG)


@check("breakeven_distances", "R10 W15", build(f"""
    SELECT week, provider, rvu - {threshold('week', 6, 7)} AS distance FROM owner_grid
    UNION ALL SELECT week, 'ALL', rvu - {threshold('week', 190, 150)} FROM owner_company""", ratio=("distance",)))
def breakeven_distances(spark, sf):
    return owner.breakeven_distances(grid_of(spark, sf), CFG)


@check("breakeven_rates", "R10 A16", build(f"""
    SELECT provider, breakeven_hit_rate AS hit_rate, industry_hit_rate, avg_weekly FROM ({_CARDS})""",
    ratio=("hit_rate", "industry_hit_rate", "avg_weekly")))
def breakeven_rates(spark, sf):
    return owner.breakeven_rates(grid_of(spark, sf), CFG)


@check("owner_monthly", "R11 A11 A12 P22", build(f"""
    SELECT CAST(date_trunc('month', week) AS DATE) AS month, provider, sum(rvu) AS rvu, CAST(NULL AS BIGINT) AS breakeven, CAST(NULL AS BIGINT) AS industry
    FROM owner_grid GROUP BY 1, 2
    UNION ALL SELECT CAST(date_trunc('month', week) AS DATE), 'ALL', sum(rvu), CAST(sum({threshold('week', 190, 150)}) AS BIGINT),
           CAST(sum({threshold('week', 330, 280)}) AS BIGINT) FROM owner_company GROUP BY 1""", ratio=("rvu",)))
def owner_monthly(spark, sf):
    return owner.monthly_totals(grid_of(spark, sf), CFG)


_NAME = "upper(left(provider, 1)) || lower(substr(provider, 2))"


@check("owner_insights", "R12 A25 T7 W6", build(f"""
    WITH c AS ({_CARDS}),
    k AS (SELECT c.*, r.seq + 1 AS rank, CASE WHEN prior > 0 THEN (recent - prior) * 100 / prior ELSE 0 END AS change,
                 CASE WHEN avg_weekly > 0 THEN std_dev / avg_weekly ELSE 0 END AS cv, {_NAME} AS name FROM c JOIN registry r USING (provider)),
    m AS (SELECT avg(rvu) AS mean FROM owner_company),
    lows AS (SELECT week, row_number() OVER (ORDER BY week) AS i, count(*) OVER () AS n, mean FROM owner_company CROSS JOIN m WHERE rvu < mean * 0.5)
    SELECT 'company_on_target' AS rule, 'ALL' AS subject, 'success' AS type, mean AS metric, 150 AS threshold,
           printf('All providers together average %.1f RVUs a week, enough for the weekly floor of 150.', mean) AS text FROM m WHERE mean >= 150
    UNION ALL SELECT 'company_below', 'ALL', 'warning', mean, 150,
           printf('All providers together average %.1f RVUs a week: %.1f short of the weekly floor of 150.', mean, 150 - mean) FROM m WHERE mean < 150
    UNION ALL SELECT 'below_breakeven', provider, 'alert', avg_weekly, 7,
           printf('%s: %.1f RVUs a week on average, %.1f under the own floor of 7.', name, avg_weekly, 7 - avg_weekly) FROM k WHERE avg_weekly < 7
    UNION ALL SELECT 'at_industry', provider, 'success', avg_weekly, 12,
           printf('%s reaches the target of 12 RVUs a week with a mean of %.1f.', name, avg_weekly) FROM k WHERE avg_weekly >= 12
    UNION ALL SELECT 'declined', provider, 'alert', change, -20,
           printf('%s made %.0f%% less in the latest four weeks than in the four before.', name, abs(change)) FROM k WHERE prior > 0 AND change <= -20
    UNION ALL SELECT 'rising', provider, 'success', change, 20,
           printf('%s made %.0f%% more in the latest four weeks than in the four before.', name, change) FROM k WHERE prior > 0 AND change >= 20
    UNION ALL SELECT 'variable', provider, 'info', cv, 0.6,
           printf('Weeks of %s differ much (standard deviation %.1f RVUs); look at how the days are booked.', name, std_dev) FROM k WHERE cv > 0.6
    UNION ALL SELECT 'extremes', t.provider, 'info', t.avg_weekly, l.avg_weekly,
           printf('Highest mean: %s with %.1f RVUs a week; lowest mean: %s with %.1f.', t.name, t.avg_weekly, l.name, l.avg_weekly)
        FROM (SELECT * FROM k ORDER BY avg_weekly DESC, rank LIMIT 1) t, (SELECT * FROM k ORDER BY avg_weekly, rank LIMIT 1) l WHERE t.provider <> l.provider
    UNION ALL SELECT 'low_weeks', 'ALL', 'info', any_value(n), any_value(mean) * 0.5,
           'Weeks under half of the usual production: ' || string_agg(strftime(week, '%b %-d'), ', ' ORDER BY week)
           || CASE WHEN any_value(n) > 3 THEN ' and ' || any_value(n) - 3 || ' others' ELSE '' END || '.' FROM lows WHERE i <= 3 HAVING count(*) > 0""",
    ratio=("metric", "threshold")))
def owner_insights(spark, sf):
    return owner.recommendations(grid_of(spark, sf), CFG).drop("seq")


@check("low_weeks", "T7", build("""
    SELECT CAST(row_number() OVER (ORDER BY week) AS INT) AS seq, week, rvu, mean, count(*) OVER () AS low_weeks
    FROM owner_company CROSS JOIN (SELECT avg(rvu) AS mean FROM owner_company) WHERE rvu < mean * 0.5 QUALIFY seq <= 3""", ratio=("rvu", "mean")))
def low_weeks(spark, sf):
    return owner.low_weeks(grid_of(spark, sf))


@check("owner_sections", "R13", build(f"""
    SELECT 'scorecards' AS section, (SELECT count(*) FROM ({_CARDS})) AS n
    UNION ALL SELECT 'provider_trends', (SELECT count(*) FROM owner_grid)
    UNION ALL SELECT 'company_trends', (SELECT count(*) FROM owner_company)
    UNION ALL SELECT 'breakeven_distances', (SELECT count(*) FROM owner_grid) + (SELECT count(*) FROM owner_company)
    UNION ALL SELECT 'breakeven_rates', 25
    UNION ALL SELECT 'monthly', 26 * (SELECT count(DISTINCT date_trunc('month', week)) FROM owner_weeks)"""))
def owner_sections(spark, sf):
    sections = owner.owner_report(confirmed_fact(spark, sf), CFG)
    parts = [
        sections[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "n")
        for name in ("scorecards", "provider_trends", "company_trends", "breakeven_distances", "breakeven_rates", "monthly")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # Six rows: taken here so that the grid need not stay in the session's cache.
    found = spark.createDataFrame(rows.collect(), rows.schema)
    sections["grid"].unpersist()
    return found
