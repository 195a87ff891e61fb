from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta
from decimal import Decimal

import pytest
from helpers import CFG, charge_frame, fact, friday
from pyspark.sql import functions as F

from visitledger.plans import bonus, exams, facts, forecast, owner, patients, productivity, quality, revenue, scheduling
from visitledger.sources import schemas as S
from visitledger.sources.loaders import derive_exams

Q1 = date(2026, 1, 15)


def by(frame, key="provider"):
    return {r[key]: r for r in frame.collect()}


def exam_frame(spark, rows):
    names = ("case_id", "patient_id", "provider_raw", "service_date", "focused", "opinions", "tbi", "genmed", "no_show")
    schema = ", ".join(f"{n} {'date' if n == 'service_date' else 'string'}" for n in names)
    filled = [tuple(row.get(n, "0") for n in names) for row in rows]
    return derive_exams(spark.createDataFrame(filled, schema))


# -- bonus --------------------------------------------------------------------------------------------------


def test_past_quarter_floors_and_pays(spark):
    rows = [(Q1, "P2", 2.5), (Q1, "P3", 637.9), (Q1, "P4", 900), (Q1, "OTHER", 5)]
    got = by(bonus.past_quarter_bonus(fact(spark, rows), CFG, 2026, 1))
    assert list(got) == ["P1", "P2", "P3", "P4"]
    assert [got[p]["total_rvus"] for p in got] == [216, 2, 637, 900]
    assert [got[p]["bonus_earned"] for p in got] == [0, 0, 0, 6465]
    assert got["P1"]["threshold_rvus"] == 689 and got["P1"]["quarter_label"] == "Q1 2026"


def test_quarter_straddling_week_counts_differently(spark):
    rows = [(date(2025, 12, 30), "P2", 1), (date(2026, 1, 14), "P2", 1)]
    frame = fact(spark, rows)
    past = by(bonus.past_quarter_bonus(frame, CFG, 2025, 4))["P1"]
    assert past["total_rvus"] == 0
    assert by(bonus.past_quarter_bonus(frame, CFG, 2026, 1))["P1"]["total_rvus"] == 216
    current = by(bonus.current_quarter_bonus(frame, replace(CFG, as_of=date(2025, 12, 31))))["P1"]
    assert current["rvus_earned"] == 108


def test_current_quarter(spark):
    rows = [(Q1, "P2", 90.7), (Q1, "P2", 10.5, "pipeline"), (date(2025, 11, 5), "P2", 700), (date(2025, 11, 5), "X", 8)]
    got = by(bonus.current_quarter_bonus(fact(spark, rows), CFG, with_pipeline=True))
    p2 = got["P2"]
    assert (p2["quarter_label"], p2["days_elapsed"], p2["days_in_quarter"]) == ("Q1 2026", 46, 90)
    assert p2["rvus_earned"] == 90 and p2["projected_rvus"] == pytest.approx(90 * 90 / 46)
    rate = 798.7 / 809.2
    assert p2["conversion_rate"] == pytest.approx(rate)
    assert p2["estimated_total_rvus"] == 90 + int(10.5 * rate)
    assert got["P1"]["rvus_earned"] == 108
    assert all(r["estimated_total_rvus"] >= r["rvus_earned"] for r in got.values())
    assert p2["total_with_pipeline"] == 100.5


def test_draft_rate_default_and_empty_fact(spark):
    got = by(bonus.current_quarter_bonus(fact(spark, []), CFG))
    assert len(got) == 4 and all(r["rvus_earned"] == 0 and r["conversion_rate"] == 0.85 for r in got.values())
    low = by(bonus.current_quarter_bonus(fact(spark, [(Q1, "P2", 1), (Q1, "P2", 9, "pipeline")]), CFG))
    assert low["P2"]["conversion_rate"] == 0.5


def test_available_quarters(spark):
    frame = fact(spark, [(date(2025, 11, 5), "P2", 1), (date(2025, 8, 5), "P2", 1)])
    assert [r["quarter"] for r in bonus.available_quarters(frame, CFG).collect()] == ["2026Q1", "2025Q4", "2025Q3"]


def test_group_baseline_takes_the_newest_six_months(spark):
    rows = [(date(2025, m, 1), 1000.0 * m, Decimal(m)) for m in range(1, 9)]
    got = revenue.group_baseline(spark.createDataFrame(rows, "month date, group_va_revenue double, group_pc_revenue decimal(18,2)")).first()
    spread = 3.5 ** 0.5
    assert got["months"] == 6 and got["va_mean"] == 5500 and got["pc_mean"] == 5.5
    assert got["va_std"] == pytest.approx(1000 * spread) and got["pc_std"] == pytest.approx(spread)


# -- productivity and owner ---------------------------------------------------------------------------------


def test_weekly_views(spark):
    rows = [(date(2026, 1, 5), "P2", 10), (date(2026, 1, 12), "P2", 20), (date(2026, 1, 12), "P3", 5, "pipeline"),
            (date(2026, 1, 19), "NOBODY", 50), (date(2026, 1, 26), "P2", 1, "pipeline")]
    frame, cfg = fact(spark, rows), replace(CFG, hidden_providers=("P1",))
    company = by(productivity.company_weekly(frame, cfg), "week")
    assert [company[d]["confirmed_rvu"] for d in sorted(company)] == [82, 92, 72, None]
    assert [company[d]["combined_rvu"] for d in sorted(company)] == [82, 97, 72, 1]
    assert [company[d]["may_be_incomplete"] for d in sorted(company)] == [True, True, True, False]
    side = productivity.provider_comparison(frame, cfg).collect()
    assert {r["provider"] for r in side} == {"P2", "P3", "P4"}
    assert {(r["provider"], r["confirmed_rvu"]) for r in side if r["week"] == date(2026, 1, 23)} == {("P2", 0), ("P3", 0), ("P4", 0)}
    own = productivity.provider_weekly(frame, cfg, "p2").orderBy("week").collect()
    assert [(r["confirmed_rvu"], r["combined_rvu"]) for r in own] == [(10, 10), (20, 20), (None, 1)]
    assert productivity.provider_weekly(frame, cfg, "P1").isEmpty()


def test_pivot_sums_equal_weekly(spark):
    frame = fact(spark, [(date(2026, 1, 5) + timedelta(days=i), f"P{1 + i % 4}", i) for i in range(40)])
    wide = productivity.provider_pivot(frame, CFG).collect()
    weekly = {r["week"]: r["rvu"] for r in productivity.weekly_points(frame).collect()}
    assert {r["week"]: sum(r[p] for p in CFG.providers) for r in wide} == weekly


def test_manual_adjustment_totals(spark):
    frame = fact(spark, [(date(2026, 1, 5), "P2", 1), (date(2026, 1, 12), "X", 1), (date(2026, 1, 19), "P2", 1, "pipeline")])
    rows = productivity.manual_adjustment_rows(frame, CFG).collect()
    assert [r["rvu"] for r in rows] == [108, 108] and {r["provider"] for r in rows} == {"P1"}


def owner_fact(spark):
    rows = []
    for i in range(12):
        day = date(2025, 10, 6) + timedelta(days=7 * i)
        rows += [(day, "P2", 60 if i < 8 else 30), (day, "P3", 100), (day, "P4", 0.5 if i % 2 else 80)]
    return fact(spark, rows + [(date(2026, 2, 13), "P2", 999)])


def test_scorecards(spark):
    grid = owner.owner_grid(owner_fact(spark), CFG)
    assert grid.count() == 48
    cards = by(owner.scorecards(grid, CFG))
    assert cards["P1"]["total_rvus"] == pytest.approx(216) and cards["P1"]["std_dev"] == pytest.approx(0)
    assert cards["P2"]["trend"] == "Declining" and cards["P2"]["trend_pct"] == -50
    assert cards["P3"]["industry_hit_rate"] == 100 and cards["P4"]["breakeven_hit_rate"] == 50
    assert cards["P2"]["best_week"] == 60 and cards["P2"]["weeks_count"] == 12


def test_company_totals_agree(spark):
    grid = owner.owner_grid(owner_fact(spark), CFG)
    total = grid.agg(F.sum("rvu")).first()[0]
    assert owner.company_trends(grid, CFG).agg(F.sum("rvu")).first()[0] == pytest.approx(total)
    monthly = owner.monthly_totals(grid, CFG)
    assert monthly.filter("provider = 'ALL'").agg(F.sum("rvu")).first()[0] == pytest.approx(total)
    october = monthly.filter("provider = 'ALL' and month = '2025-10-01'").first()
    assert october["breakeven"] == 196 * 4
    distances = owner.breakeven_distances(grid, CFG).filter("provider = 'P3'").collect()
    assert {r["distance"] for r in distances} == {51}
    assert by(owner.breakeven_rates(grid, CFG))["P3"]["hit_rate"] == 100


def test_many_low_weeks(spark):
    start = date(2025, 9, 5)
    rows = [(start + timedelta(days=7 * i), "P2", 10.0 if i in (1, 4, 5, 9, 16) else 100.0) for i in range(17)]
    grid = spark.createDataFrame(rows, "week date, provider string, rvu double")
    found = owner.low_weeks(grid).collect()
    assert [(r["seq"], r["week"], r["low_weeks"]) for r in found] == [
        (1, rows[1][0], 5), (2, rows[4][0], 5), (3, rows[5][0], 5)]
    text = owner.recommendations(grid, CFG).filter("rule = 'low_weeks'").first()["text"]
    assert text.endswith("Sep 12, Oct 3, Oct 10 and 2 others.")


def test_recommendations(spark):
    rows = owner.recommendations(owner.owner_grid(owner_fact(spark), CFG), CFG).collect()
    found = {(r["rule"], r["subject"]) for r in rows}
    assert ("company_on_target", "ALL") in found and ("below_breakeven", "P1") in found and ("at_industry", "P3") in found
    assert ("declined", "P2") in found and ("variable", "P4") in found and ("extremes", "P3") in found
    assert next(r["text"] for r in rows if r["rule"] == "declined") == "P2 made 50% less in the latest four weeks than in the four before."
    assert [r["seq"] for r in rows] == sorted(r["seq"] for r in rows)


def test_owner_report_shares_one_grid(spark):
    sections = owner.owner_report(owner_fact(spark), CFG)
    assert set(sections) == {"grid", "scorecards", "provider_trends", "company_trends", "breakeven_distances",
                             "breakeven_rates", "monthly", "recommendations"}
    sections["scorecards"].collect()
    assert "InMemoryTableScan" in sections["monthly"]._jdf.queryExecution().executedPlan().toString()
    sections["grid"].unpersist()


def test_fact_selectors_and_bounds(spark):
    charges = charge_frame(spark, [
        dict(service_date="2026-01-05", provider_raw="P1last, P1first ", charge_amount="$150", code_text="99213", epid="e1"),
        dict(service_date="2025-09-30", provider_raw="P1", charge_amount="1", code_text="99213", epid="e2")])
    drafts = charge_frame(spark, [
        dict(service_date="2026-01-06", provider_raw="P2", charge_amount="$1,200.00", code_text="DOT", epid="e1"),
        dict(service_date="2026-01-06", provider_raw="P2", charge_amount="$1,200.00", code_text="DOT", epid="e9")])
    va = exam_frame(spark, [dict(case_id="c", patient_id="x", provider_raw="p4", service_date=date(2026, 1, 7), opinions="1-3")])
    names = CFG.alias_table(spark)

    def rows(**kw):
        return sorted((r["provider"], float(r["rvu"]), r["source"], r["week"]) for r in facts.rvu_fact(charges, va, names, CFG, **kw).collect())

    week = date(2026, 1, 9)
    pc, exam, draft = ("P1", 1.3, "confirmed", week), ("P4", 4.5, "confirmed", week), ("P2", 1.0, "pipeline", week)
    assert rows() == [pc, exam]
    assert rows(drafts=drafts) == sorted([pc, exam, draft])
    assert rows(source="va", drafts=drafts) == [exam] and rows(source="pc", drafts=drafts) == [pc, draft]


def test_revenue_per_rvu(spark):
    charges = charge_frame(spark, [
        dict(service_date="2026-01-05", provider_raw="P1", charge_amount="100", code_text="99213", epid="a"),
        dict(service_date="2025-11-05", provider_raw="P1", charge_amount="100", pri_adjustment="20", code_text="99213", epid="b"),
        dict(service_date="2026-01-05", provider_raw="X", charge_amount="100", code_text="99213", epid="c")])
    va = exam_frame(spark, [dict(case_id="c", patient_id="x", provider_raw="P4", service_date=date(2026, 1, 7), no_show="1")])
    got = {(r["section"], r["subject"]): r for r in revenue.revenue_per_rvu(
        facts.revenue_fact(charges, va, CFG.alias_table(spark), CFG), CFG).collect()}
    assert set(got) == {("weekly", "2026-01-09"), ("weekly", "2025-11-07"), ("provider", "P1"), ("provider", "P4"),
                        ("quarter", "P1"), ("quarter", "P4"), ("summary", "ALL")}
    assert float(got["provider", "P1"]["total_revenue"]) == pytest.approx(112.87)
    assert got["quarter", "P1"]["dollars_per_rvu"] == pytest.approx(32.87 / 1.3)
    assert got["summary", "ALL"]["benchmark_delta"] == pytest.approx(172.87 / 3.35 - 80)


# -- patients -----------------------------------------------------------------------------------------------


def visit(patient, day, **kw):
    return dict(service_date=str(day), patient_id=patient, epid=f"{patient}{day}{kw.get('encounter_id', '')}{kw.get('procedure_code', '')}", **kw)


def test_panel_over_two_months(spark):
    rows = [visit("A", "2026-01-05"), visit("B", "2026-01-12"), visit("A", "2026-02-02"), visit("C", "2026-02-03"), visit("", "2026-02-03"),
            visit("D", "never")]
    charges = charge_frame(spark, rows)
    weekly = patients.patient_metrics_weekly(charges.filter("patient_id <> ''"))
    months = {r["month"].month: r for r in patients.patient_metrics_monthly(weekly).collect()}
    assert months[1]["panel_eom"] == 2 and months[2]["panel_eom"] == 3 and sum(m["new_patients"] for m in months.values()) == 3
    assert patients.total_patients(patients.patient_days(charges)).first()[0] == 3
    assert patients.total_patients_approx(patients.patient_days(charges)).first()[0] == 3


def test_new_patients_and_campaign(spark):
    days = patients.patient_days(charge_frame(spark, [visit("old", "2025-01-05"), visit("old", "2026-01-05"), visit("a", "2025-12-01"),
                                                      visit("b", "2026-01-05"), visit("c", "2026-01-06")]),
                                 charge_frame(spark, [visit("d", "2026-01-12"), visit("a", "2026-01-12")]))
    weekly = patients.new_patients_weekly(days, CFG)
    got = [(r["new_patients"], r["ma4"], r["cumulative"]) for r in weekly.orderBy("week").collect()]
    assert got == [(1, 1.0, 1), (2, 1.5, 3), (1, 4 / 3, 4)]
    row = patients.campaign_comparison(weekly, CFG).first()
    assert (row["pre_weeks"], row["post_weeks"], row["pre_avg"], row["post_avg"], row["percent_change"]) == (1, 2, 1.0, 1.5, 50.0)


def test_revenue_drivers_need_three_months(spark):
    def monthly(n):
        return spark.createDataFrame(
            [(date(2025 + i // 12, 1 + i % 12, 1), 4, 10 * i, i % 3, Decimal(160 * i + 7)) for i in range(n)],
            "month date, weeks_in_month int, panel_eom int, new_patients int, revenue_model decimal(18,2)")

    assert patients.revenue_drivers(monthly(2)).isEmpty() and patients.revenue_drivers(monthly(6)).isEmpty()
    got = by(patients.revenue_drivers(monthly(12)), "driver")
    assert got["panel"]["slope"] == pytest.approx(16) and got["panel"]["intercept"] == pytest.approx(7) and got["panel"]["n"] == 8
    assert got["panel"]["p_value"] == pytest.approx(0, abs=1e-9) and 0 < got["new_patients"]["p_value"] <= 1


def test_growth(spark):
    start = date(2026, 1, 2)
    charges = charge_frame(spark, [visit(f"p{i}", start + timedelta(days=7 * i)) for i in range(15)])
    weekly = patients.growth_weeks(charges, CFG)
    assert weekly.count() == 15
    trend = patients.growth_trend(weekly).first()
    assert trend["slope"] == 0 and trend["residual_std"] == 0 and trend["longest_weak_run"] == 15 and trend["sustained_drop"]
    skipped = patients.growth_weeks(charges, replace(CFG, outlier_weeks=(start,)))
    assert skipped.count() == 14 and patients.growth_weeks(charges, replace(CFG, outlier_weeks=(start,)), False).count() == 15


def test_provider_visits(spark):
    charges = charge_frame(spark, [
        visit("a", "2026-01-05", encounter_id="e1", procedure_code="99213", provider_raw=" p1 ", charge_amount="100", pri_adjustment="10"),
        visit("a", "2026-01-05", encounter_id="e1", procedure_code="36415", provider_raw="P1", charge_amount="50", pri_adjustment="20"),
        visit("b", "2026-01-06", encounter_id="e2", procedure_code="99203", provider_raw="P1"),
        visit("c", "2026-01-07", encounter_id="e3", procedure_code="G0438", provider_raw="P1"),
        visit("a", "2026-01-07", encounter_id="e4", procedure_code="G0438", provider_raw="P1"),
        visit("d", "2026-01-07", encounter_id="e5", procedure_code="36415", provider_raw="P1"),
        visit("d", "2026-01-14", encounter_id="e6", procedure_code="36415", provider_raw="P2", charge_amount="5")])
    rows = {(r["provider"], r["week"]): r for r in patients.provider_visits_weekly(charges).collect()}
    p1 = rows["P1", date(2026, 1, 9)]
    assert (p1["total_visits"], p1["new_patients"], p1["recurring_patients"]) == (4, 2, 2)
    assert (p1["total_charges"], float(p1["total_allowed"])) == (150, 120.0)
    assert rows["P2", date(2026, 1, 16)]["total_visits"] == 0
    totals = by(patients.provider_visit_totals(charges))
    assert (totals["P1"]["encounters"], totals["P1"]["visits"], totals["P1"]["unique_patients"]) == (5, 4, 4)


# -- exams and money ----------------------------------------------------------------------------------------


def test_exam_volume(spark):
    day = date(2025, 1, 6)
    va = exam_frame(spark, [
        dict(case_id="1", patient_id="a", provider_raw="P4", service_date=day), dict(case_id="2", patient_id="b", provider_raw="p4, NP", service_date=day, no_show="1"),
        dict(case_id="3", patient_id="c", provider_raw="P3", service_date=day), dict(case_id="4", patient_id="d", provider_raw="P2", service_date=day),
        dict(case_id="5", patient_id="a", provider_raw="P4", service_date=day), dict(case_id="6", patient_id="e", provider_raw="P4", service_date=date(2024, 12, 2))])
    weekly = exams.exam_volume_weekly(va, CFG)
    row = weekly.first()
    assert weekly.count() == 1 and (row["appts_a"], row["appts_b"], row["combined_appts"], row["all_appts"]) == (2, 1, 3, 4)
    assert (row["no_shows_a"], row["combined_no_shows"], row["others"]) == (1, 1, 1)
    assert exams.exam_volume_stats(weekly, CFG).first()["total_combined_appts"] == 3
    assert exams.exam_volume_weekly(va, replace(CFG, exam_cap=1)).first()["combined_appts"] == 2
    assert exams.exam_volume_stats(exams.exam_volume_weekly(va.limit(0), CFG), CFG).first()["n_weeks"] == 0


def test_half_month_revenue(spark):
    va = exam_frame(spark, [dict(service_date=date(2026, 1, 5), genmed="16+"), dict(service_date=date(2026, 1, 15), tbi="1"),
                            dict(service_date=date(2026, 1, 2), opinions="1-3"), dict(service_date=date(2026, 1, 16), opinions="1-3")])
    got = by(exams.half_month_revenue(va), "half_month")
    assert {k: int(r["exam_revenue"]) for k, r in got.items()} == {"2026-01-H1": 1100, "2026-01-H2": 150}


def test_receivables(spark):
    cfg = replace(CFG, as_of=date(2026, 2, 28))
    days = [date(2026, 1, 24), date(2026, 1, 25), date(2026, 2, 8), date(2026, 2, 9), date(2026, 2, 28), date(2026, 3, 1)]
    va = exam_frame(spark, [dict(service_date=d, tbi="1") for d in days])
    got = by(revenue.receivables(va, cfg), "block")
    assert {k: int(r["expected_revenue"]) for k, r in got.items()} == {"total": 1000, "block 1": 500, "block 2": 250, "block 3": 500}
    assert got["block 1"]["after"] == date(2026, 1, 24)


def test_weekly_revenue(spark):
    weeks = [date(2025, 10, 6) + timedelta(days=7 * i) for i in range(12)]
    charges = charge_frame(spark, [visit("a", w, charge_amount="100", pat_payment="40") for w in weeks])
    va = exam_frame(spark, [dict(service_date=weeks[0], tbi="1")])
    extra = spark.createDataFrame([(date(2024, 1, 2), Decimal("455"))], "pay_date date, amount decimal(18,2)")
    weekly = revenue.weekly_revenue(charges, va, CFG, extra)
    rows = weekly.orderBy("week").collect()
    assert len(rows) == 13 and rows[0]["va_revenue"] == 455 and rows[0]["cost"] == 9569
    assert [float(r["pc_revenue"]) for r in rows[1:]] == [40, 40] + [33] * 10
    assert rows[1]["total_revenue"] == 290 and rows[1]["profit"] == 290 - 13063
    assert rows[1]["va_revenue_ma8"] == (455 + 250) / 2
    summary = revenue.weekly_revenue_summary(weekly).first()
    assert summary["weeks"] == 13 and float(summary["sum_pc_revenue"]) == 410


def test_crossover(spark):
    months = [date(2026, m, 1) for m in range(1, 6)]
    a = spark.createDataFrame([(m, 10.0) for m in months], "month date, v double")
    b = spark.createDataFrame([(m, 4.0 * i) for i, m in enumerate(months)], "month date, v double")
    assert revenue.crossover_month(a, b, "month", "v").first()[0] is None
    faster = b.withColumn("v", F.col("v") * 2)
    assert revenue.crossover_month(a, faster, "month", "v").first()[0] == date(2026, 4, 1)


# -- forecast -----------------------------------------------------------------------------------------------


def history(spark, n, shape):
    start = date(2025, 1, 6)
    return charge_frame(spark, [visit("a", start + timedelta(days=7 * i), charge_amount=f"{shape(i):.2f}") for i in range(n)])


def test_forecast_needs_eight_weeks(spark):
    for n, series in ((4, 0), (7, 0), (8, 1), (20, 1)):
        weeks = forecast.charge_weeks(history(spark, n, lambda i: 100), CFG)
        assert forecast.fit(weeks).count() == series
    assert forecast.charge_weeks(history(spark, 3, lambda i: 1).limit(0), CFG).isEmpty()


def test_forecast_continues_a_clean_season(spark):
    fitted = forecast.fit(forecast.charge_weeks(history(spark, 24, lambda i: 1000 + 100 * (i % 4)), CFG))
    ahead = forecast.forecast(fitted).orderBy("step").collect()
    assert len(ahead) == 26 and ahead[0]["week"] == date(2025, 1, 6) + timedelta(days=7 * 24)
    assert [r["forecast"] for r in ahead] == pytest.approx([1000 + 100 * (i % 4) for i in range(24, 50)], abs=1e-6)
    stats = forecast.forecast_stats(fitted, forecast.forecast(fitted)).first()
    assert stats["avg_hist"] == pytest.approx(1150) and abs(stats["growth_pct"]) < 1


def test_fit_beats_every_other_grid_point():
    import numpy as np

    rng = np.random.default_rng(1)
    values = 50 + rng.normal(0, 5, 60) + np.tile([0, 5, 10, 5], 15)
    longer = np.concatenate([values, values[:7]])
    best = forecast.fit_block([values[:31], longer, values, values[:9]])[2]
    assert best == forecast.fit_block([values])[0]

    def sse(alpha, beta, gamma, phi):
        level = sum(values[:4]) / 4
        trend, season, total = (sum(values[4:8]) / 4 - level) / 4, list(values[:4] - level), 0.0
        for v in values:
            s = season.pop(0)
            before = level
            total += (v - before - phi * trend - s) ** 2
            season.append(gamma * (v - before - phi * trend) + (1 - gamma) * s)
            level = alpha * (v - s) + (1 - alpha) * (before + phi * trend)
            trend = beta * (level - before) + (1 - beta) * phi * trend
        return total

    every = [sse(a, b, g, p) for a in forecast.ALPHAS for b in forecast.BETAS for g in forecast.GAMMAS for p in forecast.PHIS]
    assert best[-1] == pytest.approx(min(every)) and sse(*best[:4]) == pytest.approx(min(every))


# -- quality and schedule -----------------------------------------------------------------------------------


def test_charge_quality(spark):
    rows = [dict(service_date="2026-01-05", provider_raw="P1", charge_amount="1", procedure_code="99213", encounter_id="eid_1",
                 patient_id="pid_1", epid=str(i)) for i in range(4)]
    rows.append(dict(service_date="2023-12-31", provider_raw="Nobody", charge_amount="1", procedure_code="x", encounter_id="1234567", patient_id="12345", epid="3"))
    got = by(quality.charge_checks(charge_frame(spark, rows).drop("week"), CFG.alias_table(spark), replace(CFG, min_charge_rows=4)), "check_name")
    failed = {name for name, r in got.items() if not r["passed"]}
    assert failed == {"dates before start", "patient_id hashed", "patient_id raw numbers", "encounter_id hashed", "encounter_id raw numbers",
                      "line id duplicates", "composite duplicates", "unknown provider names"}
    assert got["composite duplicates"]["measured"] == 3 and got["patient_id hashed"]["measured"] == pytest.approx(0.8)


def test_header_checks(spark):
    header = ["Provider", "Old Name ", "Unnamed: 3", "TBI", "TBI"]
    got = by(quality.header_checks("exams", spark.range(1), header, quality.REQUIRED_EXAMS, ("Provider", "Old Name ")), "check_name")
    assert {k: r["measured"] for k, r in got.items()} == {
        "missing columns": 5, "duplicate columns": 1, "artifact columns": 1, "conflicting provider columns": 1}


def test_checks_of_an_empty_table(spark):
    empty = charge_frame(spark, [dict(epid="x")]).filter("epid = 'none'")
    got = by(quality.charge_checks(empty, CFG.alias_table(spark), CFG), "check_name")
    assert not got["row count"]["passed"] and not got["date span days"]["passed"] and got["exact duplicates"]["measured"] == 0


def test_active_providers(spark):
    plan = spark.createDataFrame([("P1", 0, True), ("P1", 1, True), ("P2", 0, False)], "provider string, day_of_week int, is_active boolean")
    cfg = replace(CFG, display_names=(("P1", "First, NP"),))
    assert [tuple(r) for r in scheduling.active_providers(plan, cfg).collect()] == [("P1", "First, NP")]


def test_friday_helper():
    assert friday(date(2026, 1, 3)) == date(2026, 1, 9) and len(S.CHARGE_HEADERS) == 16
