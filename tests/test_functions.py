from __future__ import annotations

import hashlib
import hmac
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from helpers import CFG, column
from pyspark.sql import functions as F

from visitledger.functions import dates, money, pii, rules
from visitledger.functions.sql import register_functions


def test_money_text(spark):
    texts = ["$1,234.56", "100", "invalid", None, "nan", "1.5d", "12.", ".5", "1e3", " -3.20 ", "", "$ 7"]
    expected = ["1234.56", "100", "0", "0", "0", "0", "12", "0.5", "1000", "-3.20", "0", "7"]
    assert column(spark, texts, money.clean_money) == [Decimal(v).quantize(Decimal("0.01")) for v in expected]


def test_money_losing_cents(spark):
    assert column(spark, ["1.234", "1.23", "x", None], money.loses_cents) == [True, False, False, False]


def test_dates(spark):
    texts = ["1/5/2026", "01/05/2026", "2025-11-05", "2023-01-15T00:00:00", "13/45/2026", "soon", None, "1/5/26", "1/5/2026 10:30"]
    expected = [date(2026, 1, 5), date(2026, 1, 5), date(2025, 11, 5), date(2023, 1, 15), None, None, None,
                date(2026, 1, 5), date(2026, 1, 5)]
    assert column(spark, texts, dates.parse_date) == expected
    assert column(spark, [date(2023, 1, 15)], dates.us_date_text, "date") == ["1/15/2023"]


def test_week_end_is_the_friday_on_or_after(spark):
    days = [date(2026, 1, 1) + timedelta(days=i) for i in range(400)]
    got = column(spark, days, dates.week_end, "date")
    assert got == [d + timedelta(days=(4 - d.weekday()) % 7) for d in days]
    assert got[0] == date(2026, 1, 2) and got[4] == date(2026, 1, 9)


def test_quarters_and_halves(spark):
    days = [date(2026, 1, 15), date(2026, 1, 16), date(2025, 12, 31)]
    assert column(spark, days, dates.half_month_key, "date") == ["2026-01-H1", "2026-01-H2", "2025-12-H2"]
    assert column(spark, days, dates.quarter_label, "date") == ["Q1 2026", "Q1 2026", "Q4 2025"]
    assert dates.quarter_bounds(date(2025, 12, 31)) == (date(2025, 10, 1), date(2026, 1, 1))
    assert dates.quarter_bounds(date(2026, 5, 1)) == (date(2026, 4, 1), date(2026, 7, 1))
    assert column(spark, [datetime(2026, 1, 5, 9, 0)], dates.slot_label, "timestamp") == ["9:00 AM"]


def test_clinic_time_follows_daylight_saving(spark):
    got = column(spark, [datetime(2026, 1, 5, 14), datetime(2026, 7, 6, 14)], dates.clinic_local, "timestamp")
    assert got == [datetime(2026, 1, 5, 9), datetime(2026, 7, 6, 10)]


def test_payout_tiers(spark):
    points = [688, 689, 690, 735, 736, 827, 828, 900]
    got = column(spark, points, lambda c: money.tier_payout(c, CFG.tiers), "int")
    assert got == [0, 0, 25, 1150, 1180, 3910, 3945, 6465]


@pytest.mark.parametrize("exam, fee", [
    (dict(genmed="1-5", opinions="1-3"), 330), (dict(no_show="1"), 60), (dict(no_show="1.0"), 60),
    (dict(tbi="1", focused="6-10"), 530), (dict(genmed="16+"), 700), (dict(focused="lab", genmed="BP check"), 0),
    (dict(tbi="R-TBI"), 250), (dict(focused="99"), 0), (dict(opinions="19+"), 600), (dict(opinions="nan"), 0),
])
def test_exam_fee(spark, exam, fee):
    columns = [F.lit(exam.get(name)).cast("string") for name in ("focused", "opinions", "tbi", "genmed", "no_show")]
    assert spark.range(1).select(rules.exam_fee(*columns)).first()[0] == fee


def test_exam_points(spark):
    rows = [("0", "1"), ("0", "1.0"), ("0", "0"), (None, None), ("0.0", "0"), ("1-3", ""), ("2", ""), ("4-6", "0"), ("x", "0")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, opinions string, no_show string")
    got = frame.orderBy("i").select(
        rules.exam_rvu(F.col("opinions"), F.col("no_show")), rules.exam_category(F.col("opinions"), F.col("no_show"))).collect()
    assert [float(r[0]) for r in got] == [.75, .75, 2.5, 2.5, 2.5, 4.5, 4.5, 6.5, 6.5]
    assert [r[1] for r in got][:3] == ["No Show", "No Show", "VA Exam (0 IMOs)"]


CLINICAL = [
    ("Functional Initial visit", "10", None, 3.75, "Func Med Initial"), ("functional", "10", None, 2.5, "Func Med Subsequent"),
    ("Nexus", "10", None, 2.5, "Nexus Letter"), ("99213", "200.00", None, 2.5, "Nexus Letter"),
    ("99213", "200.01", None, 1.3, "Primary Care Visit"), ("DOT exam", "1", None, 1.0, "DOT Physical"),
    ("PHYSICAL", "1", "the dot form", 1.0, "DOT Physical"), ("PHYSICAL", "1", "other", 1.3, "Primary Care Visit"),
    ("99396 25", "1", None, 1.3, "Primary Care Visit"), ("Annual", "1", None, 1.3, "Primary Care Visit"),
    ("90471", "1", None, 0.5, "Vaccine Only"), ("vaccine", "1", None, 0.5, "Vaccine Only"), ("admin fee", "1", None, 0.5, "Vaccine Only"),
    ("36415", "1", None, 0.0, "Other/Unclassified"), (None, None, None, 0.0, "Other/Unclassified"), ("99206", "1", None, 0.0, "Other/Unclassified"),
]


def test_clinical_rules_in_order(spark):
    frame = spark.createDataFrame(
        [(i, code, Decimal(charge) if charge else None, note) for i, (code, charge, note, _, _) in enumerate(CLINICAL)],
        "i int, code_text string, charge_amount decimal(18,2), provider_raw string")
    got = rules.with_clinical_rvu(frame, "code_text", "charge_amount", ("provider_raw", "code_text"), CFG).orderBy("i").collect()
    assert [(float(r["rvu"]), r["category"]) for r in got] == [(rvu, category) for *_, rvu, category in CLINICAL]
    assert got[0].asDict().keys() == {"i", "code_text", "charge_amount", "provider_raw", "rvu", "category"}


def test_provider_names(spark):
    names = spark.createDataFrame([("P1last, P1first",), ("p2LAST, np  ",), ("p3",), ("Someone Else ",), (None,)], "raw string")
    got = rules.with_canonical_provider(names, "raw", CFG.alias_table(spark)).collect()
    assert sorted(str(r["provider"]) for r in got) == ["None", "P1", "P2", "P3", "SOMEONE ELSE"]


def test_thresholds_and_costs(spark):
    weeks = [date(2026, 4, 17), date(2026, 4, 24)]
    assert column(spark, weeks, lambda c: rules.threshold(c, "company_breakeven", CFG), "date") == [196, 146]
    assert column(spark, weeks, lambda c: rules.threshold(c, "provider_target", CFG), "date") == [82, 93]
    costs = column(spark, [date(2025, 8, 1), date(2026, 3, 6), date(2027, 1, 1)], lambda c: rules.weekly_cost(c, CFG), "date")
    assert [int(c) for c in costs] == [13752, 13063, 9569]


def test_small_text_functions(spark):
    got = spark.range(1).select(
        rules.codes_with_modifiers(F.lit("99213"), F.lit("25"), F.lit(" "), F.lit(None).cast("string"), F.lit("GT")).alias("code"),
        rules.markup_only(F.lit("<a><b>name</b> x </a>")).alias("markup"),
        rules.booking_status(F.lit("7")).alias("booked"), rules.booking_status(F.lit(None).cast("string")).alias("pending"),
        rules.display_name(F.lit("P ONE")).alias("shown"), rules.name_matches(F.lit(None).cast("string"), "x").alias("no_name"),
        money.ratio_or_zero(F.lit(5), F.lit(0)).alias("ratio")).first()
    assert tuple(got) == ("99213 25 GT", "<a><b></b></a>", "booked", "pending", "P One", False, 0.0)


KEY = b"test-key"


def _expected(text, prefix):
    return prefix + hmac.new(KEY, text.encode(), hashlib.sha256).hexdigest()[:32]


def test_hash_matches_hmac_and_is_idempotent(spark):
    frame = spark.createDataFrame([("1234567",), (" 42 ",), (None,), ("pid_done",), ("ünïcode",)], "id string")
    expected = [_expected("1234567", "pid_"), _expected("42", "pid_"), None, "pid_done", _expected("ünïcode", "pid_")]
    arrow = pii.hash_columns(frame, {"id": "pid_", "absent": "x_"}, KEY)
    assert [r["id"] for r in arrow.collect()] == expected
    assert [r["id"] for r in pii.hash_columns(arrow, {"id": "pid_"}, KEY).collect()] == expected
    assert [r["id"] for r in pii.hash_columns_builtin(frame, {"id": "pid_"}, KEY).collect()] == expected


def test_hash_with_a_long_key(spark):
    key = b"k" * 80
    frame = spark.createDataFrame([("7",)], "id string")
    expected = "pid_" + hmac.new(key, b"7", hashlib.sha256).hexdigest()[:32]
    assert pii.hash_columns_builtin(frame, {"id": "pid_"}, key).first()["id"] == expected


def test_hash_refuses_empty_ids_and_a_missing_key(spark, monkeypatch):
    frame = spark.createDataFrame([(" ",)], "id string")
    with pytest.raises(Exception, match="empty identifier"):
        pii.hash_columns(frame, {"id": "pid_"}, KEY).collect()
    monkeypatch.delenv(pii.KEY_VARIABLE, raising=False)
    with pytest.raises(RuntimeError):
        pii.hash_columns(frame, {"id": "pid_"})


def test_key_does_not_show_in_the_plan(spark):
    frame = spark.createDataFrame([("7",)], "id string")
    plan = pii.hash_columns(frame, {"id": "pid_"}, b"very-secret")._jdf.queryExecution().toString()
    assert "very-secret" not in plan


def test_sql_functions(spark):
    assert register_functions(spark, CFG) == ["week_end", "clean_money", "rvu_value", "rvu_category", "exam_fee", "tier_payout"]
    got = spark.sql("""SELECT week_end(DATE '2026-01-05') w, clean_money('$1,234.56') m, rvu_value('99213', 10, '') v,
        rvu_category('DOT', 10, '') c, exam_fee('6-10', '0', '1', NULL, '0') f, tier_payout(736D) p""").first()
    assert tuple(got) == (date(2026, 1, 9), Decimal("1234.56"), Decimal("1.30"), "DOT Physical", Decimal("530.00"), 1180.0)


def test_dates_split_methods_and_odd_forms(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    texts = ["13/40/2020", "0/1/2020", "1/1/0000", "Jan 1, 0000", "2/30/2020", "1/2/2020\n", "20200102\n", "2020/1/2\n", "2/29/72", "1/5/69", "1/5/68",
             "Sept. 5,  2021 10:00", "5-SEPT-2021", "05 may., 2021", "December 31 1999", "2020/13/1", "1/2-2020", "1-2-2020 x", "15.1.20"]
    want = [None] * 8 + [date(1972, 2, 29), date(1969, 1, 5), date(2068, 1, 5), date(2021, 9, 5), date(2021, 9, 5), date(2021, 5, 5), date(1999, 12, 31),
                         None, None, date(2020, 1, 2), date(2020, 1, 15)]
    assert column(spark, texts, dates.parse_date) == want
