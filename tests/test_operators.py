from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from visitledger.operators import dedup, merge, series, slots, topk

LINES = "epid string, service_date date, amount decimal(18,2), note string"


def lines(spark, rows):
    return spark.createDataFrame(rows, LINES)


def batch(start, n, note="n"):
    return [(f"epid_{i:04d}", date(2026, 1, 1) + timedelta(days=i % 40), None, note) for i in range(start, start + n)]


def test_keep_first_is_deterministic(spark):
    rows = [("a", date(2026, 1, 2), None, "x"), ("a", date(2026, 1, 1), None, "z"), ("a ", date(2026, 1, 1), None, "y"),
            (None, None, None, "p"), (None, None, None, "p"), ("  ", None, None, "q"), ("b", None, None, None)]
    expected = sorted([("a", "z"), ("None", "p"), ("  ", "q"), ("b", "None")])
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = dedup.keep_first(lines(spark, rows).repartition(3), ["epid"])
        assert sorted((str(r["epid"]), str(r["note"])) for r in got.collect()) == expected
        assert got.columns == ["epid", "service_date", "amount", "note"]


def test_keep_first_follows_the_given_order(spark):
    rows = [("a", date(2026, 1, 1), None, "late"), ("a", date(2026, 1, 2), None, "early")]
    got = dedup.keep_first(lines(spark, rows), ["epid"], order_by=["note"])
    assert [r["note"] for r in got.collect()] == ["early"]


def test_keep_first_collapses_a_hot_key_before_the_shuffle(spark):
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("epid"), F.col("id").alias("v"))
    kept = dedup.keep_first(hot.repartition(8), ["epid"])
    assert kept.count() == 20_001
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[1]


def test_merge_of_an_overlapping_pull(spark):
    existing, pulled = lines(spark, batch(0, 100)), lines(spark, batch(0, 105, "pulled"))
    merged = merge.merge_by_key(existing, pulled, "epid")
    assert merged.count() == 105 and merged.filter("is_new").count() == 5
    assert merged.select("epid").distinct().count() == 105
    assert merged.filter("not is_new and note = 'pulled'").count() == 0
    fresh = merge.additions(existing, pulled, "epid", ("service_date", "note"))
    assert fresh.count() == 5
    again = merge.additions(existing.unionByName(fresh), pulled, "epid", ("service_date", "note"))
    assert again.count() == 0


def test_merge_repairs_duplicates_and_takes_new_columns(spark):
    existing = lines(spark, [("e1", None, None, "a"), ("e1", None, None, "a")]).drop("amount")
    merged = merge.merge_by_key(existing, lines(spark, [("e1", None, None, "b"), ("eX", None, None, "c")]), "epid")
    assert sorted((r["epid"], r["is_new"]) for r in merged.collect()) == [("e1", False), ("eX", True)]


def test_merge_by_columns_when_one_side_has_no_keys(spark):
    day = date(2026, 1, 5)
    existing = spark.createDataFrame([("", day, "100.0", "x")], "epid string, service_date date, amount string, note string")
    existing = existing.withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    new = lines(spark, [("k1", day, None, "x"), ("k2", day, None, "y"), ("k2", day, None, "z")]).withColumn(
        "amount", F.lit("100.00").cast("decimal(18,2)"))
    got = merge.additions(existing, new, "epid", ("service_date", "amount", "note"))
    assert [(r["epid"], r["note"]) for r in got.collect()] == [("k2", "y")]
    first_load = merge.additions(existing.limit(0), new, "epid", ("service_date", "amount", "note"))
    assert sorted(r["epid"] for r in first_load.collect()) == ["k1", "k2"]


def test_keyless_new_rows_are_compared_as_rows(spark):
    existing = lines(spark, [("a", None, None, "x"), (None, None, None, "held")])
    new = lines(spark, [(None, None, None, "held"), (None, None, None, "fresh"), (" ", None, None, "fresh"), ("a", None, None, "other")])
    got = sorted((str(r["epid"]), r["note"]) for r in merge.rows_to_append(existing, new, "epid").collect())
    assert got == [(" ", "fresh"), ("None", "fresh")]


def test_drafts_without_key_stay(spark):
    confirmed = lines(spark, [("e1", None, None, "c"), ("e2", None, None, "c"), (None, None, None, "c")])
    drafts = lines(spark, [("e1", None, None, "d"), ("eX", None, None, "d"), (None, None, None, "d"), ("", None, None, "d")])
    got = sorted(str(r["epid"]) for r in merge.not_confirmed(drafts, confirmed, "epid").collect())
    assert got == ["", "None", "eX"]
    assert merge.overlap_count(drafts, confirmed, "epid").first()["overlap"] == 1


def weeks(spark, values, start=date(2026, 1, 2)):
    return spark.createDataFrame([(start + timedelta(days=7 * i), float(v)) for i, v in enumerate(values)], "week date, v double")


def test_window_columns(spark):
    frame = weeks(spark, [0, 0, 5, 10, 2])
    got = frame.select(
        "week", series.rolling_mean(F.col("v"), "week", 4).alias("mean"), series.running_sum(F.col("v"), "week").alias("sum"),
        series.change_pct(F.col("v"), "week").alias("change"), series.recency("week").alias("age"),
        series.position("week").alias("pos")).orderBy("week").collect()
    assert [r["mean"] for r in got] == [0, 0, 5 / 3, 3.75, 4.25]
    assert [r["sum"] for r in got] == [0, 0, 5, 15, 17]
    assert [r["change"] for r in got] == [0, 0, 200, 100, -80]
    assert [r["age"] for r in got] == [5, 4, 3, 2, 1] and [r["pos"] for r in got] == [0, 1, 2, 3, 4]


def test_forward_fill_and_calendar(spark):
    frame = spark.createDataFrame([(1, None), (2, 7), (3, None)], "k int, v int")
    assert [r[0] for r in frame.select(series.forward_fill(F.col("v"), "k").alias("f")).collect()] == [None, 7, 7]
    sparse = weeks(spark, [1, 2, 3]).filter("v <> 2")
    assert [(r["v"]) for r in series.weekly_calendar(sparse, "week", "v").orderBy("week").collect()] == [1, 0, 3]


def test_grid_counts_weeks_of_unlisted_providers(spark):
    frame = spark.createDataFrame([("A", date(2026, 1, 2), 3.0), ("X", date(2026, 1, 9), 9.0)], "provider string, week date, rvu double")
    got = sorted((r["week"].day, r["provider"], r["rvu"], r["week_count"]) for r in series.provider_week_grid(frame, ("A", "B"), "rvu").collect())
    assert got == [(2, "A", 3, 2), (2, "B", 0, 2), (9, "A", 0, 2), (9, "B", 0, 2)]


def test_longest_run(spark):
    frame = weeks(spark, [9, 1, 1, 9, 1, 1, 1, 1, 9])
    assert series.longest_run(frame, "week", F.col("v") < 5).first()["longest_run"] == 4
    assert series.longest_run(frame, "week", F.col("v") < 0).first()["longest_run"] == 0


def two_sided_p(t, freedom, steps=20_000):
    """Simpson integral of the t density over [-t, t], the complement of the p-value."""
    scale = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi)

    def density(x):
        return scale * (1 + x * x / freedom) ** (-(freedom + 1) / 2)

    width = t / steps
    total = density(0) + density(t) + sum((4 if i % 2 else 2) * density(i * width) for i in range(1, steps))
    return 1 - 2 * total * width / 3


@pytest.mark.parametrize("n, t", [(3, 1.0), (4, 2.0), (5, 3.0), (6, 0.1), (12, 2.0), (13, 2.0), (40, 0.5), (81, 4.0)])
def test_regression_p_value(spark, n, t):
    r2 = t * t / (t * t + n - 2)
    got = spark.range(1).select(series.regression_p_value(F.lit(r2), F.lit(n).cast("long"))).first()[0]
    assert got == pytest.approx(two_sided_p(t, n - 2), abs=1e-9)


SCHEDULE = ("provider string, day_of_week int, start_hour int, start_minute int, end_hour int, end_minute int, slot_minutes int,"
            " break_start_hour int, break_end_hour int, is_active boolean")


def slots_for(spark, busy, schedule=("P1", 0, 8, None, 17, 0, 30, None, None, True), day=date(2026, 1, 5)):
    plan = spark.createDataFrame([schedule], SCHEDULE)
    days = spark.createDataFrame([(day,)], "day date")
    taken = spark.createDataFrame(
        [(schedule[0], *b) for b in busy], "provider string, start_at timestamp_ntz, end_at timestamp_ntz, status string")
    return sorted((r["start_at"], r["end_at"], r["label"]) for r in slots.free_slots(plan, days, taken).collect())


def test_slots(spark):
    nine, half = datetime(2026, 1, 5, 9), timedelta(minutes=30)
    whole = slots_for(spark, [])
    assert len(whole) == 18 and whole[0] == (datetime(2026, 1, 5, 8), datetime(2026, 1, 5, 8, 30), "8:00 AM")
    assert len(slots_for(spark, [(nine, nine + half, "Confirmed")])) == 17
    assert len(slots_for(spark, [(nine, nine + half, "Cancelled"), (nine, nine + half, "No Show")])) == 18
    assert slots_for(spark, [], day=date(2026, 1, 6)) == []
    assert slots_for(spark, [], schedule=("P1", 0, 8, 0, 17, 0, 30, None, None, False)) == []
    assert len(slots_for(spark, [], schedule=("P1", 0, 8, 0, 17, 0, 30, 12, 13, True))) == 16
    assert len(slots_for(spark, [(nine, nine, "Confirmed")])) == 18
    assert len(slots_for(spark, [(nine + timedelta(minutes=10),) * 2 + ("Confirmed",)])) == 17


def test_slots_match_interval_comparison(spark):
    rng = random.Random(3)
    opening, minutes = datetime(2026, 1, 5, 8, 15), 25
    busy = []
    for _ in range(12):
        begin = opening + timedelta(seconds=rng.randrange(-7200, 36000))
        busy.append((begin, begin + timedelta(seconds=rng.randrange(0, 5400)), rng.choice(["Confirmed", "No Show", ""])))
    busy.append((datetime(2026, 1, 4, 22), datetime(2026, 1, 5, 9, 1), "Confirmed"))
    got = slots_for(spark, busy, schedule=("P1", 0, 8, 15, 17, 10, minutes, 12, 13, True))
    blocks = [(a, b) for a, b, s in busy if s != "No Show"] + [(datetime(2026, 1, 5, 12), datetime(2026, 1, 5, 13))]
    expected, at = [], opening
    while at + timedelta(minutes=minutes) <= datetime(2026, 1, 5, 17, 10):
        end = at + timedelta(minutes=minutes)
        if not any(at < b and end > a for a, b in blocks):
            expected.append((at, end))
        at = end
    assert [(a, b) for a, b, _ in got] == expected


def test_top_k(spark):
    frame = spark.range(100).select("id", (F.col("id") % 10).alias("v"))
    assert [r["id"] for r in topk.newest(frame, "v", 3, "id").collect()] == [99, 89, 79]
    assert [r["id"] for r in topk.largest(frame, "v", 2, "id").collect()] == [9, 19]
