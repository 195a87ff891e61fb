"""Date forms and their election, hashing without Python, one-scan quality checks, published snapshots, stored sketches."""

from __future__ import annotations

import hashlib
import hmac
from datetime import date

import pytest
from helpers import CFG, charge_frame, column
from pyspark.sql import functions as F

from visitledger.functions import dates, pii
from visitledger.plans import patients, quality
from visitledger.sources import shared_tables as V
from visitledger.sources import snapshots

DAY = date(2023, 1, 15)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_day_first_and_compact_forms(spark):
    texts = ["15 Jan 2023", "15-Jan-2023", "15 January, 2023", "20230115", "1.15.2023", "15.1.2023", "15/01/2023", "15-01-2023", "15/1/23 9:00",
             "20231301", "12345678", "15 Janus 2023", "15.1-2023", "1.15.2023.4"]
    assert column(spark, texts, dates.parse_date) == [DAY] * 9 + [None] * 5


def test_the_elected_order_decides_where_both_fit(spark):
    texts = ["3/4/2023", "3.4.2023", "3-4-23", "13/4/2023", "4/13/2023", "2023-04-03", "Mar 4, 2023"]
    first = column(spark, texts, lambda t: dates.parse_date(t, F.lit(True)))
    usual = column(spark, texts, lambda t: dates.parse_date(t, F.lit(False)))
    assert first == [date(2023, 4, 3)] * 3 + [date(2023, 4, 13)] * 2 + [date(2023, 4, 3), date(2023, 3, 4)]
    assert usual == [date(2023, 3, 4)] * 3 + [date(2023, 4, 13)] * 2 + [date(2023, 4, 3), date(2023, 3, 4)]
    assert usual == column(spark, texts, dates.parse_date)


def test_votes_of_a_file(spark):
    rows = [("a", "13/1/2023"), ("a", "2/3/2023"), ("b", "1/13/2023"), ("b", "2/3/2023"), (None, "2/3/2023"), (None, "31.1.2023"), ("c", "soon"), ("c", None)]
    frame = spark.createDataFrame(rows, "file string, t string")
    assert {r["file"]: r["day_first"] for r in dates.day_first_by(frame, "t", ["file"]).collect()} == {"a": True, "b": False, None: True, "c": False}
    read = dates.with_elected_dates(frame, "t", ["file"], "d")
    assert {(r["file"], r["d"]) for r in read.where("t = '2/3/2023'").collect()} == {
        ("a", date(2023, 3, 2)), ("b", date(2023, 2, 3)), (None, date(2023, 3, 2))}
    assert [r["t"] for r in dates.unreadable_dates(read, "t", "d").collect()] == ["soon"]
    assert dates.with_elected_dates(frame.where("file = 'a'"), "t").count() == 2


def test_hashing_is_hidden_and_needs_no_python(spark):
    frame = spark.createDataFrame([("77",), (None,), (" 8 ",), ("pid_x",)], "id string")
    hashed = pii.hash_columns(frame, {"id": "pid_"}, b"very-secret")
    want = ["pid_" + hmac.new(b"very-secret", i, hashlib.sha256).hexdigest()[:32] for i in (b"77", b"8")]
    assert [r["id"] for r in hashed.collect()] == [want[0], None, want[1], "pid_x"]
    text = plan(hashed) + hashed._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    inner, outer = pii._pads(b"very-secret")
    for shown in (b"very-secret", inner, outer):
        assert shown.hex() not in text.lower() and repr(shown)[2:-1] not in text and str(list(shown))[1:-1] not in text
    assert "Python" not in text and "Arrow" not in text


def test_quality_reads_the_lines_twice_at_most(spark, sf_dir):
    checks = quality.charge_checks(V.lines(spark, sf_dir), V.aliases(spark, sf_dir), V.CONFIG)
    executed = checks._jdf.queryExecution().sparkPlan().toString()
    assert executed.count("lineitem.parquet") <= 2


def test_null_cells_are_not_confused_in_duplicate_counts(spark):
    rows = [dict(epid="1", procedure_code="a", patient_id=None), dict(epid="1", procedure_code="a", patient_id=None),
            dict(epid="2", procedure_code=None, patient_id="a"), dict(epid=" ", procedure_code="a"), dict(epid=None, procedure_code="a")]
    got = {r["check_name"]: r["measured"] for r in quality.charge_checks(charge_frame(spark, rows), CFG.alias_table(spark), CFG).collect()}
    assert got["exact duplicates"] == 2 and got["line id duplicates"] == 1 and got["composite duplicates"] == 0


def test_landing_checks(spark):
    raw = spark.createDataFrame([("$1.005", "1/5/2026"), ("x", "soon"), ("", " "), (None, None), ("2.10", "20260105")], "amount string, day string")
    got = {r["check_name"]: (r["measured"], r["passed"]) for r in quality.landing_checks("t", raw, ["amount"], "day").collect()}
    assert got == {"amount unreadable": (1.0, False), "amount below cents": (1.0, False), "day unreadable": (1.0, False)}


def test_snapshots_are_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.read(spark, path, spark.range(1).schema).isEmpty()
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.replace(spark.range(3), path) == 1
    with pytest.raises(Exception, match="lost"):
        snapshots.replace(spark.range(9).withColumn("id", F.raise_error(F.lit("lost")).cast("long")), path)
    assert snapshots.read(spark, path).count() == 3
    begun = snapshots.read(spark, path)
    staged = snapshots.stage(spark.range(5), path)
    assert snapshots.read(spark, path).count() == 3
    assert snapshots.publish(spark, path, staged) == 2
    assert snapshots.read(spark, path).count() == 5 and begun.count() == 3
    snapshots.replace(spark.range(7), path)
    assert len(snapshots.prune(spark, path)) >= 1 and snapshots.read(spark, path).count() == 7
    assert sorted(r["rows"] for r in snapshots.versions(spark, path).collect()) == [3, 5, 7]


def test_sketches_merge(spark):
    rows = spark.range(6000).select(
        F.concat(F.lit("p"), (F.col("id") % 2500).cast("string")).alias("patient_id"),
        F.when(F.col("id") < 3000, F.lit(date(2025, 1, 3))).otherwise(F.lit(date(2025, 2, 3))).alias("service_date"), F.lit("P1").alias("provider_raw"))
    stored = patients.patient_sketches(rows.unionByName(spark.createDataFrame(
        [(None, DAY, "P1"), ("p", None, "P1")], "patient_id string, service_date date, provider_raw string")))
    assert stored.count() == 2
    got = patients.patients_from_sketches(stored).first()["estimated_patients"]
    assert abs(got - 2500) < 125
