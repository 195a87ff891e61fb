from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from helpers import CFG, friday
from pyspark.sql import functions as F

from visitledger.plans import sync
from visitledger.sources import schemas as S
from visitledger.sources import tables
from visitledger.streaming import ingest

KEY = b"sync-test-key"


def raw_charges(spark, ids, day="1/5/2026", epid=True):
    header = ["Date Of Service", "Rendering Provider", "Service Charge Amount", "Procedure Code", "Encounter ID", "Patient ID", "Encounter Procedure ID"]
    rows = [(day, "P1", "$10.00", "99213", f"{i}", "77", f"k{i}" if epid else "") for i in ids]
    return spark.createDataFrame(rows, S.all_strings(header))


def raw_exams(spark, ids):
    return spark.createDataFrame([(f"{i}", "P4", "1/5/2026") for i in ids], S.all_strings(["Case ID", "Provider", "Date of Service"]))


def run(spark, root, ids, today=date(2026, 2, 15), exam_ids=(1, 2)):
    ticks = iter(datetime(2026, 2, today.day) + timedelta(minutes=i) for i in range(100))
    return sync.sync_all(spark, raw_charges(spark, ids), raw_charges(spark, [900]), raw_exams(spark, exam_ids), root, CFG, KEY, today,
                         lambda: next(ticks))


def test_sync_runs(spark, tmp_path):
    root = str(tmp_path)
    first = run(spark, root, range(100))
    assert first["overall_status"] == "success"
    assert (first["charges"].records_fetched, first["charges"].records_new) == (100, 100)
    second = run(spark, root, range(105), date(2026, 2, 16), (1, 2, 3))
    assert (second["charges"].records_fetched, second["charges"].records_new, second["exams"].records_new) == (105, 5, 1)
    assert run(spark, root, range(105), date(2026, 2, 17))["charges"].records_new == 0
    stored = spark.read.parquet(f"{root}/charges")
    assert stored.count() == 105 and stored.select("epid").distinct().count() == 105
    assert stored.filter("not startswith(patient_id, 'pid_') or not startswith(encounter_id, 'eid_')").isEmpty()
    assert spark.read.parquet(f"{root}/exams").filter("not startswith(case_id, 'cid_')").isEmpty()
    assert spark.read.parquet(f"{root}/drafts").count() == 1
    audit = spark.read.parquet(f"{root}/audit")
    assert audit.count() == 18 and tables.overall_status(audit).first()[0] == "success"
    latest = {r["sync_type"]: r["last_sync_date"] for r in tables.latest_success(audit).collect()}
    assert latest["charges"] == date(2026, 2, 17)


def test_only_the_planned_range_is_read(spark, tmp_path):
    old = raw_charges(spark, [1], "1/5/2020").unionByName(raw_charges(spark, [2]))
    result = sync.sync_all(spark, old, raw_charges(spark, []), raw_exams(spark, []), str(tmp_path), CFG, KEY, date(2026, 2, 15))
    assert result["charges"].records_fetched == 1


def test_failure_is_audited(spark, tmp_path):
    root = str(tmp_path)
    bad = raw_charges(spark, [1]).withColumn("Patient ID", F.raise_error(F.lit("source broken")).cast("string"))
    result = sync.sync_charges(spark, bad, f"{root}/charges", f"{root}/audit", CFG, KEY)
    assert result.status == "error" and "source broken" in result.error_message
    audit = spark.read.parquet(f"{root}/audit")
    assert tables.overall_status(audit).first()[0] == "partial_error"
    assert tables.latest_success(audit).isEmpty()


def test_blank_ids_are_not_hashed(spark):
    raw = raw_charges(spark, [1]).withColumn("Patient ID", F.lit(" "))
    assert sync.hashed(raw, sync.CHARGE_IDS, KEY).first()["Patient ID"] is None


def test_uploads_are_hashed_or_refused(spark, tmp_path, monkeypatch):
    path = tmp_path / "c.csv"
    path.write_text("Patient ID,Patient ID,Encounter ID,Note\n12345,x,,a\npid_old,y,9,b\n")
    stored = sync.store_upload(spark, str(path), "charges", str(tmp_path / "charges"), KEY)
    rows = {r["Note"]: r for r in stored.collect()}
    assert rows["a"]["Patient ID"].startswith("pid_") and rows["a"]["Encounter ID"] is None
    assert rows["b"]["Patient ID"] == "pid_old" and rows["b"]["Encounter ID"].startswith("eid_")
    assert sync.store_upload(spark, str(path), "bank", str(tmp_path / "bank")).count() == 2
    monkeypatch.delenv("VISITLEDGER_PII_KEY", raising=False)
    with pytest.raises(RuntimeError):
        sync.store_upload(spark, str(path), "charges", str(tmp_path / "refused"))
    assert not (tmp_path / "refused").exists()


def test_stored_tables_are_hashed_once(spark, tmp_path):
    source, target = str(tmp_path / "raw"), str(tmp_path / "hashed")
    raw_charges(spark, [1, 2]).write.parquet(source)
    assert sync.hash_stored_table(spark, source, target, sync.CHARGE_IDS, KEY)
    assert not sync.hash_stored_table(spark, target, str(tmp_path / "again"), sync.CHARGE_IDS, KEY)
    assert not sync.hash_stored_table(spark, source, str(tmp_path / "again"), {"Other": "x_"}, KEY)
    assert spark.read.parquet(target).filter("not startswith(`Patient ID`, 'pid_')").isEmpty()


LINES = "epid string, ts timestamp, amount double"


def write_batches(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(folder)


def line(key, day, amount=1.0):
    return (key, datetime(2026, 1, 1) + timedelta(days=day), amount)


def test_stream_of_unique_lines(spark, tmp_path):
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_batches(spark, folder, [[line("a", 1), line("b", 2)], [line("a", 1), line("c", 3)], [line("b", 2), line("c", 3)]])
    stream = ingest.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    ingest.drain(ingest.unique_lines(stream, "epid", "ts"), out, state).awaitTermination()
    assert sorted(r["epid"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_stream_merge_is_idempotent(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    write_batches(spark, folder, [[line("a", 1), line("b", 40)], [line("a", 1), line("c", 3)]])
    schema = spark.read.parquet(folder).schema

    def drain(state):
        stream = ingest.file_stream(spark, folder, schema, files_per_batch=1).withColumn("service_date", F.to_date("ts"))
        ingest.merge_into(stream, table, str(tmp_path / state), "epid").awaitTermination()

    drain("s1")
    drain("s2")
    stored = spark.read.parquet(table)
    assert sorted(r["epid"] for r in stored.collect()) == ["a", "b", "c"]
    assert stored.select("service_month").distinct().count() == 2


def test_weekly_stream_equals_batch_for_closed_weeks(spark, tmp_path):
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_batches(spark, folder, [[line(str(i), i, float(i)) for i in range(batch, 40, 3)] for batch in range(3)])
    schema = spark.read.parquet(folder).schema
    stream = ingest.file_stream(spark, folder, schema, files_per_batch=1)
    ingest.drain(ingest.weekly_totals(stream, "ts", "amount", lateness="40 days"), out, state).awaitTermination()
    late = str(tmp_path / "late")
    write_batches(spark, folder, [[line("end", 200)]])
    stream = ingest.file_stream(spark, folder, schema, files_per_batch=1)
    ingest.drain(ingest.weekly_totals(stream, "ts", "amount", lateness="40 days"), out, state).awaitTermination()
    whole = spark.read.parquet(folder)
    batch = {r["week"]: (r["total"], r["rows"]) for r in ingest.batch_weekly_totals(whole, "ts", "amount").collect()}
    got = {r["week"]: (r["total"], r["rows"]) for r in spark.read.parquet(out).collect()}
    last = friday(date(2026, 1, 1) + timedelta(days=200))
    assert got == {week: value for week, value in batch.items() if week != last}
    # A row behind the horizon is dropped by the stream and counted by the batch correction.
    write_batches(spark, folder, [[line("late", 0)]])
    stream = ingest.file_stream(spark, folder, schema, files_per_batch=1)
    ingest.drain(ingest.weekly_totals(stream, "ts", "amount", lateness="40 days"), out, state).awaitTermination()
    assert {r["week"]: (r["total"], r["rows"]) for r in spark.read.parquet(out).collect()} == got
    assert late
