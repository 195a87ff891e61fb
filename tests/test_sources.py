from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from helpers import CFG
from pyspark.sql import functions as F

from visitledger.sources import files, loaders, tables
from visitledger.sources import schemas as S


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_repeated_headers_keep_the_first(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'A,"B, x",A\n1,2,3\n4,,6\n')
    frame = files.read_csv(spark, path)
    assert frame.columns == ["A", "B, x"]
    assert [tuple(r) for r in frame.collect()] == [("1", "2"), ("4", None)]


def test_a_missing_table_is_empty(spark, tmp_path):
    frame = files.read_named(spark, str(tmp_path), "nothing.csv", S.RAW_BANK)
    assert frame.columns == list(S.BANK_HEADERS) and frame.isEmpty()


def test_minimal_charges(spark, tmp_path):
    path = write(tmp_path / "c.csv", "Date Of Service,Service Charge Amount,Pri Ins Insurance Payment,Pat Payment Amount\n"
                                     '1/5/2026,"$1,150.00",100.50,$20.00\nbad,5,,\n')
    rows = {r["service_date"]: r for r in loaders.load_charges(files.read_csv(spark, path), CFG).collect()}
    paid = rows[date(2026, 1, 5)]
    assert paid["total_payments"] == Decimal("120.50") and paid["charge_amount"] == Decimal("1150.00")
    assert paid["week"] == date(2026, 1, 9) and paid["total_adjustments"] == 0 and paid["code_text"] == ""
    assert rows[None]["week"] is None and rows[None]["allowed"] == Decimal("1.643500")


def test_allowed_and_model_revenue(spark):
    header = ["Service Charge Amount", "Pri Ins Insurance Contract Adjustment", "Other Adjustment", "Encounter Procedure ID"]
    raw = spark.createDataFrame([("100", "0", "50", "a"), ("100", "30", "0", "b"), ("0", "0", "0", "c")], S.all_strings(header))
    got = {r["epid"]: (float(r["allowed"]), float(r["revenue_model"])) for r in loaders.load_charges(raw, CFG).collect()}
    assert got == {"a": (32.87, 29.583), "b": (70.0, 63.0), "c": (0.0, 0.0)}


def test_rows_without_line_id_survive(spark):
    header = ["Date Of Service", "Encounter Procedure ID", "Patient ID"]
    raw = spark.createDataFrame(
        [("1/5/2026", "", "x"), ("1/6/2026", None, "y"), ("1/6/2026", None, "y"), ("1/7/2026", "k", "z"), ("1/8/2026", " k", "z")],
        S.all_strings(header))
    got = sorted((str(r["service_date"]), r["patient_id"]) for r in loaders.load_charges(raw, CFG).collect())
    assert got == [("2026-01-05", "x"), ("2026-01-06", "y"), ("2026-01-07", "z")]


def test_drafts_are_cleaned(spark):
    raw = spark.createDataFrame([("1/5/2026", "$1,000.00")], S.all_strings(["Date Of Service", "Service Charge Amount"]))
    row = loaders.load_drafts(raw, CFG).first()
    assert row["charge_amount"] == 1000 and row["charge_status"] == "draft"


def test_exam_headers_and_bands(spark, tmp_path):
    path = write(tmp_path / "e.csv", "Case ID,Provider,Old Name ,Date of Service,Focused DBQs,Routine IMOs,TBI,Gen Med DBQs,No Show\n"
                 "c1,P4,,2025-11-05,0,1-3,0,1-5,\nc2,,P3,11/6/2025,,,,,1.0\nc3,P4,,never,0,0,0,0,0\n")
    raw = files.read_csv(spark, path)
    cfg = CFG.__class__(legacy_provider_headers=("Old Name ",))
    got = {r["case_id"]: r for r in loaders.load_exams(raw, cfg).collect()}
    assert set(got) == {"c1", "c2"}
    assert (got["c1"]["provider_raw"], got["c1"]["exam_revenue"]) == ("P4", 330)
    assert (got["c2"]["provider_raw"], got["c2"]["exam_revenue"], got["c2"]["is_no_show"]) == ("P3", 60, True)


def test_bank(spark, tmp_path):
    path = write(tmp_path / "b.csv", 'Date,Amount,Running Bal.\n1/5/2026,-12.50,"36,739.45"\n')
    row = loaders.load_bank(files.read_csv(spark, path)).first()
    assert tuple(row) == (date(2026, 1, 5), Decimal("-12.50"), Decimal("36739.45"))


def test_sheet_by_position(spark, tmp_path):
    path = write(tmp_path / "s.csv", ",".join(f"h{i}" for i in range(16)) + "\n"
                 "k1,P4,x,1/5/2026,0,1-3,0,6-10,,,,,,,,1\n  ,P4,x,1/5/2026,0,0,0,0\nk2,P3,x,1/6/2026\n")
    got = {r["Case ID"]: r for r in files.read_sheet(spark, path).collect()}
    assert set(got) == {"k1", "k2"}
    assert got["k1"]["No Show"] == "1" and got["k1"]["Gen Med DBQs"] == "6-10" and got["k2"]["No Show"] == ""


ENVELOPE = """<?xml version="1.0" encoding="utf-8"?>
<s:Envelope xmlns:s="http://schemas.xmlsoap.org/soap/envelope/"><s:Body><GetChargesResponse xmlns="urn:billing">
<GetChargesResult><ErrorResponse><IsError>{error}</IsError><ErrorMessage>{message}</ErrorMessage></ErrorResponse>
<SecurityResponse><Authenticated>{login}</Authenticated></SecurityResponse><Charges>{charges}</Charges>
</GetChargesResult></GetChargesResponse></s:Body></s:Envelope>"""
CHARGE = """<ChargeData><EncounterProcedureID>{id}</EncounterProcedureID><ServiceStartDate>2026-01-05T00:00:00</ServiceStartDate>
<RenderingProviderName>P1</RenderingProviderName><TotalCharges>150.00</TotalCharges><ProcedureCode>99213</ProcedureCode>
<ProcedureModifier1>25</ProcedureModifier1><ProcedureModifier2> </ProcedureModifier2><PatientID>77</PatientID></ChargeData>"""


def test_charge_xml_files(spark, tmp_path):
    def envelope(ids, error="false", login="true", message=""):
        return ENVELOPE.format(error=error, login=login, message=message, charges="\n".join(CHARGE.format(id=i) for i in ids))

    write(tmp_path / "good.xml", envelope(["a", "b"]))
    write(tmp_path / "error.xml", envelope(["c"], error="True", message="limit"))
    write(tmp_path / "login.xml", envelope(["d"], login="false"))
    rows = files.read_charge_xml(spark, str(tmp_path)).collect()
    assert sorted(r["Encounter Procedure ID"] for r in rows) == ["a", "b"]
    first = rows[0].asDict()
    assert list(first) == list(S.CHARGE_HEADERS)
    assert first["Date Of Service"] == "1/5/2026" and first["Procedure Codes with Modifiers"] == "99213 25"
    assert first["Encounter ID"] == "" and first["Patient ID"] == "77"
    rejects = {r["file"].rsplit("/", 1)[-1]: (r["reason"], r["message"]) for r in files.read_xml_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {"error.xml": ("IsError", "limit"), "login.xml": ("Authenticated", None)}


def test_appointment_and_reason_xml(spark, tmp_path):
    body = """<r><AppointmentData><StartDate>2026-07-06T13:00:00Z</StartDate><EndDate>2026-07-06T13:30:00+00:00</EndDate>
    <ConfirmationStatus>Confirmed</ConfirmationStatus></AppointmentData>
    <AppointmentData><StartDate>2026-07-06T09:00:00</StartDate><EndDate>2026-07-06T09:30:00</EndDate></AppointmentData>
    <AppointmentData><StartDate>later</StartDate><EndDate>2026-07-06T09:30:00</EndDate></AppointmentData></r>"""
    write(tmp_path / "a.xml", body)
    got = sorted((r["start_at"], r["end_at"], r["status"]) for r in files.read_appointment_xml(spark, str(tmp_path / "a.xml")).collect())
    span = (datetime(2026, 7, 6, 9), datetime(2026, 7, 6, 9, 30))
    assert got == [(*span, ""), (*span, "Confirmed")]
    write(tmp_path / "r.xml", "<r><AppointmentReasonData><ID>1</ID><Name>Visit</Name><Duration>x</Duration></AppointmentReasonData>"
                              "<AppointmentReasonData><ID> </ID><Name>none</Name></AppointmentReasonData>"
                              "<AppointmentReasonData><ID>2</ID><Name>Long</Name><Duration>60</Duration></AppointmentReasonData></r>")
    got = sorted(tuple(r) for r in files.read_reason_xml(spark, str(tmp_path / "r.xml")).collect())
    assert got == [("1", "Visit", 30), ("2", "Long", 60)]


def test_reviews(spark, tmp_path):
    reviews = [{"rating": 5, "text": " good ", "time": 2, "author_name": "a"}, {"rating": 4, "text": "x", "time": 3},
               {"rating": 5, "text": "  ", "time": 4}, {"rating": 5, "text": "old", "time": 1, "author_name": "b"}]
    write(tmp_path / "ok.json", json.dumps({"status": "OK", "result": {"reviews": reviews}}))
    write(tmp_path / "no.json", json.dumps({"status": "DENIED", "result": {"reviews": reviews}}))
    got = files.five_star(files.read_reviews(spark, str(tmp_path))).orderBy(F.col("time").desc()).collect()
    assert [(r["author_name"], r["text"]) for r in got] == [("a", "good"), ("b", "old")]


def test_month_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([("a", date(2026, 1, 5)), ("b", date(2026, 2, 5))], "k string, service_date date")
    tables.append_months(frame, path)
    tables.overwrite_months(spark.createDataFrame([("c", date(2026, 2, 6))], frame.schema), path)
    stored = tables.read_table(spark, path)
    assert sorted(r["k"] for r in stored.collect()) == ["a", "c"]
    pruned = tables.in_range(stored, (date(2026, 2, 1), date(2026, 2, 28)))
    assert "PartitionFilters: [isnotnull(service_month" in pruned._jdf.queryExecution().toString()
    assert [r["k"] for r in pruned.collect()] == ["c"]
    assert tables.read_table(spark, str(tmp_path / "none"), frame.schema).isEmpty()
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "none"))


def test_sync_range_and_chunks(spark):
    today = date(2026, 2, 15)
    assert tables.sync_range(today, date(2026, 2, 5))[0] == date(2025, 10, 18)
    assert tables.sync_range(today, date(2025, 1, 1)) == (date(2025, 1, 1), date(2026, 2, 14))
    first = tables.sync_range(today, None)
    assert (today - first[0]).days == 1280
    chunks = tables.date_chunks(spark.createDataFrame([first], "a date, b date"), "a", "b").orderBy("chunk_start").collect()
    assert len(chunks) == 24 and chunks[0]["chunk_start"] == first[0] and chunks[-1]["chunk_end"] == first[1]
    assert all((c["chunk_end"] - c["chunk_start"]).days <= 54 for c in chunks)
    assert all((b["chunk_start"] - a["chunk_end"]).days == 1 for a, b in zip(chunks, chunks[1:]))
