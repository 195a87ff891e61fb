"""Inputs as they really arrive: quoted exports, mixed date forms, blank ids, undated lines, conflicting names."""

from __future__ import annotations

from datetime import date

from helpers import CFG

from visitledger.functions import dates, rules
from visitledger.operators.merge import rows_to_append
from visitledger.plans import patients
from visitledger.sources import files, loaders


def test_quoted_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B\n"x ""y"" z","two\nlines"\n"1,5",\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [('x "y" z', "two\nlines"), ("1,5", None)]


def test_files_with_other_headers_meet_by_name(spark, tmp_path):
    folder = tmp_path / "some folder"
    folder.mkdir()
    (folder / "1.csv").write_text("A,B\n1,2\n")
    (folder / "2.csv").write_text("B,A\n4,3\n")
    (folder / "3.csv").write_text("A,C\n5,6\n")
    (folder / "4.csv").write_text("A,B\n7,8\n")
    got = files.read_csv(spark, str(folder))
    assert got.columns == ["A", "B", "C"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == [
        "('1', '2', None)", "('3', '4', None)", "('5', None, '6')", "('7', '8', None)"]


def test_quoted_sheet_cells(spark, tmp_path):
    header = ",".join(f"h{i}" for i in range(16))
    cells = ['"K ""1"""', "P1", "", "1/5/2026"] + [""] * 12
    (tmp_path / "sheet.csv").write_text(header + "\n" + ",".join(cells) + "\n")
    assert files.read_sheet(spark, str(tmp_path / "sheet.csv")).first()["Case ID"] == 'K "1"'


def test_date_forms(spark):
    texts = ["Jan 15, 2023", "January 15 2023", "sept. 3, 2023", "2023/01/15", "01-15-2023", "1/15/23 10:00", "1/15/99", "1/15/68",
             "Janus 15, 2023", "Marble 3, 2020", "on 1/15/2023", "2023/13/45", "", None]
    day = date(2023, 1, 15)
    expected = [day, day, date(2023, 9, 3), day, day, day, date(1999, 1, 15), date(2068, 1, 15)] + [None] * 6
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["d"] for r in frame.select("i", dates.parse_date(frame.t).alias("d")).orderBy("i").collect()] == expected


def test_blank_and_nan_are_missing(spark):
    raw = spark.createDataFrame(
        [("1/5/2026", " P1 ", " ", "nan", " E1 ", "99213")],
        "`Date Of Service` string, `Rendering Provider` string, `Patient ID` string, `Encounter Procedure ID` string, "
        "`Encounter ID` string, `Procedure Code` string")
    row = loaders.type_charges(raw).first()
    assert (row["provider_raw"], row["patient_id"], row["epid"], row["encounter_id"]) == ("P1", None, None, "E1")


def test_blank_patients_are_not_a_patient(spark):
    raw = spark.createDataFrame(
        [("1/5/2026", "P1", p, e, "99213", f"L{i}") for i, (p, e) in enumerate([("", ""), (" ", ""), ("A", "E1")])],
        "`Date Of Service` string, `Rendering Provider` string, `Patient ID` string, `Encounter ID` string, "
        "`Procedure Code` string, `Encounter Procedure ID` string")
    totals = patients.provider_visit_totals(loaders.load_charges(raw, CFG)).first()
    assert (totals["encounters"], totals["unique_patients"]) == (1, 1)


def test_an_undated_line_takes_nothing_from_its_encounter(spark):
    code = patients.FACE_TIME[0]
    lines = spark.createDataFrame(
        [("P1", "E1", "A", code, None), ("P1", "E1", "B", code, date(2026, 1, 5)), ("P1", "E1", None, code, date(2026, 1, 5)),
         ("P1", "E2", "A", code, None)],
        "provider_raw string, encounter_id string, patient_id string, procedure_code string, service_date date")
    got = {r["encounter_id"]: (r["service_date"], r["patient_id"], r["face_time"]) for r in patients.encounters(lines).collect()}
    assert got == {"E1": (date(2026, 1, 5), "B", True), "E2": (None, "A", True)}


def test_a_name_listed_twice_multiplies_nothing(spark):
    names = spark.createDataFrame([("x",), ("x ",), ("y",)], "raw string")
    aliases = spark.createDataFrame([("X", "P2"), ("X", "P1"), ("Y", "P3")], "alias_norm string, canonical string")
    got = rules.with_canonical_provider(names, "raw", aliases).collect()
    assert sorted(r["provider"] for r in got) == ["P1", "P1", "P3"]
    assert [tuple(r) for r in rules.alias_conflicts(aliases).collect()] == [("X", 2, "P1")]


def test_the_stored_table_is_reduced_by_the_new_keys_first(spark, tmp_path):
    stored = spark.createDataFrame([(k, i) for i, k in enumerate(["a", "b", "b", None])], "k string, v int")
    stored.write.parquet(str(tmp_path / "t"))
    existing = spark.read.parquet(str(tmp_path / "t"))
    new = spark.createDataFrame([("b", 9), ("c", 9), (None, 3), (None, 4)], "k string, v int")
    added = rows_to_append(existing, new, "k", missing_is_null=True)
    assert sorted(map(str, (tuple(r) for r in added.collect()))) == ["('c', 9)", "(None, 4)"]
    plan = added._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "IsNull(k)" in plan
