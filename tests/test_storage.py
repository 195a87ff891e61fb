"""Quoted exports as many tasks, chunked reads, the key index, keyed appends and the maintained weekly table."""

from __future__ import annotations

import csv
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from helpers import CFG
from pyspark.sql import functions as F
from test_sync_and_streams import KEY, raw_charges

from visitledger.operators import key_index, merge
from visitledger.plans import sync
from visitledger.plans.revenue import weekly_revenue
from visitledger.plans.weekly_store import WeeklyStore
from visitledger.sources import csv_blocks, date_chunks, files, keyed, loaders, tables
from visitledger.sources import schemas as S


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- quoted exports -----------------------------------------------------------------------------------------------------

CELLS = ["1", "x,y", 'q"q', "l1\nl2", "", '"', "\n\n\n", "\r\n", " padded ", "é" * 40]


@pytest.mark.parametrize("seed, end, header", [(1, "\n", ["a", "b", "c"]), (2, "\r\n", ["a", "b", "c"]), (3, "\n", ["a", 'b "x"\ny', "c"])])
def test_exports_are_cut_at_record_ends(spark, tmp_path, small_splits, seed, end, header):
    rng, want = random.Random(seed), []
    for name in ("f0.csv", "f1.csv"):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(header)
            for _ in range(60):
                row = [rng.choice([*CELLS, "é" * 30 + '\n"' * rng.randint(0, 900)]) for _ in header]
                if any(row):
                    writer.writerow(row)
                    want.append(tuple(cell or None for cell in row))
    frame = files.read_csv(spark, str(tmp_path))
    known = csv_blocks.layout(spark, str(tmp_path))
    assert frame.columns == header and len(known.inside) > 3
    assert csv_blocks._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    assert Counter(map(tuple, frame.collect())) == Counter(want)


def test_a_field_longer_than_blocks(spark, tmp_path, small_splits):
    text = "\n".join(str(i) for i in range(2000))
    (tmp_path / "a.csv").write_text(f'x,y\n1,"{text}"\n2,b\n')
    assert Counter(map(tuple, files.read_csv(spark, str(tmp_path)).collect())) == Counter([("1", text), ("2", "b")])


def test_unbalanced_quotes_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"open\n2,b\n')
    with pytest.raises(ValueError, match="unbalanced"):
        files.read_csv(spark, str(tmp_path))


def test_headers_alone_and_mixed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    (tmp_path / "b.csv").write_text("﻿y,z,y\r\n5,6,7\r\n\r\n", encoding="utf-8")
    frame = files.read_csv(spark, str(tmp_path))
    assert frame.columns == ["x", "y", "z"] and [tuple(r) for r in frame.collect()] == [(None, "5", "6")]


# --- chunked reads ------------------------------------------------------------------------------------------------------

DAYS = "epid string, service_date date, amount decimal(18,2)"


def days(spark, first, n):
    rows = [(f"k{i}", first + timedelta(days=i), None) for i in range(n)]
    return spark.createDataFrame(rows, DAYS)


def test_chunks_open_only_their_months(spark, tmp_path):
    path, rows = str(tmp_path / "t"), days(spark, date(2025, 1, 1), 400)
    tables.append_months(rows, path)
    (tmp_path / "t" / "service_month=2025-01-01" / "broken.parquet").write_bytes(b"no parquet")
    window = (date(2025, 2, 10), date(2025, 8, 20))
    got = date_chunks.read_chunks(spark, path, rows.schema, window)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(r["service_date"] for r in got.collect()) == [window[0] + timedelta(days=i) for i in range(192)]
    with pytest.raises(Exception, match="broken"):
        date_chunks.read_chunks(spark, path, rows.schema, (date(2025, 1, 5), window[1])).collect()


def test_pushed_days_leave_chunks_out(spark, tmp_path):
    path, rows = str(tmp_path / "t"), days(spark, date(2025, 1, 1), 400)
    tables.append_months(rows, path)
    whole = date_chunks.read_chunks(spark, path, rows.schema, (date(2025, 1, 1), date(2026, 2, 4)))
    some = whole.where((F.col("service_date") >= F.lit(date(2025, 6, 1))) & (F.col("service_date") < F.lit(date(2025, 6, 11))))
    assert whole.rdd.getNumPartitions() == 8 and some.rdd.getNumPartitions() == 1
    assert some.count() == 10 and whole.where("service_date = DATE'2025-03-01' and epid = 'nothing'").isEmpty()
    assert whole.where("service_date > DATE'2030-01-01'").isEmpty()


def test_overlapping_chunks_are_unique_by_key(spark, tmp_path):
    path, rows = str(tmp_path / "t"), days(spark, date(2025, 1, 1), 200)
    tables.append_months(rows, path)
    window = (date(2025, 1, 1), date(2025, 7, 19))
    twice = date_chunks.read_chunks(spark, path, rows.schema, window, overlap=3)
    assert twice.count() > 200
    assert date_chunks.read_chunks(spark, path, rows.schema, window, "epid", overlap=3).count() == 200


# --- key index ----------------------------------------------------------------------------------------------------------


def test_filters_never_miss_and_rarely_err(spark, tmp_path):
    rows = spark.range(30_000).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("epid"),
        F.when(F.col("id") < 20_000, F.lit(date(2025, 1, 3))).otherwise(F.lit(date(2025, 3, 9))).alias("service_date"))
    path = str(tmp_path / "keys")
    key_index.add(rows, path, "epid")
    index = spark.read.parquet(path)
    assert index.groupBy("service_month").agg(F.max("buckets").alias("b")).orderBy("service_month").collect()[0]["b"] == 16
    for ids, want in (([5], {date(2025, 1, 1)}), ([25_000], {date(2025, 3, 1)}), ([7, 20_001], {date(2025, 1, 1), date(2025, 3, 1)})):
        batch = spark.createDataFrame([(f" k{i}",) for i in ids], "epid string")
        assert set(key_index.months_with(index, batch, "epid")) == want
    inside = spark.range(400).select(F.concat(F.lit("k1"), F.col("id").cast("string"), F.lit("x")).alias("epid"))
    assert key_index.months_with(index, inside, "epid") == []
    assert key_index.months_with(index, spark.createDataFrame([(None,), ("",)], "epid string"), "epid") == []


def batch(spark, keys, day, amount="1.00"):
    rows = [(k, day, None) for k in keys]
    return spark.createDataFrame(rows, DAYS).withColumn("amount", F.lit(amount).cast("decimal(18,2)"))


def test_untouched_months_are_not_opened(spark, tmp_path):
    table = str(tmp_path / "t")
    for month in (1, 2, 3, 4):
        assert keyed.append_new(spark, table, batch(spark, [f"{month}-{i}" for i in range(50)], date(2025, month, 7)), "epid", ("service_date", "amount")) == 50
    pull = batch(spark, ["2-7", "2-999", "new"], date(2025, 4, 20), "2.00")
    part = keyed.candidates(spark, table, pull, "epid")
    scanned = plan(part)
    assert "2025-02-01" in scanned and "2025-04-01" in scanned and "2025-01-01" not in scanned and "2025-03-01" not in scanned
    assert {r["service_month"] for r in part.select("service_month").distinct().collect()} == {date(2025, 2, 1), date(2025, 4, 1)}
    assert keyed.append_new(spark, table, pull, "epid", ("service_date", "amount")) == 2
    assert keyed.append_new(spark, table, pull, "epid", ("service_date", "amount")) == 0


def test_an_index_is_built_for_an_older_table(spark, tmp_path):
    table = str(tmp_path / "t")
    tables.append_months(batch(spark, ["a", "b", None], date(2025, 1, 7)), table)
    assert keyed.append_new(spark, table, batch(spark, ["a", "c"], date(2025, 5, 7)), "epid", ("service_date", "amount")) == 1
    assert spark.read.parquet(keyed.index_path(table)).where("service_month = DATE'2025-01-01'").count() == 1


def test_each_row_is_judged_on_its_own(spark):
    def rows(values):
        return spark.createDataFrame([(k, date(2025, 1, d), None) for k, d in values], DAYS)

    stored = rows([("a", 1), (None, 2), ("b", 3)])
    pull = rows([("a", 9), ("c", 2), ("d", 1), (None, 1), (None, 3), (" ", 7), (None, 7), (None, 7), ("e", 8), ("e", 9)])
    got = Counter((r["epid"], r["service_date"].day) for r in merge.additions(stored, pull, "epid", ("service_date",)).collect())
    # a: key held; c: a keyless row of its day is held; keyless rows of days 1 and 3: any row of the day is held.
    assert got == Counter([("d", 1), (" ", 7), (None, 7), ("e", 8)])
    assert merge.additions(stored.limit(0), pull, "epid", ("service_date",)).count() == 8


# --- maintained weekly table --------------------------------------------------------------------------------------------


def test_a_sync_recomputes_its_weeks_alone(spark, tmp_path):
    store = WeeklyStore(*(str(tmp_path / n) for n in ("weekly", "charges", "exams")), CFG)
    exams = loaders.load_exams(spark.createDataFrame(
        [(f"c{d}", "P4", f"1/{d}/2026", "1-5") for d in range(1, 29)], S.all_strings(["Case ID", "Provider", "Date of Service", "Gen Med DBQs"])), CFG)
    tables.append_months(exams, store.exams)

    def pull(*parts):
        whole = [raw_charges(spark, ids, day) for ids, day in parts]
        for more in whole[1:]:
            whole[0] = whole[0].unionByName(more)
        result = sync.sync_charges(spark, whole[0], store.charges, str(tmp_path / "audit"), CFG, KEY, now=lambda: datetime(2026, 2, 1), weekly=store)
        assert result.status == "success", result.error_message

    def full():
        charges = loaders.derive_charges(spark.read.parquet(store.charges), CFG)
        return sorted(map(tuple, weekly_revenue(charges, spark.read.parquet(store.exams), CFG).collect()))

    store.rebuild(spark)
    pull((range(5), "1/5/2026"), (range(10, 13), "12/22/2025"), (range(30, 32), "1/30/2026"))
    assert sorted(map(tuple, store.read(spark).collect())) == full()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "weekly").rglob("*.parquet")}
    pull((range(6), "1/5/2026"), (range(20, 22), "2/20/2026"))
    assert sorted(map(tuple, store.read(spark).collect())) == full()
    kept = {p for p, at in before.items() if p.exists() and p.stat().st_mtime_ns == at}
    assert {p.parent.name for p in before} - {p.parent.name for p in kept} == {"week_month=2026-01-01"}


def test_noted_weeks_survive_a_lost_run(spark, tmp_path):
    store = WeeklyStore(*(str(tmp_path / n) for n in ("weekly", "charges", "exams")), CFG)
    tables.append_months(loaders.load_exams(spark.createDataFrame(
        [("c1", "P4", "1/5/2026")], S.all_strings(["Case ID", "Provider", "Date of Service"])), CFG), store.exams)
    store.rebuild(spark)
    typed = loaders.type_charges(raw_charges(spark, [1], "1/15/2026"))
    staged = str(tmp_path / "staged")
    typed.write.parquet(staged)
    keyed.append_new(spark, store.charges, spark.read.schema(typed.schema).parquet(staged), "epid", before=store.mark)
    assert store.refresh(spark) == [date(2026, 1, 1)] and store.refresh(spark) == []
    assert {r["week"] for r in store.read(spark).collect()} == {date(2026, 1, 9), date(2026, 1, 16)}


# --- what a task gets ---------------------------------------------------------------------------------------------------


def test_filters_shuffle_each_key_once(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("epid"), F.lit(date(2025, 1, 3)).alias("service_date"))
    assert "Generate" not in plan(key_index.filters(rows, "epid"))


def test_probes_are_fingerprints(spark):
    stored, pull = (spark.createDataFrame([("a", date(2025, 1, 1), None)], DAYS) for _ in range(2))
    text = plan(merge.additions(stored, pull, "epid", ("service_date",)))
    assert "xxhash64(key a" in text and "concat(key" not in text
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 1000


def test_a_large_export_is_written_by_several_tasks(spark, sf_dir, tmp_path, monkeypatch):
    from visitledger.checks import CHECKS, storage

    monkeypatch.setattr(storage, "shared_dir", lambda _, label: str(tmp_path / label))
    sizes = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    for name in sizes:
        spark.conf.set(name, "40000")
    try:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        assert CHECKS["csv_export_lines"].run(spark, sf_dir).count() == lines
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert len(list((tmp_path / "export").glob("*.csv"))) > 1
