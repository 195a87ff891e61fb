"""What syncs leave on disk, and that judging a batch in slices gives the same rows."""

from __future__ import annotations

from datetime import date, timedelta
from glob import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row

from visitledger.config import PracticeConfig
from visitledger.operators import dedup, merge
from visitledger.plans import sync
from visitledger.plans.weekly_store import WeeklyStore
from visitledger.session import shared_dir
from visitledger.sources import keyed
from visitledger.sources import schemas as S

KEY = b"0123456789abcdef"
FALLBACK = ("day", "code")


def raw_lines(spark, numbers, code="99213"):
    rows = [{name: None for name in S.CHARGE_HEADERS} | {
        "Date Of Service": f"{i % 12 + 1}/3/1999", "Rendering Provider": "A", "Service Charge Amount": "10", "Procedure Code": code,
        "Encounter ID": f"e{i // 3}", "Patient ID": f"p{i // 5}", "Encounter Procedure ID": f"{i}-1"} for i in numbers]
    return spark.createDataFrame([Row(**r) for r in rows], S.RAW_CHARGES)


def scratch(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return {path for label in ("sync-stage", "sync-new") for path in glob(f"{root}/{label}-*")}


def _pulled(spark, root, **options):
    """Two pulls, the second overlapping the first; the scratch folders that are left."""
    before = scratch(spark)
    for pull in (raw_lines(spark, range(40)), raw_lines(spark, range(60))):
        result = sync.sync_charges(spark, pull, f"{root}/charges", f"{root}/audit", PracticeConfig(as_of=date(2001, 8, 15)), KEY, **options)
        assert result.status == "success", result.error_message
    return scratch(spark) - before


def test_sync_leaves_no_scratch_folders(spark, tmp_path):
    assert not _pulled(spark, tmp_path)
    files = glob(f"{tmp_path}/charges/*/*.parquet")
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_shuffle_files_go_with_their_job(spark):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def _batch(spark, rows):
    schema = "id string, day date, code string, amount int"
    path = shared_dir(spark, "batch")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _at(i):
    return date(1999, 1, 1) + timedelta(days=11 * (i % 40))


@pytest.mark.parametrize("with_keyless", [False, True])
def test_slices_add_the_same_rows(spark, tmp_path, monkeypatch, with_keyless):
    old = [(f"k{i % 150}", _at(i), f"c{i % 7}", i) for i in range(200)]
    new = [(f" k{i % 260} ", _at(i) if i % 9 else None, f"c{i % 7}" if i % 5 else None, i % 90 if i % 4 else None) for i in range(100, 700)]
    if with_keyless:
        new += [(None, _at(i), f"c{i % 7}", i) for i in range(20)] + [(" ", _at(3), "c3", 1)] * 2
    old, new = _batch(spark, old), _batch(spark, new)
    expected = merge.additions(dedup.keep_first(old, ["id"]), new, "id", FALLBACK).collect()
    monkeypatch.setattr(keyed, "SLICE_ROWS", 10, raising=False)
    table = str(tmp_path / "t")
    keyed.append_new(spark, table, old, "id", FALLBACK, day="day")
    assert spark.read.parquet(table).count() == 150
    added = []
    n = keyed.append_new(spark, table, new, "id", FALLBACK, day="day", before=added.append)
    assert n == len(expected) and sorted(map(str, added[0].collect())) == sorted(map(str, expected))
    assert spark.read.parquet(table).count() == 150 + n
    again = keyed.append_new(spark, table, new, "id", FALLBACK, day="day")
    assert again == 0 and spark.read.parquet(table).count() == 150 + n


def test_windowed_sync_leaves_no_scratch_folders(spark, tmp_path):
    assert not _pulled(spark, tmp_path, window=(date(1999, 1, 1), date(1999, 6, 30)))
    assert spark.read.parquet(f"{tmp_path}/charges").count() + spark.read.parquet(f"{tmp_path}/charges-rejected").count() == 60


def test_sync_with_weekly_store_leaves_no_scratch_folders(spark, tmp_path):
    cfg = PracticeConfig(as_of=date(2001, 8, 15))
    store = WeeklyStore(f"{tmp_path}/weekly", f"{tmp_path}/charges", f"{tmp_path}/exams", cfg)
    assert not _pulled(spark, tmp_path, weekly=store)
    assert spark.read.parquet(f"{tmp_path}/weekly").count() == 12
