"""Exact copies removed without shuffling all rows whole; a draft sync leaves no scratch folder."""

from __future__ import annotations

from datetime import date
from glob import glob

import pytest
from test_sync_at_size import KEY, raw_lines, scratch

from visitledger.config import PracticeConfig
from visitledger.operators import dedup
from visitledger.plans import sync


@pytest.mark.parametrize("most", [0, 1, 1 << 17])
def test_distinct_rows(spark, most):
    rows = [("a", None, 1), (None, "a", 1), ("a", None, 1), (None, None, None), (None, None, None), ("b", "c", 2)]
    df = spark.createDataFrame(rows, "x string, y string, z int")
    assert sorted(map(str, dedup.distinct_rows(df, most).collect())) == sorted(map(str, df.dropDuplicates().collect()))
    unique = df.where("x = 'b'")
    assert dedup.distinct_rows(unique, most).collect() == unique.collect()


def test_draft_sync_leaves_no_scratch_folders(spark, tmp_path):
    before, cfg, root = scratch(spark), PracticeConfig(as_of=date(2001, 8, 15)), str(tmp_path)
    for _ in range(2):
        drafts = sync.sync_drafts(spark, raw_lines(spark, [1, 1, 2, 3, 3]), f"{root}/drafts", f"{root}/audit", cfg, KEY)
        assert (drafts.status, drafts.records_new) == ("success", 3), drafts.error_message
    sync.sync_exams(spark, spark.createDataFrame([("1", "A", "1/5/1999")], ["Case ID", "Provider", "Date of Service"]), f"{root}/exams",
                    f"{root}/audit", cfg, KEY)
    assert scratch(spark) == before and glob(f"{root}/exams/*/*.parquet")
