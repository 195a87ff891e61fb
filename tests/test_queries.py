"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry_points
from visitledger.checks import CHECKS

PYTHON_ALLOWED = {"hashed_ids_arrow", "charge_forecast", "charge_forecast_stats", "charge_forecast_top_weeks", "incremental_sync"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_entry_points(spark):
    assert set(entry_points.queries()) >= set(CHECKS)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, duck, sf_dir, name):
    if CHECKS[name].sql is None:
        assert CHECKS[name].run(spark, sf_dir).count() > 0
    else:
        problems, _ = compare(spark, duck, sf_dir, CHECKS[name])
        assert not problems, problems


@pytest.mark.parametrize("name", sorted(n for n in CHECKS if not n.startswith(("stream_", "incremental"))))
def test_plan(spark, sf_dir, name):
    plan = CHECKS[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_ALLOWED:
        assert "EvalPython" not in plan and "InPandas" not in plan


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    plan = CHECKS["provider_weekly_points"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)" in plan
    events = next(line for line in plan.splitlines() if "events.parquet" in line)
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in events
    assert "orders.parquet" not in plan
