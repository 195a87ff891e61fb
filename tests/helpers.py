"""Small builders shared by the tests."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from visitledger.config import PracticeConfig

CFG = PracticeConfig(
    as_of=date(2026, 2, 15), aliases=(("P1last, P1first ", "P1"), ("P2last, NP", "P2")), fact_start=date(2025, 10, 1))

FACT = "service_date date, provider string, rvu decimal(8,2), category string, source string, week date"


def one(spark, expression_column):
    return spark.range(1).select(expression_column.alias("v")).first()["v"]


def column(spark, values, function, dtype="string"):
    """Apply a column function to literal values, in order."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["v"] for r in rows.select("i", function(F.col("v")).alias("v")).orderBy("i").collect()]


def friday(day: date) -> date:
    from datetime import timedelta

    return day + timedelta(days=(4 - day.weekday()) % 7)


def fact(spark, rows):
    """`(date, provider, rvu[, source])` -> productivity fact."""
    full = [(d, p, Decimal(str(v)), "Primary Care Visit", (rest[0] if rest else "confirmed"), friday(d)) for d, p, v, *rest in rows]
    return spark.createDataFrame(full, FACT)


def charge_frame(spark, rows):
    """Typed, derived charges from dicts; missing fields take plain defaults."""
    from visitledger.sources import schemas as S
    from visitledger.sources.loaders import derive_charges, type_charges

    back = {typed: header for header, typed in S.CHARGE_HEADERS.items()}
    raw = [tuple(str(row[c]) if row.get(c) is not None else None for c in S.CHARGE_HEADERS.values()) for row in rows]
    schema = S.all_strings([back[c] for c in S.CHARGE_HEADERS.values()])
    return derive_charges(type_charges(spark.createDataFrame(raw, schema)), CFG)
