"""Registry of runnable queries with their SQL cross-check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitledger.session import configure

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    name: str
    run: Run
    sql: str | None
    covers: str


CHECKS: dict[str, Check] = {}


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report output types: decimals as cents in a double, doubles rounded, everything else as is."""
    def shown(name: str, dtype: str):
        if dtype.startswith("decimal"):
            return F.col(f"`{name}`").cast("decimal(28,2)").cast("double").alias(name)
        if dtype == "double":
            return F.round(F.col(f"`{name}`"), digits).alias(name)
        return F.col(f"`{name}`")

    return df.select(*[shown(name, dtype) for name, dtype in df.dtypes])


def check(name: str, covers: str, sql: str | None = None, digits: int = 6):
    """Register a query function; `covers` lists the inventory ids it exercises."""
    def wrap(run: Run) -> Run:
        def configured(spark: SparkSession, sf: str) -> DataFrame:
            return plain(run(configure(spark), sf), digits)

        if name in CHECKS:
            raise ValueError(f"duplicate query {name}")
        CHECKS[name] = Check(name, configured, sql, covers)
        return configured

    return wrap
