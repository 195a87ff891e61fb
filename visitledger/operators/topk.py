"""Newest-first and largest-first lists whose length is part of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, at: str, k: int, tie: str) -> DataFrame:
    """The k newest rows; planned as a distributed top-k, not a full sort."""
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(k)


def largest(df: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(value).desc(), F.col(tie).asc()).limit(k)
