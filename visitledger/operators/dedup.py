"""Deterministic keep-first de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """True for a key that is neither null nor blank."""
    return F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def keep_first(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (), blank_keys_are_rows: bool = True
) -> DataFrame:
    """One row per key: the smallest by `order_by`, ties broken by all remaining columns.

    A row whose key is blank is compared on all its columns instead, so rows without a key are never
    folded into one another. `row_number = 1` is planned with a group limit on both sides of the shuffle:
    copies of a hot key leave each input partition as a single row.
    """
    types = dict(df.dtypes)
    rest = [name for name in df.columns if name not in order_by]
    grouping = [F.trim(F.col(name)) if types[name] == "string" else F.col(name) for name in keys]
    if blank_keys_are_rows:
        keyed = F.lit(True)
        for name in keys:
            keyed = keyed & present(F.col(name))
        grouping.append(F.when(~keyed, F.struct(*rest)))
    ordered = Window.partitionBy(*grouping).orderBy(*order_by, *rest)
    return df.withColumn("_n", F.row_number().over(ordered)).filter("_n = 1").drop("_n")


def distinct_rows(df: DataFrame, most: int = 1 << 17) -> DataFrame:
    """`df.dropDuplicates()` of a stored table: only rows that may have a copy are shuffled whole. Hashes that repeat are counted
    first; up to `most` of them go to all tasks, with more all rows are shuffled."""
    columns = df.columns
    marked = df.withColumn("_print", F.xxhash64(*columns))
    repeats = marked.groupBy("_print").count().where("count > 1").select("_print").limit(most + 1).collect()
    if not repeats:
        return df
    if len(repeats) > most:
        return df.dropDuplicates()
    few = F.broadcast(df.sparkSession.createDataFrame(repeats, "_print long"))
    copies = marked.join(few, "_print", "left_semi").select(*columns).dropDuplicates()
    return marked.join(few, "_print", "left_anti").select(*columns).unionByName(copies)


def duplicates_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows repeat an earlier key (blank keys excluded)."""
    keyed = df
    for name in keys:
        keyed = keyed.filter(present(F.col(name)))
    return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )
