"""What the operators share: reading tables, tables kept between stages, bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitledger.session import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write `df` below the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Free the disk of tables written by `kept` that nothing reads any more: what was made of them has been written too."""
    for df in tables:
        for path in {unquote(f.rpartition("/")[0]) for f in df.inputFiles()}:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


def text_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of few rows and, but for single long values, few bytes, so that no task turns a whole
    batch into Python objects at once."""
    for batch in batches:
        lengths = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right"))
            end = min(batch.num_rows, start + rows, max(start + 1, fits))
            yield batch.slice(start, end - start)
            start = end


def fold_case() -> bytes:
    """Byte table that lower-cases A-Z only."""
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
