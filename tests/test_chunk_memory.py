"""A chunk reader holds pages, not row groups."""

from __future__ import annotations

from datetime import date, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.types import DateType, StringType, StructField, StructType

from visitledger.sources import date_chunks, tables


def test_chunk_reader_holds_pages_not_row_groups(spark, tmp_path):
    n, folder = 300_000, tmp_path / f"{tables.MONTH}=1999-01-01"
    folder.mkdir()
    days = pa.array([date(1999, 1, 1) + timedelta(days=i % 31) if i % 100 else None for i in range(n)], pa.date32())
    whole = pa.table({"service_date": days, "epid": [f"{i}-1" for i in range(n)]} | {f"text{c}": [f"{c}:{i:030d}" for i in range(n)] for c in range(4)})
    pq.write_table(whole, folder / "a.parquet", row_group_size=n)
    pq.write_table(whole.slice(0, 1000).drop(["text3"]), folder / "b.parquet")
    names = ["epid", "text3", "service_date", "text0"]
    schema = StructType([StructField(c, DateType() if c == "service_date" else StringType()) for c in names])
    reader = date_chunks.ChunkReader({"path": str(tmp_path), "start": "1999-01-03", "end": "1999-01-10"}, schema)
    want = sum(d is not None and date(1999, 1, 3) <= d <= date(1999, 1, 10) for d in [*days.to_pylist(), *days.slice(0, 1000).to_pylist()])
    before, most, rows, absent = pa.total_allocated_bytes(), 0, 0, 0
    for batch in reader.read(reader.partitions()[0]):
        most = max(most, pa.total_allocated_bytes() - before)
        rows += batch.num_rows
        absent += batch.column(1).null_count
        assert batch.schema.names == names
    assert rows == want and 0 < absent < 1000
    assert most < whole.nbytes / 3, (most, whole.nbytes)
