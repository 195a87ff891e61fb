"""A month-partitioned table read as dated chunks: a Python data source whose partitions are the planned windows of a pull.

The range is cut into consecutive windows of at most `days` days, each a task. Conditions on the day that Spark pushes down
shrink the range before it is cut, and a chunk opens only the folders of its own months. `overlap` lets each chunk begin
that many days before its window, as pulls do that must catch late corrections; what is read twice then goes by the key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual)

from visitledger.operators.dedup import keep_first
from visitledger.sources.tables import CHUNK_DAYS, MONTH

NAME = "date_chunks"
#: Rows of a batch, and bytes of a column that are read at once.
BATCH_ROWS, BUFFER = 1 << 13, 1 << 18


class Chunk(InputPartition):
    def __init__(self, start: date, end: date):
        super().__init__((start, end))
        self.start, self.end = start, end


class DateChunks(DataSource):
    """Options: `path`, `day` (the date column), `start` and `end` (ISO dates, inclusive), `days`, `overlap`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ChunkReader(self.options, schema)


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.day, self.names = options["path"].rstrip("/"), options.get("day", "service_date"), schema.names
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.days, self.overlap = int(options.get("days", CHUNK_DAYS)), int(options.get("overlap", 0))
        if self.days < 1 or self.overlap < 0:
            raise ValueError("a chunk has at least one day, an overlap none or more")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrow the range by comparisons of the day with a date; all others are Spark's."""
        one = timedelta(days=1)
        for condition in filters:
            value = getattr(condition, "value", None)
            if getattr(condition, "attribute", None) != (self.day,) or type(value) is not date:
                yield condition
            elif isinstance(condition, GreaterThanOrEqual):
                self.start = max(self.start, value)
            elif isinstance(condition, GreaterThan):
                self.start = max(self.start, value + one)
            elif isinstance(condition, LessThanOrEqual):
                self.end = min(self.end, value)
            elif isinstance(condition, LessThan):
                self.end = min(self.end, value - one)
            elif isinstance(condition, EqualTo):
                self.start, self.end = max(self.start, value), min(self.end, value)
            else:
                yield condition

    def partitions(self) -> list[Chunk]:
        chunks, at = [], self.start
        while at <= self.end:
            last = min(at + timedelta(days=self.days - 1), self.end)
            chunks.append(Chunk(max(self.start, at - timedelta(days=self.overlap)), last))
            at = last + timedelta(days=1)
        return chunks

    def read(self, chunk: Chunk | None) -> Iterator:
        if chunk is None:  # what Spark makes of an empty range
            return
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        folders = [f"{root}/{MONTH}={month.isoformat()}" for month in months(chunk.start, chunk.end)]
        held = [f.path for f in system.get_file_info(folders) if f.type == fs.FileType.Directory]
        inside = (pc.field(self.day) >= chunk.start) & (pc.field(self.day) <= chunk.end)
        for folder in held:
            rows = ds.dataset(folder, filesystem=system, format="parquet")
            for fragment in rows.get_fragments(filter=inside):
                groups = [g.id for part in fragment.split_by_row_group(filter=inside) for g in part.row_groups]
                yield from self._batches(system, fragment.path, groups, rows.schema, chunk)

    def _batches(self, system, path: str, groups: list[int], schema, chunk: Chunk) -> Iterator:
        """Rows of the chunk in row groups of one file, page by page: a scanner would decode whole row groups, several ahead of those
        that are asked for, in as many threads as there are cores."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if not groups:
            return
        fields = [schema.field(name) for name in self.names]
        with system.open_input_file(path) as source:
            file = pq.ParquetFile(source, buffer_size=BUFFER, pre_buffer=False)
            there = set(file.schema_arrow.names)
            for batch in file.iter_batches(BATCH_ROWS, groups, [f.name for f in fields if f.name in there], use_threads=False):
                columns = [
                    batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in fields]
                batch = pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
                day = batch.column(self.day)
                batch = batch.filter(pc.and_(pc.greater_equal(day, chunk.start), pc.less_equal(day, chunk.end)))
                if batch.num_rows:
                    yield batch


def months(start: date, end: date) -> list[date]:
    """First days of the months that the days from `start` to `end` lie in."""
    out, at = [], start.replace(day=1)
    while at <= end:
        out.append(at)
        at = (at + timedelta(days=32)).replace(day=1)
    return out


def read_chunks(spark: SparkSession, path: str, schema: T.StructType, window: tuple[date, date], key: str | None = None,
                day: str = "service_date", days: int = CHUNK_DAYS, overlap: int = 0) -> DataFrame:
    """Rows of the window from a month-partitioned table, one task for each planned chunk, unique by `key` if given.

    The folder must be one that pyarrow can open on the executors (a shared folder or an object store).
    """
    spark.dataSource.register(DateChunks)
    rows = (
        spark.read.format(NAME).schema(schema)
        .options(path=path, day=day, start=window[0].isoformat(), end=window[1].isoformat(), days=str(days), overlap=str(overlap)).load())
    return rows if key is None else keep_first(rows, [key])
