"""Quoted CSV as many tasks: record boundaries from the quotes of whole blocks.

A line break belongs to a field where the number of quotes before it in the file is odd. Splitting a file at bytes loses that
number, so it is counted first: a scan sums the quotes of each block (a split of a file) and takes each file's first line; the
running sum over the blocks of a file, one number each, tells whether a block begins inside a field. With that known, each task
cuts its own blocks into records. A record that lies across blocks leaves a piece in each; the pieces, at most two a block,
come from a second scan of those blocks and are put together by place.

Files must be quoted by the usual rule: a field that holds a quote is quoted, its quotes doubled. A file with an odd number of
quotes is refused, as no boundary in it can be trusted. Blank records are skipped.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = pa.schema([("file", pa.int64()), ("place", pa.int64()), ("opens", pa.bool_()), ("heads", pa.bool_()), ("record", pa.string())])
PIECE_SQL = "file long, place long, opens boolean, heads boolean, record string"
#: Lines read for a header that itself holds line breaks.
HEADER_LINES = 1000


@dataclass(frozen=True)
class Layout:
    """Files by header line, and the blocks `(file hash, offset)` that begin inside a field or end inside one."""

    headers: dict[str, list[str]]
    inside: frozenset[tuple[int, int]]
    edges: frozenset[tuple[int, int]]


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_path").alias("path"), "value")


def layout(spark: SparkSession, path: str) -> Layout:
    """One scan: quotes of each block and the first line of each file. The driver gets one short row for each split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    first = F.min_by(F.when(F.col("block") == 0, F.col("value")), "at")
    rows = _lines(spark, path).withColumn("at", F.monotonically_increasing_id()).groupBy("path", "file", "block").agg(
        (F.sum(quotes) % 2 == 1).alias("odd"), first.alias("first")).orderBy("path", "block").collect()
    headers: dict[str, list[str]] = {}
    inside, edges, last, is_odd = set(), set(), None, False
    for row in rows:
        block = (row["file"], row["block"])
        if last is None or last[0] != row["file"]:
            _refuse_odd(last and last[1], is_odd)
            headers.setdefault(_header(spark, row["path"], row["first"]), []).append(unquote(row["path"]))
            is_odd = False
        elif is_odd:
            inside.add(block)
            edges |= {block, previous}
        last, previous, is_odd = (row["file"], row["path"]), block, is_odd != row["odd"]
    _refuse_odd(last and last[1], is_odd)
    if len({row["file"] for row in rows}) != len({row["path"] for row in rows}):
        raise ValueError("two files share a hash")
    return Layout(headers, frozenset(inside), frozenset(edges))


def _refuse_odd(path: str | None, is_odd: bool) -> None:
    if is_odd:
        raise ValueError(f"unbalanced quotes in {path}")


def _header(spark: SparkSession, path: str, first: str) -> str:
    """The header record: a file's first line, and further lines while a field is open."""
    lines = [first]
    if first.count('"') % 2:
        lines = [r["value"] for r in spark.read.option("lineSep", "\n").text(unquote(path)).limit(HEADER_LINES).collect()]
    for end in range(1, len(lines) + 1):
        record = "\n".join(lines[:end])
        if record.count('"') % 2 == 0:
            return record.removeprefix("﻿").removesuffix("\r")
    raise ValueError(f"no header ends within {HEADER_LINES} lines of {path}")


class _Block:
    """Cuts the lines of one block, which come in order, into records and its first and last piece."""

    def __init__(self, file: int, block: int, inside: bool):
        self.file, self.block, self.odd = file, block, inside
        self.joins, self.first, self.open = inside, block == 0, []

    def cut(self, lines: pa.StringArray) -> Iterator[tuple[str, pa.Array]]:
        """`("records", strings)` of whole records, `("piece", [text])` for what ends an earlier block's record."""
        closed = (int(self.odd) + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) % 2 == 0
        ends = np.flatnonzero(closed)
        self.odd = not closed[-1]
        start = 0
        if len(ends) and (self.open or self.joins):
            start = int(ends[0]) + 1
            whole = "\n".join([*self.open, *lines[:start].to_pylist()])
            if self.joins:
                yield "piece", pa.array([whole])
            elif not self.first:
                yield "records", pa.array([whole])
            self.joins, self.first, self.open, ends = False, False, [], ends[1:]
        if len(ends):
            stop = int(ends[-1]) + 1
            if stop - start == len(ends):
                records = lines[start:stop]
            else:
                offsets = pa.array(np.append(start, ends + 1), pa.int32())
                records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")
            yield "records", records[1:] if self.first else records
            self.first, start = False, stop
        self.open += lines[start:].to_pylist()

    def piece(self, text: str, opens: bool) -> pa.RecordBatch:
        values = (self.file, 2 * self.block + opens, opens, self.first and opens, text)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, PIECE)], schema=PIECE)


def _cutter(inside: frozenset, pieces: bool):
    """Lines to whole records, or to the pieces at block edges alone."""
    def cut(batches):
        now: _Block | None = None
        for batch in batches:
            file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
            new = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (block[1:] != block[:-1]))) if len(file) else []
            for begin, end in zip(new, [*new[1:], len(file)]):
                key = (int(file[begin]), int(block[begin]))
                if now is None or (now.file, now.block) != key:
                    if pieces and now and now.open:
                        yield now.piece("\n".join(now.open), not now.joins)
                    now = _Block(*key, key in inside)
                for kind, records in now.cut(batch.column("value")[begin:end]):
                    if pieces and kind == "piece":
                        yield now.piece(records[0].as_py(), False)
                    elif not pieces and kind == "records":
                        yield pa.RecordBatch.from_arrays([records], names=["record"])
        if pieces and now and now.open:
            yield now.piece("\n".join(now.open), not now.joins)

    return cut


def records(spark: SparkSession, paths: str | list[str], known: Layout) -> DataFrame:
    """`(record)`: the records of the files, header records left out."""
    lines = _lines(spark, paths).drop("path")
    whole = lines.mapInArrow(_cutter(known.inside, False), "record string")
    if not known.edges:
        return whole
    at_edge = F.xxhash64("file", "block").isin(_pair_hashes(spark, known.edges))
    parts = lines.where(at_edge).mapInArrow(_cutter(known.inside, True), PIECE_SQL)
    numbered = parts.withColumn("n", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("place")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "record"))), lambda p: p["record"])
    joined = numbered.groupBy("file", "n").agg(F.array_join(texts, "\n").alias("record"), F.bool_or("heads").alias("heads"))
    return whole.unionByName(joined.where("not heads").select("record"))


def _pair_hashes(spark: SparkSession, blocks: frozenset) -> list[int]:
    pairs = spark.createDataFrame(sorted(blocks), "file long, block long")
    return [r[0] for r in pairs.select(F.xxhash64("file", "block")).collect()]


def header_names(header: str) -> list[str]:
    return next(csv.reader(header.splitlines(True)))


def read_positions(spark: SparkSession, paths: str | list[str], width: int, known: Layout) -> DataFrame:
    """Files as string columns `_c0`, `_c1`, ... by position; missing cells are null, further ones dropped."""
    ddl = ", ".join(f"_c{i} string" for i in range(width))
    rows = records(spark, paths, known).select(F.rtrim("record", F.lit("\r")).alias("record")).where(F.trim("record") != "")
    return rows.select(F.from_csv("record", ddl, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
