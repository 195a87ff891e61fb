"""Concatenate and cut: texts become one long run of ids, cut into sequences of fixed length.

Pass 1 encodes each row once and keeps its ids with the place inside its block (a scan task); the blocks' totals are then
summed into global offsets. Pass 2 cuts each row's ids at multiples of the window. A row that crosses a boundary leaves one
piece on each side, so only the last sequence has padding.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; the order is the order of
reading; an empty table gives no piece. Further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitledger.llm.common import kept, slices, text_bytes
from visitledger.llm.tokens import ID, default_vocabulary, word_ids

END_ID = 2
ENCODED = pa.schema([
    ("block", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _encoder(path: str, end: int):
    def encode(batches):
        words, block, place = word_ids(path), TaskContext.get().partitionId(), 0
        for part in slices(batches, 4096, 8 << 20):
            ids, ends = words.rows(part.column(1))
            ids = np.insert(ids, ends, ID.type(end))
            ends = ends + np.arange(1, len(ends) + 1)
            sizes = np.diff(ends, prepend=0)
            raw = pa.Array.from_buffers(
                pa.large_binary(), len(ends), [None, pa.py_buffer(2 * np.append(0, ends)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ends), block, np.int32)), pa.array(place + ends - sizes), part.column(0),
                pa.array(sizes, pa.int64()), raw], schema=ENCODED)
            place += int(ends[-1])

    return encode


def _cutter(window: int, with_ids: bool):
    def cut(batches):
        for part in slices(batches):
            rows = []
            for doc, first, n, raw in zip(*(c.to_pylist() for c in part.columns)):
                ids, at = np.frombuffer(raw, ID).astype("<u4"), 0
                while at < n:
                    offset = (first + at) % window
                    length = min(window - offset, n - at)
                    piece = ids[at:at + length].tobytes()
                    rows.append((doc, at, length, zlib.crc32(piece), n, (first + at) // window, offset,
                                 piece if with_ids else None))
                    at += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return cut


def pack(docs: DataFrame, window: int = 4096, end_id: int = END_ID, vocabulary: str | None = None,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """`(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)`, one row for each piece.

    `ids` holds the piece as little-endian unsigned 32-bit integers, null unless `with_ids`.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    encoded = kept(
        rows.mapInArrow(_encoder(vocabulary or default_vocabulary(), end_id),
                        "block int, place long, doc_id long, n long, ids binary"), "packing-ids", "zstd")
    totals = encoded.groupBy("block").agg(F.sum("n").alias("block_n"))
    bases = totals.select("block", F.coalesce(
        F.sum("block_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return encoded.join(bases, "block").select("doc_id", (F.col("base") + F.col("place")).alias("first"), "n", "ids").mapInArrow(
        _cutter(window, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, ids binary")
