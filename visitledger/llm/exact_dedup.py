"""Exact de-duplication with Patricia tries.

Each scan task folds its rows into a trie first (a combiner), so a text that a third of all rows share leaves a task once.
The distinct texts meet their owner by length and content hash; an owner inserts whole byte strings into a trie whose
terminal nodes hold the smallest identifier and a row count. Owners read in (length, hash) order: whatever lies behind the
current key is final, so a trie over its memory bound hands its finished subtrees on and cuts them off.

Defined results: null text is the empty text; runs of white space count as one space, also at the ends; of equal texts the
row with the smallest id stays, of rows that repeat this id the one read first; null ids lose against any id. Further
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.llm.common import shuffle_parts, slices, text_bytes

NO_ID = (1 << 63) - 1
TRIE_BYTES = 64 << 20

PARTIAL = pa.schema([
    ("length", pa.int64()), ("content_hash", pa.int64()), ("text", pa.binary()), ("keep", pa.int64()),
    ("keep_seen", pa.int64()), ("size", pa.int64())])
OWNED = pa.schema([
    ("text_hash", pa.binary()), ("keep", pa.int64()), ("keep_seen", pa.int64()), ("size", pa.int64())])
MEMBERS = pa.schema([("doc_id", pa.int64()), ("seen", pa.int64()), ("text_hash", pa.binary())])


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    out = b" ".join(words)
    return (b" " if text[0] <= 32 and text[:1].isspace() else b"") + out + (b" " if text[-1:].isspace() else b"")


class Trie:
    """Compressed radix trie over byte strings. A node is `[label, children by first byte, (id, seen) or None, rows]`."""

    def __init__(self):
        self.root = [b"", {}, None, 0]
        self.held = 0

    def insert(self, key: bytes, best: tuple[int, int], rows: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, best, rows]
                self.held += len(key) - at + 200
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = shared_length(label, key[at:at + len(label)])
            upper = [label[:same], {label[same]: child}, None, 0]
            child[0] = label[same:]
            node[1][key[at]] = upper
            self.held += 200
            node, at = upper, at + same
        node[2] = best if node[2] is None else min(node[2], best)
        node[3] += rows

    def entries(self) -> Iterator[tuple[bytes, tuple[int, int], int]]:
        """All `(key, best, rows)`; the trie is empty afterwards, each subtree is dropped when it is written."""
        stack = [(b"", self.root)]
        self.root, self.held = [b"", {}, None, 0], 0
        while stack:
            prefix, node = stack.pop()
            key = prefix + node[0]
            if node[2] is not None:
                yield key, node[2], node[3]
            stack.extend((key, child) for child in node[1].values())
            node[1] = {}


def shared_length(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _fold(batches):
    """Scan side: distinct texts of the task with their smallest identifier and row count."""
    def drained():
        out, size = [], 0
        for key, (keep, seen), rows in trie.entries():
            out.append((len(key), xxhash.xxh3_64_intdigest(key) - (1 << 63), key, keep, seen, rows))
            size += len(key)
            if size > 8 << 20:
                yield _rows(PARTIAL, out)
                out, size = [], 0
        if out:
            yield _rows(PARTIAL, out)

    trie = Trie()
    for part in slices(batches):
        for doc, seen, text in zip(*(c.to_pylist() for c in part.columns)):
            trie.insert(normalised(text), (NO_ID if doc is None else doc, seen), 1)
        if trie.held > TRIE_BYTES:
            yield from drained()
    yield from drained()


def _own(batches):
    """Owner side: rows come in (length, hash) order; a trie holds the keys that can still get rows."""
    def drained():
        rows = [(hashlib.sha256(key).digest(), *best, n) for key, best, n in trie.entries()]
        if rows:
            yield _rows(OWNED, rows)

    trie, last = Trie(), None
    for part in slices(batches):
        for length, content, key, keep, seen, rows in zip(*(c.to_pylist() for c in part.columns)):
            if (length, content) != last and trie.held > TRIE_BYTES:
                yield from drained()
            last = (length, content)
            trie.insert(key, (keep, seen), rows)
    yield from drained()


def _hash(batches):
    for part in slices(batches):
        ids, seen, texts = part.columns
        digests = [hashlib.sha256(normalised(t)).digest() for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([ids, seen, pa.array(digests, pa.binary())], schema=MEMBERS)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(seen, doc_id, keep_id, group_size, kept, text_sha256)`; `seen` is monotonically_increasing_id() of `docs`."""
    parts = shuffle_parts(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("seen"),
        text_bytes(text_col).alias("text"))
    owned = (
        rows.mapInArrow(_fold, "length long, content_hash long, text binary, keep long, keep_seen long, size long")
        .repartition(parts, "length", "content_hash").sortWithinPartitions("length", "content_hash")
        .mapInArrow(_own, "text_hash binary, keep long, keep_seen long, size long"))
    members = rows.mapInArrow(_hash, "doc_id long, seen long, text_hash binary")
    return members.join(owned, "text_hash").select(
        "seen", "doc_id", F.when(F.col("keep") != NO_ID, F.col("keep")).alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("seen") == F.col("keep_seen")).alias("kept"), F.lower(F.hex("text_hash")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, text_sha256)`, one row for each input row."""
    return grouped(docs, id_col, text_col).drop("seen")
