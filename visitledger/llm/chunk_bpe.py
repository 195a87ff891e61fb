"""BPE ids of whole texts from content-defined chunks, and back.

A rolling hash over the last 32 bytes cuts texts into chunks, so texts that share a passage share its chunks wherever it
stands. A chunk is encoded once in a worker and found again by its content. Only its inner words are used: the words a cut
has split are joined again, re-encoded together with their neighbours, and accepted when the new ids reproduce the
neighbours' ids on both sides; otherwise the window widens until they do, at last to the whole text.

Chunks are remembered in each Python worker up to a bound, not in a table for the whole cluster: sending every chunk to an
owner and its ids back moves more bytes than the texts have.

Defined results: null and empty texts have no ids and decode to the empty string; repeated rows are encoded each; an empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.llm.common import slices, text_bytes
from visitledger.llm.tokens import ID, default_vocabulary, word_ids

WINDOW = 32
MEAN_BITS = 9
CHUNK_MEMORY = 24 << 20
EDGE = 4
#: One pseudo-random 64-bit number for each byte value, from a fixed rule.
GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64)
ENCODED = pa.schema([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def cuts(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text. A cut depends on the 32 bytes before it alone."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, reach = GEAR[data], 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint64(reach)
        reach *= 2
    # The bit that only the newest WINDOW bytes reach: bits WINDOW-1 and below see fewer, higher ones see them all.
    places = np.flatnonzero((h >> np.uint64(WINDOW)) & np.uint64((1 << MEAN_BITS) - 1) == 0) + 1
    out, start = [], 0
    for text in texts:
        end = start + len(text)
        low, high = np.searchsorted(places, (start + WINDOW, end))
        out.append([*(places[low:high] - start).tolist(), len(text)] if text else [])
        start = end
    return out


class Chunk:
    """A chunk's inner words: their ids, a few at either edge, and the pieces a cut has left at its ends."""

    __slots__ = ("head", "ids", "first", "last", "tail", "whole")

    def __init__(self, text: bytes):
        words = text.split()
        opens, closes = text[:1].isspace(), text[-1:].isspace()
        self.whole = len(words) == 1 and not opens and not closes
        self.head = words.pop(0) if words and not opens else b""
        self.tail = words.pop() if words and not closes else b""
        self.first, self.last, self.ids = words, words, b""

    def encode(self, known: dict[bytes, bytes]) -> None:
        self.ids = b"".join(map(known.__getitem__, self.first))
        self.first, self.last = self.first[:EDGE], self.first[-EDGE:]


class ChunkEncoder:
    def __init__(self, path: str):
        self.words = word_ids(path)
        self.chunks: dict[bytes, Chunk] = {}
        self.held = 0
        tokens = self.words.tokenizer
        self.token = [(tokens.id_to_token(i) or "").encode() for i in range(tokens.get_vocab_size())]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        found, fresh = [], {}
        if self.held > CHUNK_MEMORY:
            self.chunks, self.held = {}, 0
        for text, ends in zip(texts, cuts(texts)):
            at, own = 0, []
            for end in ends:
                piece = text[at:end]
                chunk = self.chunks.get(piece) or fresh.get(piece)
                if chunk is None:
                    chunk = fresh[piece] = Chunk(piece)
                own.append(chunk)
                at = end
            found.append(own)
        if fresh:
            self.words.learn(set().union(*(c.first for c in fresh.values())))
            for piece, chunk in fresh.items():
                chunk.encode(self.words.known)
                self.chunks[piece] = chunk
                self.held += 2 * len(piece) + 500

        parts, joins = [], []
        for own in found:
            out, carry, left = [], b"", []
            for chunk in own:
                if chunk.whole:
                    carry += chunk.head
                    continue
                carry += chunk.head
                if carry:
                    joins.append((out, len(out), left, carry, chunk.first))
                    out.append(b"")
                out.append(chunk.ids)
                carry, left = chunk.tail, chunk.last
            if carry:
                joins.append((out, len(out), left, carry, []))
                out.append(b"")
            parts.append(out)
        self._repair(joins)
        return [self.words.encode(text) if None in out else b"".join(out) for out, text in zip(parts, texts)]

    def _repair(self, joins: list[tuple]) -> None:
        """Fill each join's place with the ids of the joined word; None where no window agreed."""
        for reach in range(1, EDGE + 1):
            if not joins:
                return
            self.words.learn({w for _, _, left, _, right in joins for w in (*left[-reach:], *right[:reach])})
            known = self.words.known
            windows = [b" ".join([*left[-reach:], joined, *right[:reach]]).decode("utf-8", "replace")
                       for _, _, left, joined, right in joins]
            again = []
            for join, got in zip(joins, self.words.tokenizer.encode_batch_fast(windows, add_special_tokens=False)):
                out, place, left, _, right = join
                ids = np.array(got.ids, ID).tobytes()
                before = b"".join(known[w] for w in left[-reach:])
                after = b"".join(known[w] for w in right[:reach])
                if ids.startswith(before) and ids.endswith(after) and len(ids) >= len(before) + len(after):
                    out[place] = ids[len(before):len(ids) - len(after)]
                else:
                    out[place] = None
                    again.append(join)
            joins = again

    def decode(self, ids: list[int]) -> bytes:
        """As the library decodes when the file has no decoder: the tokens with single spaces between."""
        return b" ".join(map(self.token.__getitem__, ids))


_encoders: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _coder(path: str):
    def code(batches):
        encoder = chunk_encoder(path)
        for part in slices(batches):
            ids = encoder.encode(part.column(1).to_pylist())
            ends = np.cumsum([0, *(len(x) // 2 for x in ids)]).astype(np.int32)
            values = np.frombuffer(b"".join(ids), ID)
            flat = values.tolist()
            decoded = [encoder.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32))),
                pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return code


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """`(doc_id, ids array<int>, decoded string)`, one row for each input row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    coded = rows.mapInArrow(_coder(vocabulary or default_vocabulary()), "doc_id long, ids array<int>, decoded binary")
    return coded.withColumn("decoded", F.col("decoded").cast("string"))
