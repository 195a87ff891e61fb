"""Alignment of two tokenizers over all documents, with corpus-wide counts of aligned id pairs by external spill counting.

Byte offsets at which tokens of both sides end cut a text into groups; each token of side A is linked to each of side B in its
group. A pair's count is the number of documents that hold it linked. There are far more pair-document records than a worker
can hold, so they are counted outside memory:

1. A scan aligns a slice of texts and sorts its records by pair, side A first. They are cut by the low bits of the A id (the
   radix) and kept as zstd runs, one for each slice and radix. Pairs with their documents counted, merged over a task's
   slices, are kept beside them: only these go through the counting.
2. The runs of counts of a radix meet; a heap over their frames merges them in pair order. Radixes with many bytes are first
   merged in parts. As the order is side-major, an A id's pairs come together, and its maximum is known when they end.
3. Runs of records meet the counts of their radix; what the pairs add to each document of a slice streams back as one array
   for each run, and a slice's arrays are added up.

Defined results: texts that are null or empty, or whose tokens' bytes differ from a space and the text on either side, have no
tokens: all numbers 0 and no groups; rows that repeat an id (or everything) are documents of their own; an empty table gives
an empty result. Further columns are ignored. Either vocabulary may have 65,536 ids at most.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger.llm.byte_tokens import ByteCoder, PieceCoder, byte_coder, lengths, piece_coder, public_path
from visitledger.llm.common import kept, slices, text_bytes

BITS = 6
FRAME = 1 << 15
SLICE = (4096, 4 << 20)
#: Links that are sorted at once, and slices whose counts a task merges into one run.
LINKS, SLICES = 4 << 20, 16
#: Compressed bytes of runs that one group takes.
GROUP_BYTES = 48 << 20
ROW = "kind string, radix int, run long, n long, frames array<binary>, docs binary"
ROW_SCHEMA = pa.schema([
    ("kind", pa.string()), ("radix", pa.int32()), ("run", pa.int64()), ("n", pa.int64()), ("frames", pa.list_(pa.binary())),
    ("docs", pa.binary())])
RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string())])
RESULT_SQL = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, "
              "groups_sha256 string")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 up, each as narrow as its values, in one zstd frame."""
    out = []
    for a in arrays:
        code = np.min_scalar_type(int(a.max(initial=0))).newbyteorder("<")
        out.append(np.array([code.itemsize, len(a)], "<u8").tobytes() + a.astype(code).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(raw: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(data):
        width, n = np.frombuffer(data, "<u8", 2, at).tolist()
        out.append(np.frombuffer(data, f"<u{width}", n, at + 16).astype(np.int64))
        at += 16 + width * n
    return out


def turned(a: np.ndarray) -> np.ndarray:
    """16-bit ids with their low bits, the radix, in front."""
    return (a & (1 << BITS) - 1) << 16 - BITS | a >> BITS


def frames_of(pair: np.ndarray, *more: np.ndarray) -> list[bytes]:
    """Sorted pairs and what goes with them as frames: the first pair, differences, the other arrays."""
    return [packed(pair[i:i + 1], np.diff(pair[i:i + FRAME]), *(m[i:i + FRAME] for m in more)) for i in range(0, len(pair), FRAME)]


def frame(raw: bytes) -> list[np.ndarray]:
    first, steps, *more = unpacked(raw)
    return [first[0] + np.append(0, np.cumsum(steps)), *more]


def merged(runs: Iterable[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (pair, count) frames, each sorted, to sorted blocks in which a pair stands once.

    The heap holds the next frame of each run by its first pair; what is below the heap's top is final.
    """
    heap, pairs, counts, held = [], [], [], 0
    for number, frames in enumerate(map(iter, runs)):
        for raw in frames:
            got = frame(raw)
            heap.append((int(got[0][0]), number, got, frames))
            break
    heapq.heapify(heap)
    while heap:
        _, number, got, frames = heap[0]
        pairs.append(got[0])
        counts.append(got[1])
        held += len(got[0])
        raw = next(frames, None)
        if raw is None:
            heapq.heappop(heap)
        else:
            got = frame(raw)
            heapq.heapreplace(heap, (int(got[0][0]), number, got, frames))
        if held >= 16 * FRAME or not heap:
            pair, count = _summed(np.concatenate(pairs), np.concatenate(counts))
            final = int(np.searchsorted(pair, heap[0][0])) if heap else len(pair)
            if final:
                yield pair[:final], count[:final]
            pairs, counts, held = [pair[final:]], [count[final:]], 0


def _summed(pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(pair, kind="stable")
    pair, first = pair[by], np.flatnonzero(np.append(True, np.diff(pair[by]) > 0)) if len(pair) else np.zeros(0, np.int64)
    return pair[first], np.add.reduceat(count[by], first) if len(first) else count


def with_best(blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Marks each A id's pairs of highest count; the last A id of a block waits for the next block."""
    pair, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for more, counts in blocks:
        pair, count = np.concatenate([pair, more]), np.concatenate([count, counts])
        done = int(np.searchsorted(pair, pair[-1] >> 16 << 16))
        if done:
            yield pair[:done], count[:done], _highest(pair[:done], count[:done])
        pair, count = pair[done:], count[done:]
    if len(pair):
        yield pair, count, _highest(pair, count)


def _highest(pair: np.ndarray, count: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.append(True, np.diff(pair >> 16) > 0))
    most = np.maximum.reduceat(count, first)
    return (count == np.repeat(most, np.diff(np.append(first, len(pair))))).astype(np.int64)


class Aligner:
    """Aligns texts; holds both coders and their ids' decimal texts with each separator."""

    def __init__(self, a: ByteCoder, b: PieceCoder):
        if max(a.size, b.size) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.a, self.b, self.a_size, self.b_size = a, b, lengths(a.token_bytes), lengths(b.token_bytes)
        self.said = [f"{i}{s}" for s, size in ((",", a.size), ("|", a.size), (",", b.size), (";", b.size)) for i in range(size)]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids on both sides, none for texts that either side does not give back."""
        none, out = np.zeros(0, np.int64), [(np.zeros(0, np.int64),) * 2 for _ in texts]
        full = [i for i, t in enumerate(texts) if t]
        for i, b in zip(full, self.b.batch([texts[i] for i in full]) if full else []):
            raw, a = (" " + texts[i]).encode(), self.a.plain(" " + texts[i])
            if b"".join(map(self.b.token_bytes.__getitem__, b)) == raw == b"".join(map(self.a.token_bytes.__getitem__, a.tolist())):
                out[i] = a.astype(np.int64), np.array(b, np.int64)
        return out

    def aligned(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Groups of a slice: tokens with their document and group (groups counted over the slice)."""
        tokens = self.tokens(texts)
        n_a, n_b = (np.array([len(t[side]) for t in tokens], np.int64) for side in (0, 1))
        a, b = (np.concatenate([t[side] for t in tokens] or [np.zeros(0, np.int64)]) for side in (0, 1))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.zeros(1 + (int(a_end[-1]) if len(a) else 0), np.int8)
        ends[a_end] = 1
        ends[b_end] += 2
        a_last, b_last = ends[a_end] == 3, ends[b_end] == 3
        return {"n_a": n_a, "n_b": n_b, "a": a, "b": b, "a_last": a_last, "b_last": b_last,
                "a_group": np.cumsum(a_last) - a_last, "b_group": np.cumsum(b_last) - b_last,
                "a_doc": np.repeat(np.arange(len(texts)), n_a), "b_doc": np.repeat(np.arange(len(texts)), n_b)}

    def written(self, s: dict[str, np.ndarray]) -> list[str]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        code = np.empty(len(s["a"]) + len(s["b"]), np.int64)
        a_per, b_per = np.bincount(s["a_group"]), np.bincount(s["b_group"])
        code[np.arange(len(s["a"])) + (np.cumsum(b_per) - b_per)[s["a_group"]]] = s["a"] + s["a_last"] * self.a.size
        code[np.arange(len(s["b"])) + np.cumsum(a_per)[s["b_group"]]] = 2 * self.a.size + s["b"] + s["b_last"] * self.b.size
        ends = np.cumsum(s["n_a"] + s["n_b"]).tolist()
        return ["".join(map(self.said.__getitem__, code[begin:end].tolist()))[:-1] for begin, end in zip([0, *ends], ends)]


def _entries(group: np.ndarray, ids: np.ndarray, doc: np.ndarray, reduce: bool) -> list[np.ndarray]:
    """Tokens as (group, id, document, times), ordered by group; repeats in a group as one if `reduce`."""
    if not reduce:
        return [group, ids, doc, np.ones(len(ids), np.int64)]
    key, first, times = np.unique(group << 16 | ids, return_index=True, return_counts=True)
    return [key >> 16, key & 0xFFFF, doc[first], times]


def records(s: dict[str, np.ndarray], limit: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted blocks of (pair, document, links): each pair once for each document that holds it.

    A slice with more links than `limit` takes equal tokens of a group together and goes through A ids part by part.
    """
    if not len(s["a"]):
        return
    per = np.bincount(s["b_group"])
    many = int(per[s["a_group"]].sum()) > limit
    a_group, a, a_doc, a_times = _entries(s["a_group"], s["a"], s["a_doc"], many)
    b_group, b, _, b_times = _entries(s["b_group"], s["b"], s["b_doc"], many)
    per = np.bincount(b_group)
    begin = np.cumsum(per) - per
    side, by, cuts = turned(a), slice(None), [0, len(a)]
    if many:
        by = np.argsort(side, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(side[by]) > 0))
        made = np.cumsum(np.add.reduceat(per[a_group[by]], first))
        cuts = [0, *first[1:][np.diff(made // limit) > 0].tolist(), len(a)]
    side, a_group, a_doc, a_times = side[by], a_group[by], a_doc[by], a_times[by]
    for low, high in zip(cuts[:-1], cuts[1:]):
        some = slice(low, high)
        n = per[a_group[some]]
        other = np.repeat(begin[a_group[some]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        key = np.repeat(side[some] << 48 | a_doc[some], n) | b[other] << 32
        if many:
            times, by = np.repeat(a_times[some], n) * b_times[other], np.argsort(key.view(np.uint64), kind="stable")
            key, times = key[by], times[by]
        else:
            key = np.sort(key.view(np.uint64)).view(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        links = np.add.reduceat(times, first) if many else np.diff(np.append(first, len(key)))
        key = key[first]
        yield (key.view(np.uint64) >> np.uint64(32)).astype(np.int64), key & 0xFFFFFFFF, links


def _scanner(a_path: str, b_path: str, written: bool):
    aligner: list[Aligner] = []

    def rows(*values: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values), ROW_SCHEMA)], schema=ROW_SCHEMA)

    def counts(task: int, waiting: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for radix, runs in waiting.items():
            frames = [f for block in merged(runs) for f in frames_of(*block)]
            yield rows(("count", radix, task, sum(map(len, frames)), frames, None))
        waiting.clear()

    def scan(batches):
        if not aligner:
            aligner.append(Aligner(byte_coder(a_path), piece_coder(b_path)))
        task, run, waiting = TaskContext.get().partitionId(), 0, {}
        for part in slices(batches, *SLICE):
            number = task << 32 | run
            texts = [None if t is None else t.decode("utf-8", "replace") for t in part.column(1).to_pylist()]
            s = aligner[0].aligned(texts)
            per = np.bincount(s["a_group"]) * np.bincount(s["b_group"]) if len(s["a"]) else s["a"]
            docs_of_groups = s["a_doc"][s["a_last"]]
            total = np.append(0, np.cumsum(per))
            groups = np.searchsorted(docs_of_groups, np.arange(len(texts) + 1))
            said = aligner[0].written(s)
            digest = [hashlib.sha256(t.encode()).digest() if t else b"" for t in said]
            table = pa.table({
                "doc_id": part.column(0), "n_a": s["n_a"], "n_b": s["n_b"], "n_groups": np.diff(groups),
                "n_links": np.diff(total[groups]), "groups": pa.array(said if written else [None] * len(said), pa.string()),
                "digest": digest})
            yield rows(("docs", None, number, len(texts), None, _stored(table)))
            for pair, doc, links in records(s):
                first = np.flatnonzero(np.append(True, np.diff(pair) > 0))
                pairs, holders = pair[first], np.diff(np.append(first, len(pair)))
                cells = np.searchsorted(pairs, np.arange((1 << BITS) + 1) << 32 - BITS)
                starts = np.append(first, len(pair))[cells]
                for radix in np.flatnonzero(np.diff(cells)).tolist():
                    k, d = slice(cells[radix], cells[radix + 1]), slice(starts[radix], starts[radix + 1])
                    frames = frames_of(pairs[k], holders[k])
                    held = packed(doc[d], links[d] - 1)
                    waiting.setdefault(radix, []).append(frames)
                    yield rows(("cell", radix, number, len(held) + sum(map(len, frames)), frames, held))
            run += 1
            if run % SLICES == 0:
                yield from counts(task, waiting)
        yield from counts(task, waiting)

    return scan


def _stored(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _runs(table: pa.Table) -> Iterator[list[bytes]]:
    for some in table.column("frames"):
        yield some.as_py()


def _row(*values) -> pa.Table:
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, ROW_SCHEMA)], schema=ROW_SCHEMA)


def _merge(table: pa.Table) -> pa.Table:
    """Runs of counts to one run."""
    frames = [f for block in merged(_runs(table)) for f in frames_of(*block)]
    return _row("count", table.column("radix")[0].as_py(), 0, sum(map(len, frames)), frames, None)


def _total(table: pa.Table) -> pa.Table:
    """All counts of a radix, with the mark of each A id's highest."""
    frames = [f for block in with_best(merged(_runs(table))) for f in frames_of(*block)]
    return _row("total", table.column("radix")[0].as_py(), 0, sum(map(len, frames)), frames, None)


def _contribute(table: pa.Table) -> pa.Table:
    """Records of runs against the counts of their radix: what each run's documents gain."""
    kinds, runs = table.column("kind").to_pylist(), table.column("run").to_pylist()
    pair, count, best = (np.concatenate(c) for c in zip(*map(frame, table.column("frames")[kinds.index("total")].as_py())))
    out = []
    for at, kind in enumerate(kinds):
        if kind != "cell":
            continue
        own = [frame(f) for f in table.column("frames")[at].as_py()]
        pairs, holders = (np.concatenate(c) for c in zip(*own))
        doc, more = unpacked(table.column("docs")[at].as_py())
        place, links = np.repeat(np.searchsorted(pair, pairs), holders), more + 1
        size = int(doc.max()) + 1
        sums = [_added(doc, links * best[place], size), _added(doc, links * count[place], size)]
        out.append(("gain", None, runs[at], 0, None, packed(*sums)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, ROW_SCHEMA)], schema=ROW_SCHEMA)


def _added(place: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers added up by place, exactly: doubles while the whole sum fits them."""
    if float(value.sum(dtype=np.float64)) < 1 << 52:
        return np.bincount(place, value, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, place, value)
    return out


def _finish(table: pa.Table) -> pa.Table:
    """A slice's documents with what all radixes gave them."""
    docs, gains = None, []
    for kind, raw in zip(table.column("kind").to_pylist(), table.column("docs")):
        if kind == "docs":
            docs = pa.ipc.open_stream(raw.as_py()).read_all()
        else:
            gains.append(unpacked(raw.as_py()))
    totals = np.zeros((2, docs.num_rows), np.int64)
    for gain in gains:
        for total, more in zip(totals, gain):
            total[:len(more)] += more
    sha = [d.hex() for d in docs.column("digest").to_pylist()]
    columns = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(
        [*columns, totals[0], totals[1], docs.column("groups"), sha], RESULT)], schema=RESULT)


def _parts(table: DataFrame, kind: str) -> Column:
    """For each radix, so many parts that one holds `GROUP_BYTES` of runs; a row's part goes by its run."""
    sizes = table.where(F.col("kind") == kind).groupBy("radix").agg(F.sum("n").alias("n")).collect()
    parts = [1] * (1 << BITS)
    for radix, n in sizes:
        parts[radix] = -(-n // GROUP_BYTES) or 1
    return F.element_at(F.array(*map(F.lit, parts)), F.col("radix") + 1)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
          written: bool = True) -> DataFrame:
    """`(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256)`, a row for each input row.

    `groups` holds the groups themselves, null unless `written`.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scan = _scanner(a_path or public_path("byte_bpe_50k.json"), b_path or public_path("piece_bpe_32k.model"), written)
    table = kept(rows.mapInArrow(scan, ROW), "aligned")
    counts, cells = (table.where(F.col("kind") == kind) for kind in ("count", "cell"))
    part = F.pmod(F.xxhash64("run"), _parts(table, "count"))
    merged_parts = counts.withColumn("part", part).groupBy("radix", "part").applyInArrow(_merge, ROW)
    totals = kept(merged_parts.groupBy("radix").applyInArrow(_total, ROW), "aligned-counts")
    parts = _parts(table, "cell")
    dealt = cells.withColumn("part", F.pmod(F.xxhash64("run"), parts)).unionByName(
        totals.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint")))))
    gains = dealt.groupBy("radix", "part").applyInArrow(_contribute, ROW)
    return table.where(F.col("kind") == "docs").select("kind", "run", "docs").unionByName(
        gains.select("kind", "run", "docs")).groupBy("run").applyInArrow(_finish, RESULT_SQL)
