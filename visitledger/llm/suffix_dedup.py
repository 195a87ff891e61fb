"""Removal of long repeats by suffix arrays.

A byte goes if a string of `length` bytes that covers it starts anywhere else. Suffix arrays over the whole corpus would
sort every byte; three steps leave only what can repeat, without missing any string:

1. Each window of `length` bytes names its anchor: the place of its smallest 128-byte fingerprint (the first, if equal).
   Equal windows name equal anchors at the same distance, so a window whose anchor occurs once repeats nowhere.
2. What surrounds an anchor's occurrence, as far as its windows reach, is a region. Regions of one anchor go to one shard, so
   equal windows meet in a shard whatever document they come from; each distinct region is sent once by a task, and is one row
   with the number of its occurrences from then on. The distinct regions of an anchor with very many occurrences are cut finer:
   by distance between window and anchor, and by the bytes that such windows share.
3. Where a region is the only distinct one of its shard, its copies repeat whole. The others' suffixes are sorted by induction:
   equal windows are at the same distance from their anchor, so each distance has an array of its own, which follows from the
   array one byte to the right by one stable sort on the byte in front. Common prefixes of neighbours go along and mark windows
   that share `length` bytes. Strings without a common anchor are sorted by Larsson-Sadakane refinement, with Kasai's prefixes
   and several arrays above the sorting bound, merged by binary search.

Defined results: null text is empty; texts shorter than `length` keep all bytes; overlapping repeats count; repeated rows
repeat each other whole; an empty table gives an empty result; further columns are ignored. Bytes are cut without regard to
characters, so what is kept is binary.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.llm.common import kept, shuffle_parts, slices, text_bytes
from visitledger.llm.shingles import BYTE, STEP, mixed

GRAM = 128
SORT_BYTES = 4 << 20
SEEN = 200_000
#: Occurrences of an anchor above which its regions are cut to so many window starts.
FINER = ((1 << 13, 64), (1 << 16, 1))
SCANNED = pa.schema([
    ("seen", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()),
    ("anchor", pa.list_(pa.int64())), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())),
    ("place", pa.list_(pa.int32()))])
REGIONS = pa.schema([
    ("seen", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("starts", pa.list_(pa.int32())),
    ("ids", pa.list_(pa.int64())), ("anchors", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
    ("often", pa.list_(pa.int64())), ("bytes", pa.list_(pa.binary())), ("load", pa.int64())])
PIECES = pa.schema([
    ("id", pa.int64()), ("at", pa.int32()), ("shard", pa.int64()), ("piece", pa.int64()), ("place", pa.int32()),
    ("raw", pa.binary()), ("copies", pa.int64())])
SPANS = pa.schema([("id", pa.int64()), ("spans", pa.list_(pa.int32()))])
CUT = pa.schema([
    ("seen", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int32())), ("kept_bytes", pa.binary()),
    ("kept_text", pa.string())])


def anchors(texts: list[bytes], length: int) -> list[tuple[np.ndarray, ...]]:
    """For each text: fingerprints of its windows' anchors, first and last window that names each, and its place."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    none = (np.zeros(0, np.int64), *(np.zeros(0, np.int32),) * 3)
    if not (sizes >= length).any():
        return [none] * len(texts)
    h, step, reach = BYTE[data], 0, 1
    while reach < GRAM:
        h = h[:-reach] * STEP[8 + step] + h[reach:]
        step, reach = step + 1, 2 * reach
    h = mixed(h)
    low, place, reach, wide = h, np.arange(len(h), dtype=np.int32), 1, length - GRAM + 1
    while reach < wide:
        shift = min(reach, wide - reach)
        left = low[:-shift] <= low[shift:]
        low, place = np.where(left, low[:-shift], low[shift:]), np.where(left, place[:-shift], place[shift:])
        reach += shift
    out = []
    for begin, end in zip(begins.tolist(), ends.tolist()):
        if end - begin < length:
            out.append(none)
            continue
        own = place[begin:end - length + 1]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out.append((h[own[new]].view(np.int64), new.astype(np.int32),
                    np.append(new[1:], len(own)).astype(np.int32) - 1, own[new] - np.int32(begin)))
    return out


def _lists(values: list, dtype) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.asarray(v) for v in values]) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(dtype)))


def _scanner(length: int):
    def scan(batches):
        for part in slices(batches):
            seen, ids, texts = part.column(0), part.column(1), part.column(2).to_pylist()
            found = anchors(texts, length)
            yield pa.RecordBatch.from_arrays([
                seen, ids, pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]), _lists([f[0] for f in found], np.int64),
                *[_lists([f[k] for f in found], np.int32) for k in (1, 2, 3)]], schema=SCANNED)

    return scan


def _pieces(place: int, last: int, often: int, length: int, finer: tuple):
    """Step, and first and last windows of the pieces of a region of windows 0 to `last` whose anchor is at `place`: cuts at fixed
    distances from the anchor, so that equal windows get equal cuts."""
    step = next((s for above, s in reversed(finer) if often > above), length)
    at, cuts = 0, []
    while at <= last:
        to = min(last, place - (place - at) // step * step)
        cuts.append((at, to))
        at = to + 1
    return step, cuts


def _regions(length: int):
    """Regions of the repeated anchors; the bytes of a region go with its first row in the task."""
    finer = FINER

    def regions(batches):
        sent: set[int] = set()
        for part in slices(batches):
            rows = []
            for seen, doc, text, occurrences in zip(*(c.to_pylist() for c in part.columns)):
                starts, ids, anchor, places, often, content, load = [], [], [], [], [], [], 0
                for o in occurrences:
                    first, last = o["first"], o["last"]
                    raw = text[first:last + length]
                    # The anchor is part of the name: the same bytes can serve windows of another anchor.
                    name = xxhash.xxh3_64_intdigest(raw, seed=o["anchor"] & ((1 << 63) - 1)) - (1 << 63)
                    starts.append(first)
                    ids.append(name)
                    anchor.append(o["anchor"])
                    places.append(o["place"] - first)
                    often.append(o["n"])
                    if name in sent:
                        content.append(None)
                    else:
                        sent.add(name)
                        content.append(raw)
                        load += sum(to - at + length for at, to in _pieces(places[-1], last - first, o["n"], length, finer)[1])
                if len(sent) > SEEN:
                    sent.clear()
                rows.append((seen, doc, text, starts, ids, anchor, places, often, content, load))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), REGIONS)], schema=REGIONS)

    return regions


def _piecer(length: int):
    """Distinct regions to the pieces that meet in a shard; the bytes of a piece go with its first row in the task."""
    finer = FINER

    def cut(batches):
        sent: set[int] = set()
        for part in slices(batches, 64):
            rows = []
            for name, anchor, place, often, raw, copies in zip(*(c.to_pylist() for c in part.columns)):
                step, cuts = _pieces(place, len(raw) - length, often, length, finer)
                for at, to in cuts:
                    shard, piece, own = anchor, name, raw
                    if step < length:
                        block = (place - at) // step
                        # What all windows of the block share; the region may hold a part of the block only.
                        core = raw[place - block * step:place - (block + 1) * step + 1 + length]
                        shard = xxhash.xxh3_64_intdigest(core, seed=block) - (1 << 63)
                        own = raw[at:to + length]
                        # The shard is part of the name: the same bytes can serve windows of another block.
                        piece = xxhash.xxh3_64_intdigest(own, seed=shard & ((1 << 63) - 1)) - (1 << 63)
                        if piece in sent:
                            own = None
                        sent.add(piece)
                    rows.append((name, at, shard, piece, place - at, own, copies))
            if len(sent) > SEEN:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return cut


def ranked(data: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts ordered by their `length` bytes, and for all places the rank that refinement has reached.

    Larsson-Sadakane: places are ordered by 8 bytes, then groups of equal rank are split by the rank of the place that far
    behind, doubling the distance; groups of one are left alone.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * length, np.uint8)]).astype(np.uint64)
    key, width = padded, 1
    while width < 8:
        key = (key[:-width] << np.uint64(8 * width)) | key[width:]
        width *= 2
    key = key[:n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n + 2 * length, np.int64)
    rank[n:] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.bincount(rank[:n], minlength=n)
    active = order[size[rank[order]] > 1]
    while width * 2 <= length and len(active):
        key = rank[active] * (n + 1) + rank[active + width] + 1
        by = np.argsort(key)
        active, key = active[by], key[by]
        new = np.append(True, key[1:] != key[:-1])
        old = rank[active]
        heads = np.append(True, old[1:] != old[:-1])
        at = np.arange(len(active))
        offset = at - np.maximum.accumulate(np.where(heads, at, 0))
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - at + offset
        run = np.diff(np.append(np.flatnonzero(new), len(active)))
        active = active[np.repeat(run > 1, run)]
        width *= 2
    # Ranks of single groups tell all longer prefixes apart too.
    tail = rank[windows + (length - width)] if width < length else np.zeros(len(windows), np.int64)
    by = np.lexsort((tail, rank[windows]))
    return windows[by], rank


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix, up to `length`, of each ordered window with the one before it (Kasai), all runs of windows in step.

    A window's prefix is at least that of the window one byte before, less one, while both it and its neighbour go on in
    the same order (windows equal up to `length` may not).
    """
    n = len(data)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    is_window = np.zeros(n + 2, bool)
    is_window[order] = True
    turn = np.zeros(n + 2, np.int64)
    turn[order] = np.arange(len(order))
    prefix = np.zeros(n + 1, np.int64)
    starts = np.sort(order)
    heads = starts[~is_window[starts - 1] | (starts == 0)]
    at, have = heads, np.zeros(len(heads), np.int64)
    padded = np.append(data, np.zeros(length, np.uint8))
    while len(at):
        other = before[at]
        open_ = np.flatnonzero((other >= 0) & (have < length))
        have[other < 0] = 0
        while len(open_):
            same = padded[at[open_] + have[open_]] == padded[other[open_] + have[open_]]
            open_ = open_[same]
            have[open_] += 1
            open_ = open_[have[open_] < length]
        prefix[at] = have
        on = is_window[at + 1]
        carried = on & (other >= 0) & is_window[other + 1] & (turn[other + 1] < turn[at + 1])
        have = np.where(carried, np.maximum(have - 1, 0), 0)[on]
        at = at[on] + 1
    return prefix[order]


def merge_marks(data_a, order_a, data_b, order_b, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which ordered windows of two arrays occur in the other one too, by binary search with whole comparisons."""
    def words(data):
        padded = np.append(data, np.zeros(length + 8, np.uint8)).astype(np.uint64)
        key, width = padded, 1
        while width < 8:
            key = (key[:-width] << np.uint64(8 * width)) | key[width:]
            width *= 2
        return key

    steps = [*range(0, length - 8, 8), length - 8]
    wa, wb = words(data_a), words(data_b)

    def less(a, b):
        """a < b by content; a and b are places in the two arrays."""
        out, left = np.zeros(len(a), bool), np.arange(len(a))
        for s in steps:
            x, y = wa[a[left] + s], wb[b[left] + s]
            out[left[y < x]] = True
            left = left[x == y]
            if not len(left):
                break
        return out, left

    low, high = np.zeros(len(order_a), np.int64), np.full(len(order_a), len(order_b))
    while (busy := np.flatnonzero(low < high)).size:
        mid = (low[busy] + high[busy]) // 2
        greater, _ = less(order_a[busy], order_b[mid])
        low[busy[greater]] = mid[greater] + 1
        high[busy[~greater]] = mid[~greater]
    inside = np.flatnonzero(low < len(order_b))
    _, equal = less(order_a[inside], order_b[low[inside]])
    in_a, in_b = np.zeros(len(order_a), bool), np.zeros(len(order_b), bool)
    in_a[inside[equal]] = True
    in_b[low[inside[equal]]] = True
    return in_a, in_b


def repeated_windows(regions: list[bytes], several: list[bool], length: int) -> list[np.ndarray]:
    """For each distinct region: whether each of its windows repeats. `several`: the region itself occurs again."""
    arrays, part, held = [], [], 0
    for k, raw in enumerate(regions):
        part.append(k)
        held += len(raw)
        if held >= SORT_BYTES or k == len(regions) - 1:
            data = np.frombuffer(b"".join(regions[i] for i in part), np.uint8)
            sizes = np.array([len(regions[i]) for i in part])
            begins = np.cumsum(sizes) - sizes
            counts = sizes - length + 1
            windows = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
            order, _ = ranked(data, windows, length)
            equal = common_prefixes(data, order, length) >= length
            marked = equal | np.append(equal[1:], False)
            marked |= np.repeat(np.array([several[i] for i in part]), counts)[np.searchsorted(windows, order)]
            arrays.append([part, data, windows, counts, order, equal, marked])
            part, held = [], 0
    for i, a in enumerate(arrays):
        for b in arrays[i + 1:]:
            in_a, in_b = merge_marks(a[1], a[4], b[1], b[4], length)
            a[6] |= in_a
            # The search finds the first of equal windows; the others have it for a neighbour.
            group = np.cumsum(~b[5]) - 1
            b[6] |= np.isin(group, group[in_b])
    out: list = [None] * len(regions)
    for part, _, windows, counts, order, _, marked in arrays:
        flags = np.zeros(len(windows), bool)
        flags[np.searchsorted(windows, order)] = marked
        for k, flag in zip(part, np.split(flags, np.cumsum(counts)[:-1])):
            out[k] = flag
    return out


def induced_windows(regions: list[bytes], several: list[bool], shards: list[int], places: list[int], length: int) -> list[np.ndarray]:
    """`repeated_windows` of regions whose equal windows are of one shard and at one distance from the anchor at `places`."""
    n = len(regions)
    sizes, places = np.array([len(r) for r in regions], np.int64), np.array(places, np.int64)
    begins = np.cumsum(sizes) - sizes
    low, high = -int(places.max(initial=0)), int((sizes - places).max(initial=0))
    # Bytes by distance from the anchor, one more than their value; nought lies outside the region.
    column = np.zeros((high - low, n), np.int16)
    for k, (raw, place) in enumerate(zip(regions, places.tolist())):
        column[-place - low:len(raw) - place - low, k] = np.frombuffer(raw, np.uint8)
        column[-place - low:len(raw) - place - low, k] += 1
    _, shard = np.unique(np.array(shards, np.int64), return_inverse=True)
    # A shard's regions stay side by side, so the shard at a place of the order never changes.
    order = np.argsort(shard, kind="stable")
    shard = shard[order].astype(np.int64) << 9
    shared = np.zeros(n + 1, np.int64)
    marked = np.zeros(int(sizes.sum()), bool)
    for distance in range(high - 1, low - 1, -1):
        key = shard + column[distance - low][order]
        if (key[1:] < key[:-1]).any():
            by = np.argsort(key, kind="stable")
            order, key = order[by], key[by]
            before, shared = shared, np.append(shared[by], 0)
            # Neighbours that were apart share what all between them did.
            far = np.flatnonzero((by[1:] != by[:-1] + 1) & (key[1:] == key[:-1])) + 1
            if len(far):
                shared[far] = np.minimum.reduceat(before, np.stack([by[far - 1] + 1, by[far] + 1], 1).ravel())[::2]
        same = (key[1:] == key[:-1]) & ((key[1:] & 511) > 0)
        shared[1:-1] = np.where(same, shared[1:-1] + 1, 0)
        long = np.flatnonzero(shared[1:] >= length) + 1
        if len(long):
            found = order[np.concatenate([long - 1, long])]
            marked[begins[found] + places[found] + distance] = True
    return [marked[b:b + s - length + 1] | again for b, s, again in zip(begins.tolist(), sizes.tolist(), several)]


def runs(flags: np.ndarray, length: int) -> list[int]:
    """Covered byte spans `[from, to, from, to, ...]` of marked windows; touching spans are one."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return merged([(int(a), int(b) - 1 + length) for a, b in zip(edges[0::2], edges[1::2])])


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _marker(length: int):
    def mark(table: pa.Table) -> pa.Table:
        raws, shards, places, copies, met = {}, {}, {}, Counter(), {}
        for name, at, shard, piece, place, raw, n in zip(*(table.column(c).to_pylist() for c in PIECES.names)):
            if raw is not None:
                raws[piece] = raw
            shards[piece] = shard
            places[piece] = place
            copies[piece] += n
            met.setdefault(piece, []).append((name, at))
        pieces_of = Counter(shards.values())
        # A piece without another one of its shard is equal to nothing but its own copies; only the others need arrays.
        found = [(k, [0, len(raws[k])]) for k, shard in shards.items() if pieces_of[shard] == 1 and copies[k] > 1]
        names = sorted((k for k, shard in shards.items() if pieces_of[shard] > 1), key=shards.get)
        held = np.cumsum([0, *(len(raws[k]) for k in names)])
        part = 0
        while part < len(names):
            # Whole shards together, up to a quarter of the sorting bound.
            end = max(part + 1, int(np.searchsorted(held, held[part] + SORT_BYTES // 4, "right")) - 1)
            while end < len(names) and shards[names[end]] == shards[names[end - 1]]:
                end += 1
            own, part = names[part:end], end
            flags = induced_windows([raws[k] for k in own], [copies[k] > 1 for k in own], [shards[k] for k in own],
                                    [places[k] for k in own], length)
            found += [(k, runs(f, length)) for k, f in zip(own, flags) if f.any()]
        marked = [(name, [at + x for x in spans]) for k, spans in found for name, at in met[k]]
        return pa.Table.from_arrays(
            [pa.array([x[k] for x in marked], f.type) for k, f in enumerate(SPANS)], schema=SPANS)

    return mark


def _whole(batches):
    """The spans that pieces of a region have, touching ones as one."""
    for batch in batches:
        spans = [merged(list(zip(s[0::2], s[1::2]))) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS[1].type)], schema=SPANS)


def _cut(batches):
    for part in slices(batches):
        rows = []
        for seen, text, starts, spans in zip(*(c.to_pylist() for c in part.columns)):
            gone = merged([(at + a, at + b) for at, own in zip(starts, spans) for a, b in zip(own[0::2], own[1::2])])
            keep, at = [], 0
            for a, b in zip(gone[0::2], gone[1::2]):
                keep.append(text[at:a])
                at = b
            keep.append(text[at:])
            left = b"".join(keep)
            whole = b"".join(k.decode("utf-8", "ignore").encode() for k in keep).decode()
            rows.append((seen, sum(gone[1::2]) - sum(gone[0::2]), gone, left, whole))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CUT)], schema=CUT)


def long_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """`(seen, doc_id, n_bytes, text_sha256, ...)` for each row in the order of reading, and `(seen, n_removed, spans,
    kept_bytes, kept_text)` for the rows that lose bytes; `spans` holds from and to of each removed run, `kept_text` the
    whole characters left."""
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("seen"), F.col(id_col).cast("bigint").alias("doc_id"),
        text_bytes(text_col).alias("text"))
    scanned = kept(rows.mapInArrow(
        _scanner(length), "seen long, doc_id long, n_bytes long, text_sha256 string, anchor array<long>, first array<int>, "
        "last array<int>, place array<int>"), "repeat-anchors", "zstd")
    named = scanned.select("seen", F.explode(F.arrays_zip("anchor", "first", "last", "place")).alias("o")).select("seen", "o.*")
    often = named.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = named.join(often, "anchor").groupBy("seen").agg(
        F.collect_list(F.struct("anchor", "first", "last", "place", "n")).alias("occurrences"))
    regions = kept(rows.join(wanted, "seen").select("seen", "doc_id", "text", "occurrences").mapInArrow(
        _regions(length), "seen long, doc_id long, text binary, starts array<int>, ids array<long>, anchors array<long>, "
        "places array<int>, often array<long>, bytes array<binary>, load long"), "repeat-regions", "zstd")

    each = regions.select("seen", F.explode(F.arrays_zip("starts", "ids")).alias("r")).select(
        "seen", F.col("r.starts").alias("at"), F.col("r.ids").alias("id"))
    distinct = regions.select(F.explode(F.arrays_zip("ids", "anchors", "places", "often", "bytes")).alias("r")).select(
        F.col("r.ids").alias("id"), "r.anchors", "r.places", "r.often", "r.bytes").groupBy("id").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in ("anchors", "places", "often", "bytes")), F.count("*").alias("copies"))
    pieces = distinct.mapInArrow(_piecer(length), "id long, at int, shard long, piece long, place int, raw binary, copies long")
    # Whole anchors share a bucket; buckets are as many as keep their bytes well below the sorting bound.
    size = regions.agg(F.sum("load")).first()[0] or 0
    buckets = max(shuffle_parts(spark), size // (SORT_BYTES // 2) + 1)
    marked = kept(
        pieces.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(buckets)))
        .groupBy("bucket").applyInArrow(_marker(length), "id long, spans array<int>"), "repeat-spans")
    spans = marked.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(
        _whole, "id long, spans array<int>")
    gone = each.join(spans, "id").groupBy("seen").agg(F.collect_list(F.struct("at", "spans")).alias("gone"))
    cut = regions.select("seen", "text").join(gone, "seen").select("seen", "text", "gone.at", "gone.spans").mapInArrow(
        _cut, "seen long, n_removed long, spans array<int>, kept_bytes binary, kept_text string")
    return scanned, cut


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`, one row for each input row."""
    scanned, cut = long_repeats(docs, length, id_col, text_col)
    short = cut.select("seen", "n_removed", (F.size("spans") / 2).cast("bigint").alias("n_spans"),
                       F.sha2("kept_bytes", 256).alias("kept_sha256"))
    return scanned.select("seen", "doc_id", "n_bytes", "text_sha256").join(short, "seen", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256"))
