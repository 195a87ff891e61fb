"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their fingerprints; equal cuts of it are the fragments. A document's set is cut into
segments, one for each fragment, and a fragment counts alone:

1. Which n-grams do at least two different sets hold? What a chunk of documents already shows to be shared is not sent once
   for each holder: the fragment gets one mark for it. Summed over the fragments, a set of which less than the threshold is
   shared cannot link and leaves.
2. The sets left are ordered by frequency. Similar sets share an n-gram among their rarest (prefix); a shared n-gram's
   places bound the overlap.
3. The overlap of a candidate pair is counted fragment by fragment, and the partial counts are summed for each pair.

Equal sets are one class from the start. Components need no all-pairs list: in each posting list the set with the
smallest share of n-grams of its own is the hub, and each set is compared with the best hub it meets first. Sets that a link already connects are not compared
again; all pairs left between different components are, without any cap.

Defined results: a text without words (or null) has the empty set and links with nothing; with fewer words than the n-gram
size the whole sequence is the one n-gram; repeated rows are equal sets; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitledger.llm.common import emptied, kept, shuffle_parts, slices, text_bytes
from visitledger.llm.components import components
from visitledger.llm.shingles import set_keys, shingle_sets

MARK = 0
CHUNK_BYTES = 16 << 20
SETS = pa.schema([("seen", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
SEGMENTS = pa.schema([
    ("fragment", pa.int32()), ("counted", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()),
    ("tokens", pa.binary())])
SHARED = pa.schema([("key", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _sets(size: int):
    def sets(batches):
        for part in slices(batches):
            tokens, sizes = shingle_sets(part.column(2).to_pylist(), size)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(set_keys(tokens, sizes)), pa.array(sizes, pa.int64())], schema=SETS)

    return sets


def _segments(size: int, bits: int):
    """Segments of a chunk's distinct sets, fragment by fragment."""
    def rows(fragment, keys, counts, tokens, counted):
        return (fragment, counted, keys.astype("<i8").tobytes(), counts.astype("<i4").tobytes(), tokens.astype("<u8").tobytes())

    def emitted(chunk, number):
        keys = np.concatenate([k for k, _, _ in chunk])
        sizes = np.concatenate([s for _, s, _ in chunk])
        tokens = np.concatenate([t for _, _, t in chunk])
        _, first = np.unique(keys, return_index=True)
        once = np.zeros(len(keys), bool)
        once[first] = True
        once &= keys != 0
        tokens, keys, sizes = tokens[np.repeat(once, sizes)], keys[once], sizes[once]
        owner = np.repeat(np.arange(len(keys)), sizes)
        order = np.argsort(tokens)
        ordered = tokens[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(tokens), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        marks = np.unique(tokens[twice])
        out, n = [], 1 << bits
        place = (tokens >> np.uint64(64 - bits)).astype(np.uint16)
        by = np.argsort(np.where(twice, np.uint16(0), place), kind="stable")
        by = by[~twice[by]]
        cuts = np.searchsorted(place[by], np.arange(n + 1))
        mark_cuts = np.searchsorted((marks >> np.uint64(64 - bits)).astype(np.int64), np.arange(n + 1))
        for f in range(n):
            own = by[cuts[f]:cuts[f + 1]]
            holders, counts = np.unique(owner[own], return_counts=True)
            marked = marks[mark_cuts[f]:mark_cuts[f + 1]]
            out.append(rows(f, np.append(keys[holders], MARK), np.append(counts, len(marked)),
                            np.append(tokens[own], marked), True))
        if twice.any():
            # Known to be shared: nothing to count. They go along with any fragment, dealt out evenly.
            holders, counts = np.unique(owner[twice], return_counts=True)
            out.append(rows(number % n, keys[holders], counts, tokens[twice], False))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SEGMENTS)], schema=SEGMENTS)

    def segments(batches):
        chunk, held, number = [], 0, TaskContext.get().partitionId()
        for part in slices(batches):
            texts = part.column(0).to_pylist()
            tokens, sizes = shingle_sets(texts, size)
            chunk.append((set_keys(tokens, sizes), sizes, tokens))
            held += sum(map(len, texts))
            if held > CHUNK_BYTES:
                yield emitted(chunk, number)
                chunk, held, number = [], 0, number + 7919
        if chunk:
            yield emitted(chunk, number)

    return segments


def _shared(table: pa.Table) -> pa.Table:
    """Of one fragment: for each set, the n-grams that another set holds too."""
    def joined(column, dtype, wanted):
        return np.frombuffer(b"".join(x for x, c in zip(table.column(column).to_pylist(), counted) if c == wanted), dtype)

    counted = table.column("counted").to_pylist()
    found = []
    keys, counts, tokens = joined("keys", "<i8", True), joined("counts", "<i4", True), joined("tokens", "<u8", True)
    if len(tokens):
        owner = np.repeat(keys, counts)
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
        kept_rows = np.repeat(several, np.diff(np.append(start, len(tokens)))) & (owner != MARK)
        found.append((owner[kept_rows], tokens[kept_rows]))
    keys, counts, tokens = joined("keys", "<i8", False), joined("counts", "<i4", False), joined("tokens", "<u8", False)
    found.append((np.repeat(keys, counts), tokens))
    owner, tokens = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(owner, kind="stable")
    owner, tokens = owner[order], tokens[order].view(np.int64)
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    ends = np.append(start, len(owner)).astype(np.int32)
    return pa.Table.from_arrays(
        [pa.array(owner[start]), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))], schema=SHARED)


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """`(a, b, n_a, n_b, overlap)` of pairs that overlap: partial overlaps by fragment, summed for each pair."""
    left = segments.select(F.col("key").alias("a"), "fragment", F.col("tokens").alias("ta"))
    right = segments.select(F.col("key").alias("b"), "fragment", F.col("tokens").alias("tb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("ta", "tb")).alias("partial"))
    return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("overlap"))


def near_sets(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
              text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """`(seen, doc_id, key, n)` for each row, and `(key, component)` for each linked set."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    bits = min(16, max(6, (parts - 1).bit_length()))
    rows = docs.select(
        F.monotonically_increasing_id().alias("seen"), F.col(id_col).cast("bigint").alias("doc_id"),
        text_bytes(text_col).alias("text"))
    sets = kept(rows.mapInArrow(_sets(size), "seen long, doc_id long, key long, n long"), "ngram-sets", "zstd")
    shared = kept(
        rows.select("text").mapInArrow(
            _segments(size, bits), "fragment int, counted boolean, keys binary, counts binary, tokens binary")
        .groupBy("fragment").applyInArrow(_shared, "key long, tokens array<long>"), "ngram-shared", "zstd")

    # A link needs an overlap of `percent` of either set, so at least that much of a set is shared with some other set.
    classes = sets.where("n > 0").groupBy("key").agg(F.first("n").alias("n"))
    may = shared.groupBy("key").agg(F.sum(F.size("tokens")).alias("held")).join(classes, "key").where(
        F.col("held") * 100 >= F.col("n") * percent).select("key", "n")
    held = kept(
        shared.join(may, "key").select("key", "n", F.explode("tokens").alias("token")).distinct(), "ngram-postings", "zstd")
    emptied(shared)
    counted = kept(
        held.join(held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token"), "ngram-counted", "zstd")
    emptied(held)
    alive = counted.groupBy("key", "n").agg(F.count("*").alias("held")).where(
        F.col("held") * 100 >= F.col("n") * percent).select("key", (F.col("n") - F.col("held")).alias("alone"))
    alive = counted.join(alive, "key")

    fragment = F.shiftrightunsigned("token", 62).cast("int")
    segments = kept(
        alive.groupBy("key", fragment.alias("fragment")).agg(F.collect_list("token").alias("tokens")), "ngram-segments", "zstd")
    # n-grams that no other set holds are the rarest, so they come before all others.
    place = F.col("alone") + F.row_number().over(Window.partitionBy("key").orderBy("df", "token"))
    prefix = kept(
        alive.select("token", "df", "key", "n", "alone", place.alias("place")).where(
            F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1), "ngram-prefix", "zstd")
    emptied(counted)
    columns = ("key", "n", "alone", "place", "component", "hub", "common")
    postings = prefix.withColumn("component", F.col("key")).withColumns(
        {"hub": F.lit(None).cast("bigint"), "common": F.lit(None).cast("bigint")})

    def paired(one: DataFrame, other: DataFrame, *more: Column) -> DataFrame:
        """Candidate pairs of different components, by length, by the places of a shared n-gram, and by a common hub."""
        a = one.select("token", *[F.col(c).alias(f"{c}_a") for c in one.columns if c != "token"])
        b = other.select("token", *[F.col(c).alias(f"{c}_b") for c in other.columns if c != "token"])
        # n-grams that one set alone holds are behind no place and never part of an overlap.
        room = F.least(F.expr("place_a - alone_a"), F.expr("place_b - alone_b")) + F.least(
            F.expr("n_a - place_a"), F.expr("n_b - place_b"))
        # Two sets share at most what either shares with their hub, and at most what either has besides.
        over_hub = F.least("common_a", "common_b") + F.greatest(F.lit(0), F.least(
            F.expr("n_a - alone_a - common_a"), F.expr("n_b - alone_b - common_b")))
        most = F.least(room, F.when(F.col("hub_a") == F.col("hub_b"), over_hub))
        return a.join(b, "token").where(
            (F.col("component_a") != F.col("component_b"))
            & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            & (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
            & reduce(and_, more, F.lit(True))
        ).select(
            F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"),
            F.when(F.col("key_a") < F.col("key_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
            F.when(F.col("key_a") < F.col("key_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct()

    similar = F.expr(f"100 * overlap >= {percent} * (n_a + n_b - overlap)")

    # The hub of a list is its fullest set; each set is compared with the fullest hub it meets.
    full = F.struct((F.col("alone") / F.col("n")).alias("share"), "key")
    hubs = postings.groupBy("token").agg(
        F.min_by(F.struct(*columns), full).alias("first"), F.count("*").alias("df")).where("df > 1").select("token", "first.*")
    met = postings.select("token", F.col("key").alias("own")).join(hubs, "token").where("own <> key")
    best = met.groupBy("own").agg(F.min(full).alias("full")).select(
        "own", F.col("full.key").alias("hub"), F.least("own", "full.key").alias("a"), F.greatest("own", "full.key").alias("b"))
    pairs = paired(hubs, postings).join(best.select("a", "b").distinct(), ["a", "b"])
    pairs = kept(pairs, "ngram-pairs", "zstd")
    checked = kept(_overlaps(pairs, segments), "ngram-overlaps", "zstd")
    emptied(pairs)
    links = checked.where(similar).select("a", "b")
    labels = components(links)

    # A list within one component has nothing left to find; in the others, all pairs of different components are compared.
    common = best.join(checked, ["a", "b"]).select(F.col("own").alias("key"), "hub", F.col("overlap").alias("common"))
    postings = prefix.join(labels.withColumnRenamed("node", "key"), "key", "left").join(common, "key", "left").withColumns({
        "component": F.coalesce("component", "key"), "hub": F.coalesce("hub", "key"), "common": F.coalesce("common", "n")})
    left = postings.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low <> high").select("token")
    postings = kept(postings.join(left, "token"), "ngram-open", "zstd")
    if not postings.isEmpty():
        # With both prefixes at hand a pair is a row once, in the list of its first shared n-gram. Beyond the prefix that ends
        # first nothing but the rest of that set can be shared.
        whole = prefix.join(postings.select("key").distinct(), "key").groupBy("key").agg(
            F.array_sort(F.collect_list(F.struct("df", "token"))).getField("token").alias("rare"))
        listed = postings.join(whole, "key")
        shared_rare = F.array_intersect("rare_a", "rare_b")
        behind = F.greatest(*[F.ceil(F.col(n) * percent / 100) - 1 for n in ("n_a", "n_b")])
        pairs = kept(paired(
            listed, listed, F.col("key_a") < F.col("key_b"), F.element_at(shared_rare, 1) == F.col("token"),
            (F.size(shared_rare) + behind) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent), "ngram-pairs", "zstd")
        labels = components(links.union(_overlaps(pairs, segments).where(similar).select("a", "b")))
        emptied(pairs)
    emptied(segments, prefix, checked, postings)
    return sets, labels.withColumnRenamed("node", "key")


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(seen, doc_id, n_shingles, component_id, kept)`; `seen` is monotonically_increasing_id() of `docs`.

    Of each component the row with the smallest id is kept, of rows that repeat it the first; null ids come last. Rows
    without words are kept.
    """
    sets, labels = near_sets(docs, size, percent, id_col, text_col)
    placed = sets.join(labels, "key", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "key")))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "seen")
    smallest = placed.where("n > 0").groupBy("component").agg(F.min(first).alias("first"))
    worded = F.col("n") > 0
    return placed.join(smallest, "component", "left").select(
        "seen", "doc_id", F.col("n").alias("n_shingles"),
        F.when(worded, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~worded | (F.col("seen") == F.col("first.seen"))).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """`(doc_id, n_shingles, component_id)`, one row for each input row."""
    return grouped(docs, size, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")
