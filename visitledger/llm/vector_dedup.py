"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Inverted lists hold the vectors by pairs of these
pivots, so two vectors meet where they share at least two; each meeting pair is verified by its exact cosine in double
precision, in the list of its two smallest shared pivots only. Equal vectors are one entry. A long list is cut into blocks
and every pair of blocks is a piece of work of its own; no pair of vectors is ever a row, only sums of links and the edges of
a list's spanning forest leave a task.

Pivots are fitted on at most `sample` vectors of each dimension (those with the smallest hashes), chosen far from each
other; all vectors are indexed. Verification is exact, retrieval is not: tests measure its recall.

Defined results: a vector that is null, empty, zero, or has null or non-finite components links with nothing and is its own
component; vectors of different dimension never link; equal vectors link; repeated rows are separate vectors; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitledger.llm.common import kept, shuffle_parts
from visitledger.llm.components import components

PIVOTS = 128
NEAREST = 5
SAMPLE = 2048
BLOCK = 2048
ENTRIES = pa.schema([
    ("list", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("pivots", pa.list_(pa.int32())), ("unit", pa.binary())])
FOUND = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("links", pa.int64())])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def far_apart(vectors: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` vectors, each the one farthest from those chosen before."""
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < min(most, len(vectors)):
        k = int(nearest.argmin())
        chosen.append(k)
        nearest = np.maximum(nearest, vectors @ vectors[k])
    return vectors[chosen]


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    """An entry for each pair of a vector's nearest pivots."""
    def describe(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                vectors = part.column(2).to_pylist()
                out = []
                for dim in {len(v) for v in vectors}:
                    own = [i for i, v in enumerate(vectors) if len(v) == dim]
                    units = unit(np.array([vectors[i] for i in own], float))
                    order = np.argsort(-(units @ pivots[dim].T), axis=1, kind="stable")[:, :nearest]
                    for i, row, near in zip(own, units, order.tolist()):
                        raw, shown = row.tobytes(), sorted(near)
                        for a, b in itertools.combinations(shown, 2):
                            out.append((dim << 32 | a << 16 | b, part.column(0)[i].as_py(), part.column(1)[i].as_py(), near, raw))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, ENTRIES)], schema=ENTRIES)

    return describe


def _verified(run: dict[str, list], threshold: float) -> pa.RecordBatch | None:
    """Links of one list, or of two of its blocks: sums for each vector, and labels of the linked ones."""
    b = run["list"][0] & 0xFFFF
    units = np.frombuffer(b"".join(run["unit"]), float).reshape(len(run["unit"]), -1)
    low = np.zeros((len(units), b), np.float32)
    for i, near in enumerate(run["pivots"]):
        low[i, [p for p in near if p < b]] = 1
    # Shared pivots below the list's larger one: only the smaller one, else the pair is counted in an earlier list.
    linked = (units @ units.T >= threshold) & (low @ low.T < 1.5)
    np.fill_diagonal(linked, False)
    i, j = run["i"][0], run["j"][0]
    if i != j:
        own = np.array(run["block"])
        linked &= own[:, None] != own[None]
    if not linked.any():
        return None
    nodes, sizes = np.array(run["node"], np.int64), np.array(run["size"], np.int64)
    links = linked @ sizes
    label = nodes.copy()
    while True:
        lower = np.minimum(label, np.where(linked, label, np.iinfo(np.int64).max).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(label[some]), pa.array(links[some])], schema=FOUND)


def _verify(threshold: float):
    """Rows come ordered by list and blocks; each run of equal ones is verified at once."""
    names = ("list", "i", "j", "block", "node", "size", "pivots", "unit")

    def verify(batches):
        run = {n: [] for n in names}
        for batch in batches:
            columns = {n: batch.column(n) for n in names}
            keys = np.stack([columns[n].to_numpy(zero_copy_only=False) for n in ("list", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if run["list"] and tuple(keys[:, a]) != (run["list"][0], run["i"][0], run["j"][0]):
                    if len(run["list"]) > 1 and (found := _verified(run, threshold)) is not None:
                        yield found
                    run = {n: [] for n in names}
                for n in names:
                    run[n] += columns[n].slice(a, b - a).to_pylist()
        if len(run["list"]) > 1 and (found := _verified(run, threshold)) is not None:
            yield found

    return verify


def near_vectors(vectors: DataFrame, threshold: float = 0.9, pivots: int = PIVOTS, nearest: int = NEAREST,
                 sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`(vec_id, n_links, component_id, kept)`, one row for each input row."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.monotonically_increasing_id().alias("seen"),
        F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    classes = kept(valid.groupBy("v").agg(F.min("seen").alias("node"), F.count("*").alias("size")).select("node", "size", "v"),
                   "vector-classes")

    by_hash = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("v"), "node")
    fitted: dict[int, list] = {}
    for r in classes.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= sample).select("v").collect():
        fitted.setdefault(len(r["v"]), []).append(r["v"])
    # Few vectors get few pivots, else each would be its own nearest one.
    chosen = {dim: far_apart(unit(np.array(some, float)), min(pivots, max(8, len(some) // 8))) for dim, some in fitted.items()}

    entries = classes.mapInArrow(
        _describe(chosen, nearest), "list long, node long, size long, pivots array<int>, unit binary")
    entries = kept(entries, "vector-entries")
    blocks = entries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where(
        "blocks > 1 or blocks is null")
    dealt = (
        entries.join(blocks, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "size",
                "pivots", "unit"))
    found = kept(
        dealt.repartition(shuffle_parts(spark), "list", "i", "j").sortWithinPartitions("list", "i", "j")
        .mapInArrow(_verify(threshold), "node long, label long, links long"), "vector-links")

    labels = components(found.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    entry = classes.join(links, "node", "left").join(labels, "node", "left").select(
        "v", "node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = kept(rows.join(entry, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "seen").alias("component")),
        "vector-members")
    smallest = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return placed.join(smallest, "component").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
