"""Exact ranked search with two hierarchies: one over the search items, one over each chunk of documents.

A document's coordinates are its impacts, floor(10^9 tf / (1000 tf + 12 m)) for the items' terms; an item's are its terms'
weights times their repeats; a score is the inner product. Every node of either hierarchy holds coordinate maxima, so the
product of two nodes' maxima bounds all scores below both. A pair of nodes goes when its bound is under the weakest k-th
score among the items of its node: whole batches of documents are left out, none that could still rank.

1. A scan counts each text's terms and keeps, chunk by chunk, the items' terms with their counts, and the corpus statistics
   (documents, terms, document frequencies) summed per task.
2. The first chunks of the tasks are searched; their k-th scores are bounds for the others.
3. The other chunks are searched from those bounds; what ranks in either search is ranked once more.

Items are taken in blocks, each a pass of its own, closed when terms x items reach `CELLS`; the driver holds one block.

Defined results: texts that are null or without a term match nothing and do not count among the documents; items without a
term, or whose terms no document has, give no rows; rows that repeat an id are ranked each, null ids first among equal scores;
items that repeat are answered each; empty tables give no rows. Further columns are ignored. Sums are exact: in doubles while
no score can reach 2^53, in 64-bit integers above.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitledger.llm.common import kept, slices, text_bytes

CELLS = 1 << 21
LEAF, FAN = 8, 8
CHUNK = (4096, 4 << 20)
#: Maps A-Z to a-z and what separates terms to a space; bytes above 0x7F belong to terms.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
CHUNKS = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("docs", pa.int64()), ("words", pa.int64()), ("df", pa.list_(pa.int64())),
    ("doc_id", pa.list_(pa.int64())), ("n", pa.binary()), ("row", pa.binary()), ("term", pa.binary()), ("tf", pa.binary())])
CHUNKS_SQL = ("part int, chunk int, docs long, words long, df array<long>, doc_id array<long>, n binary, row binary, "
              "term binary, tf binary")
FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "item int, doc_id long, score long"
SCHEMA = "item_id long, rank int, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def _scanner(vocabulary: dict[bytes, int]):
    """Texts to chunks: the items' terms of each row, and at a task's end its document frequencies."""

    def scan(batches):
        part, chunk, df = TaskContext.get().partitionId(), 0, np.zeros(len(vocabulary), np.int64)
        get = vocabulary.get
        for some in slices(batches, *CHUNK):
            n, found, counts = [], [], []
            for text in some.column(1).to_pylist():
                words = terms(text)
                hits = [t for t in map(get, words) if t is not None]
                n.append(len(words))
                found += hits
                counts.append(len(hits))
            key, tf = np.unique(
                np.repeat(np.arange(len(n)), counts) * len(vocabulary) + np.array(found, np.int64), return_counts=True)
            row, term = np.divmod(key, len(vocabulary))
            df += np.bincount(term, minlength=len(vocabulary))
            sizes = np.array(n, np.int64)
            yield _chunk(part, chunk, int((sizes > 0).sum()), int(sizes.sum()), None, some.column(0).to_pylist(), sizes, row, term, tf)
            chunk += 1
        none = np.zeros(0, np.int64)
        yield _chunk(part, -1, 0, 0, df.tolist(), [], none, none, none, none)

    return scan


def _chunk(part, chunk, docs, words, df, doc_id, *arrays) -> pa.RecordBatch:
    values = [part, chunk, docs, words, df, doc_id, *(a.astype("<u4").tobytes() for a in arrays)]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CHUNKS)], schema=CHUNKS)


@dataclass
class Items:
    """Items in the order of their hierarchy. Level 0 is the root, the last has a node for each item; `maxima` holds terms x
    nodes for each level, `begins` the first item of each node, `parents` each node's place one level up."""

    order: np.ndarray
    begins: list[np.ndarray]
    parents: list[np.ndarray]
    maxima: list[np.ndarray]


def _similar_order(rows: np.ndarray, members: np.ndarray) -> list[int]:
    """Members so ordered that similar ones are neighbours: split between two far ones, each side alike."""
    if len(members) <= 2:
        return members.tolist()
    some = rows[members]
    first = int((some @ some.sum(0)).argmin())
    second = int((some @ some[first]).argmin())
    near = some @ some[first] > some @ some[second]
    if not near.any() or near.all():
        near = np.arange(len(members)) < len(members) // 2
    return _similar_order(rows, members[near]) + _similar_order(rows, members[~near])


def item_tree(weights: np.ndarray) -> Items:
    """The hierarchy over items, given as rows of term weights."""
    norm = np.sqrt((weights.astype(float) ** 2).sum(1))
    order = np.array(_similar_order(weights / np.where(norm, norm, 1)[:, None], np.arange(len(weights))))
    begins, parents, maxima = [np.arange(len(order))], [], [weights[order]]
    while len(begins[0]) > 1:
        firsts = np.arange(0, len(begins[0]), FAN)
        parents.insert(0, np.arange(len(begins[0])) // FAN)
        maxima.insert(0, np.maximum.reduceat(maxima[0], firsts))
        begins.insert(0, begins[0][firsts])
    return Items(order, begins, [np.zeros(1, np.int64), *parents], [np.ascontiguousarray(m.T) for m in maxima])


def document_levels(row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> list[tuple[np.ndarray, ...]]:
    """Levels of a hierarchy over rows 0 up, leaves' rows first: (begin of each node, term, maximum)."""
    levels, width = [], 1
    while True:
        node = row // width
        key = node * n_terms + term
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[by]) > 0))
        most = np.maximum.reduceat(impact[by], first)
        node, at = np.divmod(key[by][first], n_terms)
        count = int(node[-1]) + 1
        levels.append((np.searchsorted(node, np.arange(count + 1)), at, most))
        if count == 1:
            return levels
        width *= LEAF if width == 1 else FAN


class Search:
    """The k best rows of each item so far; `least` are scores that a row must reach."""

    def __init__(self, items: Items, k: int, least: np.ndarray):
        self.items, self.k = items, k
        self.best: list[list] = [[] for _ in items.order]
        self.weakest = np.maximum(least[items.order], 1)
        self.bounds = self.scored = 0

    def chunk(self, docs: list, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        """Search a chunk; its rows are put next to rows with the same heaviest term first."""
        if not len(row):
            return
        heavy = np.lexsort((-impact * self.items.maxima[0][term, 0], row))
        present, at = np.unique(row[heavy], return_index=True)
        lead = np.argsort(term[heavy][at], kind="stable")
        place = np.empty(len(docs), np.int64)
        place[present[lead]] = np.arange(len(present))
        docs = [docs[i] for i in present[lead].tolist()]
        levels = document_levels(place[row], term, impact.astype(self.items.maxima[0].dtype), n_terms)
        self._visit(levels, len(levels) - 1, 0, np.ones(len(self.weakest), bool), docs)

    def _visit(self, levels: list, level: int, node: int, open_items: np.ndarray, docs: list) -> None:
        begin, term, most = levels[level]
        some = slice(begin[node], begin[node + 1])
        still = self._survivors(term[some], most[some], open_items)
        if not still.any():
            return
        wide = FAN if level > 1 else LEAF
        last = min((node + 1) * wide, len(levels[level - 1][0]) - 1) if level else 0
        if level <= 1:
            self._score(levels[0], node * wide if level else 0, last or 1, np.flatnonzero(still), docs)
            return
        for child in range(node * wide, last):
            self._visit(levels, level - 1, child, still, docs)

    def _survivors(self, term: np.ndarray, most: np.ndarray, open_items: np.ndarray) -> np.ndarray:
        """Open items whose bound, and that of each node above them, reaches the weakest score below it."""
        weakest, alive = np.where(open_items, self.weakest, np.iinfo(np.int64).max), np.ones(1, bool)
        for begins, parents, maxima in zip(self.items.begins, self.items.parents, self.items.maxima):
            alive = alive[parents]
            self.bounds += int(alive.sum())
            alive &= most @ maxima[term] >= np.minimum.reduceat(weakest, begins)
            if not alive.any():
                return np.zeros(len(weakest), bool)
        return alive

    def _score(self, rows: tuple, first: int, last: int, places: np.ndarray, docs: list) -> None:
        """Scores of a leaf's rows for the items that no bound has ruled out."""
        begin, term, impact = rows
        some = slice(begin[first], begin[last])
        own = self.items.maxima[-1]
        part = own[term[some]] if 2 * len(places) > own.shape[1] else own[np.ix_(term[some], places)]
        scores = np.add.reduceat(impact[some, None] * part, begin[first:last] - begin[first])
        scores = scores[:, places] if part.shape[1] != len(places) else scores
        self.scored += scores.size
        for row, at in np.argwhere(scores >= self.weakest[places]).tolist():
            self._offer(docs[first + row], int(places[at]), int(scores[row, at]))

    def _offer(self, doc, place: int, score: int) -> None:
        heap, entry = self.best[place], (score, math.inf if doc is None else -doc)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif heap[0] < entry:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.weakest[place] = max(self.weakest[place], heap[0][0])

    def found(self) -> pa.RecordBatch:
        rows = [(int(i), None if key == math.inf else -key, score)
                for i, heap in zip(self.items.order, self.best) for score, key in heap]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, FOUND)], schema=FOUND)


def lengths_factor(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m = 75 + floor(25 n N / L)."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        return 75 + 25 * n * documents // words
    return np.array([75 + 25 * x * documents // words for x in n.tolist()], np.int64)


def _searcher(items: list[dict[int, int]], n_terms: int, documents: int, words: int, df: list[int], k: int, least: list[int]):
    """Chunks to the k best rows of each item in a task."""

    def search(batches):
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df]
        rows = np.zeros((len(items), n_terms), np.int64)
        for i, terms_of in enumerate(items):
            for t, repeats in terms_of.items():
                rows[i, t] = weight[t] * repeats
        if 10 ** 6 * int(rows.max(0).sum()) < 1 << 53:
            rows = rows.astype(np.float64)
        state = Search(item_tree(rows), k, np.array(least, np.int64))
        for batch in batches:
            for at in range(batch.num_rows):
                n, row, term, tf = (np.frombuffer(batch.column(c)[at].as_py(), "<u4").astype(np.int64) for c in ("n", "row", "term", "tf"))
                m = lengths_factor(n, documents, words)[row]
                state.chunk(batch.column("doc_id")[at].as_py(), row, term, 10 ** 9 * tf // (1000 * tf + 12 * m), n_terms)
        yield state.found()

    return search


def _blocks(items: Iterable) -> Iterator[tuple[list, list[dict[int, int]], dict[bytes, int]]]:
    """Item ids, their terms' counts by number, and the numbers of the block's terms."""
    ids, counts, numbers = [], [], {}
    for item_id, text in items:
        own = Counter(terms(text))
        if ids and len(numbers.keys() | own.keys()) * (len(ids) + 1) > CELLS:
            yield ids, counts, numbers
            ids, counts, numbers = [], [], {}
        ids.append(item_id)
        counts.append({numbers.setdefault(t, len(numbers)): c for t, c in own.items()})
    if numbers:
        yield ids, counts, numbers


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _ranked(spark: SparkSession, rows: DataFrame, ids: list, counts: list, numbers: dict[bytes, int], k: int) -> DataFrame | None:
    chunks = kept(rows.mapInArrow(_scanner(numbers), CHUNKS_SQL), "search-chunks")
    documents, words = chunks.agg(F.sum("docs"), F.sum("words")).first()
    if not words:
        return None
    by_term = chunks.where("chunk < 0").select(F.posexplode("df").alias("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
    df = [0] * len(numbers)
    for term, n in by_term.collect():
        df[term] = n

    def searched(some: DataFrame, least: list[int]) -> DataFrame:
        return some.mapInArrow(_searcher(counts, len(numbers), documents, words, df, k, least), FOUND_SQL)

    first = kept(_best(searched(chunks.where("chunk = 0"), [0] * len(ids)), k).drop("rank"), "search-first")
    least = [0] * len(ids)
    for item, score in first.groupBy("item").agg(F.min("score"), F.count("*").alias("n")).where(F.col("n") == k).drop("n").collect():
        least[item] = score
    found = kept(_best(first.union(searched(chunks.where("chunk > 0"), least)), k), "search-found")
    named = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return found.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id",
         text_col: str = "text") -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("bigint"), text_bytes(text_col)).toLocalIterator()
    out = spark.createDataFrame([], SCHEMA)
    for block in _blocks(asked):
        ranked = _ranked(spark, rows, *block, k)
        out = out if ranked is None else out.union(ranked)
    return out
