"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each of the 255 places in that decision tree has a context tree of its own, whose contexts
are the bytes before. A node's estimate is Krichevsky-Trofimov's; its weighted probability is the mean of that estimate and
of the product over its children. Scoring follows a text's contexts from the deepest to the root and mixes the estimates by
these weights; a context that was never seen passes the estimate of the one above on. The weights are those after all
learning texts, so a text's log probability is a sum over its (context, byte) strings.

No table of the model is sent whole to the tasks. Texts are dealt into blocks of bounded size. A block counts its distinct
strings and words once; the sums over all blocks are the model's counts. Contexts that share their last two bytes are worked
out together, only what two and fewer bytes of context say (at most 256 x 255 nodes) is known everywhere. Each block then
gets the values of its own strings back.

Defined results: null text is empty, its only token is the end. Without learning texts every binary decision is 1/2. Repeated
rows learn and score each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger.llm.common import kept, shuffle_parts, slices, text_bytes
from visitledger.llm.shingles import word_hashes

BLOCK_BYTES = 24 << 20
STRING, WORD = 0, 1
COUNTS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])
TOP = pa.schema([("node", pa.int64()), ("ones", pa.float64()), ("all", pa.float64()), ("below", pa.float64())])
VALUES = pa.schema([("code", pa.int64()), ("value", pa.float64())])
SCORES = pa.schema([
    ("doc_id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive x: Stirling's series after seven steps up."""
    low = np.ones_like(x)
    for k in range(7):
        low *= x + k
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


def log_kt(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many ones among all decisions."""
    return log_gamma(ones + 0.5) + log_gamma(all_ - ones + 0.5) - np.log(np.pi) - log_gamma(all_ + 1.0)


def weighted(ones, all_, below) -> tuple[np.ndarray, np.ndarray]:
    """ln of a node's weighted probability, and the weight of its own estimate."""
    own = log_kt(ones, all_)
    total = np.logaddexp(own, below) - np.log(2)
    return total, np.exp(own - np.log(2) - total)


def strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) strings of all places of all texts as numbers, and their number for each text.

    Before a text stand zero bytes; behind it stands one, its end.
    """
    pad = b"\0" * depth
    data = np.frombuffer(pad + (b"\0" + pad).join(texts) + b"\0", np.uint8).astype(np.uint64)
    n = len(data) - depth
    code = data[:n].copy()
    for k in range(1, depth + 1):
        code = (code << np.uint64(8)) | data[k:n + k]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes + depth) - sizes - depth
    at = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return code[at].view(np.int64), sizes


def _blocks(batches):
    """Slices of a task's rows with the number of their block: a task and so many bytes of it."""
    task, held, number = TaskContext.get().partitionId(), 0, 0
    for part in slices(batches):
        yield task << 20 | number, part
        held += part.column(part.num_columns - 1).nbytes
        if held > BLOCK_BYTES:
            held, number = 0, number + 1


def _summed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in pairs]), len(codes)).astype(np.int64)


def _counter(depth: int):
    def tally(codes, learned):
        """Distinct codes with the number of learning places, from one sort."""
        marked, n = np.unique((codes.view(np.uint64) << np.uint64(1)) | learned.astype(np.uint64), return_counts=True)
        return (marked >> np.uint64(1)).view(np.int64), np.where(marked & np.uint64(1), n, 0)

    def rows(block, found):
        for kind in (STRING, WORD):
            codes, n = _summed(found[kind])
            for at in range(0, len(codes), 50_000):
                c = codes[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(c), block)), pa.array(np.full(len(c), kind, np.int32)), pa.array(c),
                    pa.array(n[at:at + 50_000])], schema=COUNTS)

    def count(batches):
        current, found = None, {STRING: [], WORD: []}
        for block, part in _blocks(batches):
            if block != current and current is not None:
                yield from rows(current, found)
                found = {STRING: [], WORD: []}
            current = block
            texts = part.column(2).to_pylist()
            learned = np.array(part.column(1).to_pylist(), bool)
            codes, sizes = strings(texts, depth)
            found[STRING].append(tally(codes, np.repeat(learned, sizes)))
            words, sizes = word_hashes(texts)
            found[WORD].append(tally((words >> np.uint64(1)).view(np.int64), np.repeat(learned, sizes)))
            for kind in found:
                if len(found[kind]) > 3:
                    found[kind] = [_summed(found[kind])]
        if current is not None:
            yield from rows(current, found)

    return count


class Bucket:
    """Nodes with two and more bytes of context of one bucket of strings."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int):
        byte, context = codes & 255, codes >> 8
        k = np.arange(8)
        self.place = (1 << k) | (byte[:, None] >> (8 - k))
        self.bit = (byte[:, None] >> (7 - k)) & 1
        n, self.levels, deeper = np.asarray(n, float)[:, None] * np.ones(8), {}, None
        for d in range(depth, 1, -1):
            key = (context & ((1 << 8 * d) - 1))[:, None] << 8 | self.place
            nodes, at = np.unique(key.ravel(), return_inverse=True)
            at = at.reshape(key.shape)
            all_ = np.bincount(at.ravel(), n.ravel(), len(nodes))
            ones = np.bincount(at.ravel(), (n * self.bit).ravel(), len(nodes))
            if deeper is None:
                below, total, weight = None, log_kt(ones, all_), np.ones(len(nodes))
            else:
                up = np.searchsorted(nodes, ((deeper[0] >> 8) & ((1 << 8 * d) - 1)) << 8 | deeper[0] & 255)
                below = np.bincount(up, deeper[1], len(nodes))
                total, weight = weighted(ones, all_, below)
            self.levels[d] = (nodes, at, ones, all_, total, weight)
            deeper = (nodes, total)

    def top(self) -> tuple[np.ndarray, ...]:
        """Sums for the nodes with one byte of context."""
        nodes, _, ones, all_, total, _ = self.levels[2]
        up, at = np.unique(nodes & 0xFFFF, return_inverse=True)
        return up, *(np.bincount(at, x, len(up)) for x in (ones, all_, total))

    def log_probability(self, top: dict, depth: int) -> np.ndarray:
        """log10 of each string's byte given its context."""
        def level(d):
            if d > 1:
                _, at, ones, all_, _, weight = self.levels[d]
                return ones[at], all_[at], weight[at]
            ones, all_, weight = top[d]
            at = self.place if d == 0 else (self.levels[2][0][self.levels[2][1]] & 0xFFFF)
            return ones[at], all_[at], weight[at]

        mixed, seen_below = None, None
        for d in range(depth, -1, -1):
            ones, all_, weight = level(d)
            estimate = (ones + 0.5) / (all_ + 1.0)
            if mixed is None:
                mixed = estimate
            else:
                mixed = weight * estimate + (1 - weight) * np.where(seen_below, mixed, estimate)
            seen_below = all_ > 0
        return np.log10(np.where(self.bit == 1, mixed, 1 - mixed)).sum(axis=1)


def _top(depth: int):
    def top(table: pa.Table) -> pa.Table:
        bucket = Bucket(table.column("code").to_numpy(), table.column("n").to_numpy(), depth)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(bucket.top(), TOP)], schema=TOP)

    return top


def _values(depth: int, top):
    def values(table: pa.Table) -> pa.Table:
        codes = table.column("code").to_numpy()
        bucket = Bucket(codes, table.column("n").to_numpy(), depth)
        return pa.Table.from_arrays([pa.array(codes), pa.array(bucket.log_probability(top.value, depth))], schema=VALUES)

    return values


def _scorer(depth: int, end_value: float, end_known: bool):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = answers.column("kind").to_numpy()
        tables = {}
        for kind in (STRING, WORD):
            codes = answers.column("code").to_numpy()[kinds == kind]
            order = np.argsort(codes)
            tables[kind] = codes[order], answers.column("value").to_numpy()[kinds == kind][order]
            if kind == WORD:
                known = (answers.column("n").to_numpy()[kinds == kind] > 0)[order]
        out = []
        for part in slices(docs.to_batches()):
            texts = part.column("text").to_pylist()
            codes, sizes = strings(texts, depth)
            values = tables[STRING][1][np.searchsorted(tables[STRING][0], codes)]
            own = np.add.reduceat(values, np.cumsum(sizes) - sizes)
            words, n_words = word_hashes(texts)
            at = np.searchsorted(tables[WORD][0], (words >> np.uint64(1)).view(np.int64))
            text = np.repeat(np.arange(len(texts)), n_words)
            base = np.bincount(text, tables[WORD][1][at], len(texts)) + end_value
            n_known = np.bincount(text, known[at], len(texts)).astype(np.int64) + int(end_known)
            out.append(pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("learned"), pa.array(n_words + 1), pa.array(n_known), pa.array(base),
                pa.array(own), pa.array([len(t) for t in texts], pa.int64())], schema=SCORES))
        return pa.Table.from_batches(out, schema=SCORES)

    return score


def _labelled(batches):
    for block, part in _blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(part.num_rows, block)), *part.columns], names=["block", "doc_id", "learned", "text"])


def score_texts(docs: DataFrame, learn: Column, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`, one row for each input row.

    `learn` marks the rows to learn from. `score` is the context tree's log10 probability of the text with its end,
    `base_score` that of a smoothed unigram model of lower-cased words and an end.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learned"),
        text_bytes(text_col).alias("text"))
    blocks = kept(rows.mapInArrow(_counter(depth), "block long, kind int, code long, n long"), "tree-blocks")
    counts = kept(blocks.groupBy("kind", "code").agg(F.sum("n").alias("n")), "tree-counts")

    ends = rows.where("learned").count()
    words = counts.where(F.col("kind") == WORD)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, distinct = tokens + ends, distinct + int(ends > 0)
    floor = tokens + 0.1 * (distinct + 1)

    bucket = F.pmod(F.xxhash64(F.expr("code & 16776960")), F.lit(4 * shuffle_parts(spark)))
    by_bucket = counts.where(F.col("kind") == STRING).groupBy(bucket.alias("bucket"))
    top = _tree_top(by_bucket.applyInArrow(_top(depth), "node long, ones double, all double, below double"))
    string_values = by_bucket.applyInArrow(_values(depth, spark.sparkContext.broadcast(top)), "code long, value double")
    values = string_values.select(F.lit(STRING).alias("kind"), "code", "value", F.lit(0).cast("bigint").alias("n")).union(
        words.select("kind", "code", F.log10((F.col("n") + 0.1) / F.lit(floor)).alias("value"), "n"))
    answers = blocks.select("block", "kind", "code").join(values, ["kind", "code"])
    labelled = rows.mapInArrow(_labelled, "block long, doc_id long, learned boolean, text binary")
    scored = labelled.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scorer(depth, float(np.log10((ends + 0.1) / floor)), ends > 0),
        "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return scored.select(
        "doc_id", "learned", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def _tree_top(partial: DataFrame) -> dict:
    """Estimates and weights of the nodes with one and no byte of context, by node number; at most 256 x 256 of them."""
    rows = partial.groupBy("node").agg(F.sum("ones"), F.sum("all"), F.sum("below")).collect()
    one = np.zeros((3, 1 << 16))
    for node, *sums in rows:
        one[:, node] = sums
    total, weight = weighted(*one)
    none = [x.reshape(256, 256).sum(axis=0) for x in (one[0], one[1], total)]
    return {1: (one[0], one[1], weight), 0: (none[0], none[1], weighted(*none)[1])}
