"""Shard cuts and unigram columns against brute force, rows that repeat an id included."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import docs, rows  # noqa: F401

from visitledger.llm import context_tree, sharding
from visitledger.llm.queries import id_fold

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("shards", [1, 4, 16, 64])
def test_shards_are_cut_where_the_middle_of_a_row_lies(docs, rows, shards):  # noqa: F811
    got = sharding.shard_by_bytes(docs, shards).orderBy("shard", "slot").collect()
    ids = sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r["doc_id"] for r in got] == ids
    total, before, slots = sum(r["size"] for r in got), 0, Counter()
    for r in got:
        shard = min(shards - 1, (2 * before + r["size"]) * shards // (2 * total))
        assert (r["shard"], r["slot"]) == (shard, slots[shard])
        before, slots[shard] = before + r["size"], slots[shard] + 1
    sizes = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes


def test_unigram_columns_of_every_row(docs, rows):  # noqa: F811
    """Counts and the base score, from the same learning rows as the query."""
    learns = docs.select("doc_id", (id_fold(10) != 0).alias("l")).distinct().collect()
    learned = {r["doc_id"]: r["l"] for r in learns}
    split = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None], learned[i]) for i, t, *_ in rows]
    counts = Counter(w for _, words, own in split if own for w in words)
    n, v = sum(counts.values()), len(counts)
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                  for r in context_tree.score_texts(docs, id_fold(10) != 0).collect())
    want = Counter((i, len(words), sum(w in counts for w in words), n, round(sum(
        math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), 6)) for i, words, _ in split)
    assert got == want
    assert docs.where(F.col("doc_id").isNull()).count() > 1
