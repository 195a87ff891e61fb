"""Alignment, compressed token files and ranked search against brute force, on the difficult rows of the other tests."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from test_llm import docs, empty, rows  # noqa: F401
from tokenizers import Tokenizer

from visitledger.llm import alignment, dual_tree, repair
from visitledger.llm.byte_tokens import byte_coder, piece_coder, public_path
from visitledger.llm.queries import ORACLES, QUERIES

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def library() -> Tokenizer:
    return Tokenizer.from_file(public_path(A))


# --- coders -------------------------------------------------------------------------------------------------------------

def test_fast_ids_are_the_libraries():
    coder, own = byte_coder(public_path(A)), library()
    rng = random.Random(4)
    texts = ["", "a<|endoftext|> b", "x  \n\t y'll 12345 ", "<|endoftext|>", "é" * 50, "word" * 2000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 128), rng.randrange(0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(60))
              for _ in range(200)]
    texts += ["".join(rng.choice(["a", "B", " ", "\n", "\t", "\u00a0", "\u3000", "1", "'s", ".", "\x1c"]) for _ in range(rng.randint(1, 12)))
              for _ in range(2000)]
    for t in texts:
        assert coder.ids(t).tolist() == own.encode(t, add_special_tokens=False).ids
    own.encode_special_tokens = True
    for t in texts:
        ids = own.encode(t, add_special_tokens=False).ids
        assert coder.plain(t).tolist() == ids and b"".join(coder.token_bytes[i] for i in ids) == t.encode()


# --- alignment ----------------------------------------------------------------------------------------------------------

def groups_of(text):
    """Groups of one text by walking both sides' ends."""
    if not text:
        return []
    own = library()
    own.encode_special_tokens = True
    a = own.encode(" " + text, add_special_tokens=False).ids
    b = sentencepiece.SentencePieceProcessor(model_file=public_path(B)).encode(text)
    a_bytes, b_bytes = byte_coder(public_path(A)).token_bytes, piece_coder(public_path(B)).token_bytes
    if not b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == (" " + text).encode():
        return []
    out, left, right, i, j, x, y = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            left.append(a[i])
            x, i = x + len(a_bytes[a[i]]), i + 1
        else:
            right.append(b[j])
            y, j = y + len(b_bytes[b[j]]), j + 1
        if x == y:
            out, left, right = [*out, (left, right)], [], []
    return out


def aligned(texts):
    """Result columns of each text, by counting all pairs in one place."""
    groups = [groups_of(t) for t in texts]
    links = [[(a, b) for g in gs for a in g[0] for b in g[1]] for gs in groups]
    count = Counter(p for ps in links for p in set(ps))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    said = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs) for gs in groups]
    return [(sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(ps), sum(count[p] == top[p[0]] for p in ps),
             sum(count[p] for p in ps), s, hashlib.sha256(s.encode()).hexdigest() if s else "")
            for gs, ps, s in zip(groups, links, said)]


def test_alignment(docs, rows, empty):  # noqa: F811
    got = alignment.align(docs).collect()
    want = [(r[0], *a) for r, a in zip(rows, aligned([r[1] for r in rows]))]
    assert Counter(map(tuple, got)) == Counter(want)
    assert any(r["n_a"] == 0 for r in got if r["doc_id"] == 0) and alignment.align(empty).count() == 0


def test_alignment_in_parts(docs, rows, monkeypatch):  # noqa: F811
    """Two parts of runs for every radix, as on many bytes; the numbers stay."""
    want = Counter(map(tuple, alignment.align(docs).collect()))
    monkeypatch.setattr(alignment, "GROUP_BYTES", 200)
    assert Counter(map(tuple, alignment.align(docs).collect())) == want


def test_heap_merge_of_many_frames(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 5)
    rng = random.Random(8)
    runs, want = [], Counter()
    for _ in range(40):
        pairs = sorted(rng.sample(range(3000), rng.randint(1, 400)))
        counts = [rng.randint(1, 9) for _ in pairs]
        want.update(dict(zip(pairs, counts)))
        runs.append(alignment.frames_of(np.array(pairs) * 977, np.array(counts)))
    blocks = list(alignment.merged(runs))
    assert len(blocks) > 10
    pair, count = (np.concatenate(c) for c in zip(*blocks))
    assert (np.diff(pair) > 0).all() and dict(zip((pair // 977).tolist(), count.tolist())) == want
    marked = list(alignment.with_best(blocks))
    pair, count, best = (np.concatenate(c) for c in zip(*marked))
    top = {}
    for p, n in zip(pair.tolist(), count.tolist()):
        top[p >> 16] = max(top.get(p >> 16, 0), n)
    assert best.tolist() == [n == top[p >> 16] for p, n in zip(pair.tolist(), count.tolist())]
    assert len(marked) > 10 and list(alignment.merged([])) == [] and list(alignment.with_best([])) == []


def test_records_part_by_part(rows):  # noqa: F811
    aligner = alignment.Aligner(byte_coder(public_path(A)), piece_coder(public_path(B)))
    s = aligner.aligned([r[1] for r in rows] + ["愛" * 300, "ab" * 400])
    whole = [np.concatenate(c) for c in zip(*alignment.records(s, 1 << 40))]
    parts = list(alignment.records(s, 500))
    assert len(parts) > 5
    for part, all_at_once in zip((np.concatenate(c) for c in zip(*parts)), whole):
        assert part.tolist() == all_at_once.tolist()


def test_packed_numbers():
    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([256]), np.array([1 << 40, 3])]
    assert [a.tolist() for a in alignment.unpacked(alignment.packed(*arrays))] == [a.tolist() for a in arrays]


# --- token files --------------------------------------------------------------------------------------------------------

def test_grammar_round_trip():
    rng = random.Random(1)
    for _ in range(200):
        some = [[rng.choice([1, 2, 3, 7]) for _ in range(rng.choice([1, 5, 40, 300]))] if rng.random() < 0.7 else [5] * rng.randint(1, 500)
                for _ in range(rng.randint(1, 9))]
        flat, sizes = np.array(sum(some, []), np.uint16), np.array([len(r) for r in some])
        m = repair.compress(flat, sizes, 9)
        assert repair.expand(m["symbols"], m["left"], m["right"], m["rounds"], 9).tolist() == flat.tolist()
        first = np.cumsum(m["n_symbols"]) - m["n_symbols"]
        for i, row in enumerate(some):
            own = m["symbols"][first[i]:first[i] + m["n_symbols"][i]]
            assert repair.expand(own, m["left"], m["right"], m["rounds"], 9).tolist() == row
            low = rng.randrange(len(row))
            high = rng.randint(low, len(row))
            assert repair.expand_range(own, m["left"], m["right"], m["span"], 9, low, high).tolist() == row[low:high]


def test_grammar_goes_on_until_no_pair_repeats():
    rng = np.random.default_rng(3)
    for _ in range(60):
        # Rare repeats among many symbols: each round replaces few of them.
        rows = [rng.integers(1, 400, rng.integers(1, 300)) for _ in range(4)] + [np.full(7, 5)]
        rows += [rows[0][:9], rows[1][-5:]]
        m = repair.compress(np.concatenate(rows).astype(np.uint16), np.array(list(map(len, rows))), 400)
        cut = np.cumsum(m["n_symbols"])[:-1]
        seen: dict[tuple, int] = {}
        for row in np.split(m["symbols"], cut):
            at = 0
            for at, pair in enumerate(zip(row[:-1].tolist(), row[1:].tolist())):
                # "aaa" holds its pair twice, but only one of them can be replaced.
                if pair[0] != pair[1] or at == 0 or row[at - 1] != pair[0]:
                    seen[pair] = seen.get(pair, 0) + 1
        assert max(seen.values(), default=0) <= 1


def test_grammar_replaces_frequent_pairs():
    phrase = list(range(10, 26))
    flat = np.array(phrase * 64, np.uint16)
    m = repair.compress(flat, np.array([len(flat)]), 30)
    assert len(m["symbols"]) <= 8 and m["span"].max() >= 64 and len(m["rounds"]) > 4
    once = repair.compress(np.arange(20), np.array([20]), 30)
    assert len(once["left"]) == 0 and once["symbols"].tolist() == list(range(20))


def test_files(spark, docs, rows, empty, tmp_path):  # noqa: F811
    own, path = library(), str(tmp_path / "ids")
    repair.write(docs, path, shard_ids=500)
    assert repair.shards(spark, path).count() > 5
    got = repair.read(spark, path).orderBy("start").collect()
    ids = {r[0]: [] for r in rows}
    for i, text, *_ in rows:
        ids[i].append(own.encode(text or "", add_special_tokens=False).ids + [0])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start, held = 0, {i: [] for i in ids}
    for r in got:
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]) // 4)
        held[r["doc_id"]].append(np.frombuffer(r["ids"], "<u4").tolist())
        start += r["n_tokens"]
    assert {i: sorted(v) for i, v in held.items()} == {i: sorted(v) for i, v in ids.items()}
    some = repair.read(spark, path, [19, 3]).collect()
    assert sorted((r["doc_id"], r["start"]) for r in some) == sorted((r["doc_id"], r["start"]) for r in got if r["doc_id"] in (3, 19))
    assert repair.written_and_read(empty).count() == 0


def test_few_ids_open_few_shards(spark, docs, tmp_path):  # noqa: F811
    path = str(tmp_path / "ids")
    repair.write(docs, path, shard_ids=2000)
    plan = repair.read(spark, path, [19])._jdf.queryExecution().toString()
    assert "first_doc" in plan.split("PushedFilters")[1] or "Filter" in plan
    assert repair.read(spark, path, [10 ** 9]).count() == 0


def test_token_file_query(spark, sf_dir):
    own = library()
    want, start = [], 0
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = np.array(own.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op12_repair"](spark, sf_dir).collect())) == want


# --- ranked search ------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows, items, k):  # noqa: F811
    """All scores of all pairs, in whole numbers."""
    split = [(i, TERM.findall((t or "").translate(FOLD))) for i, t in rows]
    n, words = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(FOLD))
        scores = []
        for i, w in split:
            tf, m = Counter(w), 75 + 25 * len(w) * n // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t in asked if tf[t])
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def items(spark):
    asked = [(1, "GNU general public license of the und and"), (2, None), (3, "..."), (4, "der die das and und der DER"), (5, "nowhere found"),
             (6, "x's 12 été"), (7, "released under the mit license"), (7, "base nul gap"), (None, "on of the"), (8, "a b a b")]
    return asked, spark.createDataFrame([(*a, "clash", 1) for a in asked], "item_id long, text string, doc_id string, score int")


@pytest.mark.parametrize("k", [1, 3, 20])
def test_ranked_search(docs, rows, empty, items, k, monkeypatch):  # noqa: F811
    monkeypatch.setattr(dual_tree, "CHUNK", (7, 1 << 20))
    asked, table = items
    got = dual_tree.rank(docs, table, k).collect()
    assert Counter(map(tuple, got)) == Counter(ranked([r[:2] for r in rows], asked, k))


def test_ranked_search_of_nothing(docs, empty, items):  # noqa: F811
    _, table = items
    assert dual_tree.rank(empty, table).count() == 0 and dual_tree.rank(docs, table.limit(0)).count() == 0


def test_item_blocks(docs, rows, items, monkeypatch):  # noqa: F811
    asked, table = items
    monkeypatch.setattr(dual_tree, "CELLS", 12)
    assert len(list(dual_tree._blocks((i, (t or "").encode()) for i, t in asked))) > 3
    assert Counter(map(tuple, dual_tree.rank(docs, table, 4).collect())) == Counter(ranked([r[:2] for r in rows], asked, 4))


def test_bounds_prune_and_lose_nothing():
    """Clustered documents: most pairs are never scored, and the best are those of all pairs, in doubles and whole numbers."""
    rng = np.random.default_rng(6)
    n_docs, n_items, n_terms, k = 2000, 40, 400, 5
    theme = rng.integers(0, 20, n_docs)
    impact = np.zeros((n_docs, n_terms), np.int64)
    for d in range(n_docs):
        at = np.append(rng.integers(0, 20, 6) + 20 * theme[d], rng.integers(0, n_terms, 3))
        impact[d, at] = rng.integers(1, 10 ** 6, len(at))
    for scale in (1, 10 ** 4):
        weights = np.zeros((n_items, n_terms), np.int64)
        for i in range(n_items):
            weights[i, rng.integers(0, 20, 5) + 20 * (i % 20)] = rng.integers(1, 9000, 5) * scale
        rows = weights.astype(float) if scale == 1 else weights
        state = dual_tree.Search(dual_tree.item_tree(rows), k, np.zeros(n_items, np.int64))
        d, t = np.nonzero(impact)
        state.chunk(list(range(n_docs)), d, t, impact[d, t], n_terms)
        scores = weights @ impact.T
        want = sorted((i, int(x), int(scores[i, x])) for i in range(n_items)
                      for x in sorted(range(n_docs), key=lambda x: (-scores[i, x], x))[:k] if scores[i, x] > 0)
        assert sorted(zip(*state.found().to_pydict().values())) == want
        assert state.scored < n_docs * n_items / 8 and state.bounds < n_docs * n_items / 2


def test_long_rows_do_not_overflow():
    n = np.array([1, 10 ** 12], np.int64)
    assert dual_tree.lengths_factor(n, 10 ** 9, 10 ** 13).tolist() == [75, 75 + 25 * 10 ** 21 // 10 ** 13]


def test_search_oracle(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    want = con.sql(ORACLES["op13_dual_tree"]).fetchall()
    assert sorted(map(tuple, QUERIES["op13_dual_tree"](spark, sf_dir).collect())) == sorted(want)


def test_alignment_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = [(r["doc_id"], *a[:6], a[7]) for r, a in zip(table, aligned([r["text"] for r in table]))]
    assert sorted(map(tuple, QUERIES["op11_align"](spark, sf_dir).collect())) == sorted(want)
