"""The training-text operators on difficult rows, empty tables and against brute force, and the queries against their SQL."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib
from urllib.parse import unquote

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from visitledger.llm import (
    chunk_bpe, context_tree, exact_dedup, language, license_scan, ngram_join, packing, sharding, suffix_dedup, vector_dedup)
from visitledger.llm.byte_tokens import byte_coder, public_path
from visitledger.llm.components import components
from visitledger.llm.queries import ORACLES, QUERIES
from visitledger.llm.tokens import WordIds, default_vocabulary

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, seen long, key string, block int, size int, "
          "component string, words string, n long")
WORDS = "der die das und on the of and license gnu für ños été , . 12 x's <|endoftext|> <| K İ é".split()


def texts() -> list[tuple]:
    """Rows with nulls in any column, empty and long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(3)

    def prose(n):
        return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "") for _ in range(n))

    base, passage = prose(120), prose(90)
    near = base.split()
    near[60] = "changed"
    bodies = [
        None, "", " ", "\n\t ", "...", "a", "a b", "A  b", base, base, base.replace(" ", "  "), " ".join(near), base.upper(),
        prose(300) + " " + passage, passage + " " + prose(50), "ab" * 700, "ab" * 700 + "c", "x" * 3000, prose(20_000),
        "Released under the MIT License. GNU general\npublic license, cc-by; cc by cc by", "no\x00nul \x1c sep   gap",
        "Licensed under the Apache License, Version 2.0", "permission is granted free of charge to any person obtaining a copy "
        "of this software hereby", *(prose(rng.randint(1, 60)) for _ in range(30)),
    ]
    rows = [(i, t, ("de", "en", None)[i % 3], None if i % 5 == 0 else "s", None if i % 7 == 0 else 1) for i, t in enumerate(bodies)]
    rows += [rows[8], rows[8], rows[1], (None, base, "en", "s", 1), (None, None, None, None, None), (3, "another text", "en", "s", 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([(*r, 1, None, 2, None, "c", None, 5) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, rows):
    """Result rows of the ids that occur once, by id."""
    ids = [r[0] for r in rows]
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None and ids.count(r["doc_id"]) == 1}


def single(rows):
    ids = [r[0] for r in rows]
    return {r[0]: (r[1] or "") for r in rows if r[0] is not None and ids.count(r[0]) == 1}


def test_shards(docs, rows, empty):
    out = sharding.shard_by_bytes(docs, 4).orderBy("shard", "slot").collect()
    assert len(out) == len(rows) and sharding.shard_by_bytes(empty).count() == 0
    assert [r["doc_id"] for r in out if r["doc_id"] is not None] == sorted(r[0] for r in rows if r[0] is not None)
    for shard, group in itertools.groupby(out, lambda r: r["shard"]):
        assert [r["slot"] for r in group] == list(range(sum(r["shard"] == shard for r in out)))
    for i, text in single(rows).items():
        row = next(r for r in out if r["doc_id"] == i)
        assert (row["size"], row["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))


def test_exact(docs, rows, empty):
    out = exact_dedup.exact_duplicates(docs).collect()
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest())
                  for t, g in groups.items() for i in g)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups) and exact_dedup.exact_duplicates(empty).count() == 0


def test_trie_spills(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    trie = exact_dedup.Trie()
    for i, key in enumerate(keys):
        trie.insert(key, (i, i), 1)
    got = sorted(trie.entries())
    assert got == sorted((k, (keys.index(k),) * 2, keys.count(k)) for k in set(keys))
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 0)
    ordered = sorted(keys)
    batch = pa.RecordBatch.from_arrays([
        pa.array([len(k) for k in ordered]), pa.array([hash(k) for k in ordered]), pa.array(ordered, pa.binary()),
        pa.array(range(400)), pa.array(range(400)), pa.array([1] * 400)], schema=exact_dedup.PARTIAL)
    assert sum(b.num_rows for b in exact_dedup._own([batch])) == len(set(keys))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near(docs, rows, empty):
    out = ngram_join.grouped(docs).collect()
    sets = [shingles(r[1] or "") for r in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    smallest = {x: min((rows[k][0] for k in range(len(rows)) if label[k] == x and rows[k][0] is not None), default=None) for x in label}
    want = sorted((str(r[0]), len(s), str(smallest[x] if s else r[0])) for r, s, x in zip(rows, sets, label))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == want
    assert sum(r["kept"] for r in out) == len({x for x, s in zip(label, sets) if s}) + sum(not s for s in sets)
    assert ngram_join.near_duplicates(empty).count() == 0


def test_near_groups_around_a_base(spark):
    """Variants that link with their base only, and with each other only through it."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    bodies = [" ".join(base)]
    for _ in range(60):
        own = list(base)
        for k in rng.sample(range(100), rng.randint(1, 4)):
            own[k] = f"v{rng.randint(0, 10**9)}"
        bodies.append(" ".join(own))
    sets = [shingles(b) for b in bodies]
    label = list(range(len(bodies)))
    for i, j in itertools.combinations(range(len(bodies)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    frame = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(frame).collect()}
    assert got == {i: min(j for j in range(len(bodies)) if label[j] == x) for i, x in enumerate(label)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (200, 201)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(bodies, length):
    places: dict[bytes, int] = {}
    for t in bodies:
        for i in range(len(t) - length + 1):
            places[t[i:i + length]] = places.get(t[i:i + length], 0) + 1
    out = []
    for t in bodies:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if places[t[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.diff(gone.astype(int), prepend=0)
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(
            bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_repeats(docs, rows, empty):
    out = suffix_dedup.remove_repeats(docs).collect()
    want = brute_repeats([(r[1] or "").encode() for r in rows], 400)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == sorted(
        (str(r[0]), *w) for r, w in zip(rows, want))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_of_frequent_anchors(spark, monkeypatch):
    """Fine cuts give the same result as whole regions."""
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdef ") for _ in range(900))
    bodies = []
    for _ in range(60):
        a, b = sorted(rng.sample(range(900), 2))
        bodies.append("".join(rng.choice("ghij") for _ in range(rng.randint(0, 300))) + shared[a:b])
    want = brute_repeats([b.encode() for b in bodies], 400)
    for finer in (((2, 64),), ((2, 64), (4, 1))):
        cutter = suffix_dedup._regions
        monkeypatch.setattr(suffix_dedup, "FINER", finer)
        monkeypatch.setattr(suffix_dedup, "_regions", lambda n, c=cutter, f=finer: _with_finer(c, n, f))
        frame = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(3)
        got = suffix_dedup.remove_repeats(frame).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == want
        monkeypatch.undo()


def test_copies_of_regions_are_one_row(spark, tmp_path, monkeypatch):
    """Cuts of a frequent anchor are made once for all copies of a region, so no table of spans or pieces grows with copies."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(700))
    bodies = [passage] * 40 + [str(i) + passage + str(i) for i in range(5)]
    monkeypatch.setattr(suffix_dedup, "FINER", ((2, 64), (4, 1)))
    seen, write = {}, suffix_dedup.kept
    monkeypatch.setattr(suffix_dedup, "kept", lambda df, label, *more: seen.setdefault(label, write(df, label, *more)))
    frame = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_repeats(frame).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats([b.encode() for b in bodies], 400)
    ids = seen["repeat-regions"].select(F.explode("ids").alias("id")).distinct().count()
    assert seen["repeat-spans"].select("id").distinct().count() <= ids < 60
    assert seen["repeat-spans"].count() <= 400 * ids


def _with_finer(cutter, length, finer):
    def cut(batches):
        suffix_dedup.FINER, before = finer, suffix_dedup.FINER
        try:
            yield from cutter(length)(batches)
        finally:
            suffix_dedup.FINER = before
    return cut


def test_suffix_arrays_merge(monkeypatch):
    rng = random.Random(1)
    for bound in (1 << 22, 300):
        monkeypatch.setattr(suffix_dedup, "SORT_BYTES", bound)
        for _ in range(40):
            length = rng.choice([12, 20, 33, 40])
            base = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(length, 120))) for _ in range(4)]
            regions = list({(rng.choice(base) + rng.choice(base))[rng.randint(0, 20):][:rng.randint(length, 100)] for _ in range(20)})
            regions = [r for r in regions if len(r) >= length]
            seen: dict[bytes, int] = {}
            for r in regions:
                for i in range(len(r) - length + 1):
                    seen[r[i:i + length]] = seen.get(r[i:i + length], 0) + 1
            got = suffix_dedup.repeated_windows(regions, [False] * len(regions), length)
            assert all(list(f) == [seen[r[i:i + length]] > 1 for i in range(len(f))] for r, f in zip(regions, got))


def test_induced_arrays():
    """Regions met by their anchors: the marks of brute force, a shard's own, whatever the bytes and the order."""
    rng = random.Random(5)
    for _ in range(150):
        length, core, met = rng.choice([12, 20, 33]), rng.choice([1, 4, 8]), {}
        for shard in range(-2, rng.randint(-1, 2)):
            sides = [bytes(rng.choice(b"ab\0\xff") for _ in range(length)) for _ in range(3)]
            name = bytes([65 + shard]) + bytes(rng.choice(b"xy") for _ in range(core - 1))
            for _ in range(rng.randint(1, 9)):
                left, right = bytearray(rng.choice(sides)), bytearray(rng.choice(sides))
                left[rng.randrange(length)] = right[rng.randrange(length)] = rng.choice(b"ab")
                place = rng.randint(0, length - core)
                after = rng.randint(length - core - place, length - core)
                met[bytes(left[length - place:]) + name + bytes(right[:after]), place, shard] = None
        regions, places, shards = zip(*rng.sample(list(met), len(met)))
        seen: dict[tuple, int] = {}
        for r, p, s in zip(regions, places, shards):
            for i in range(len(r) - length + 1):
                seen[s, p - i, r[i:i + length]] = seen.get((s, p - i, r[i:i + length]), 0) + 1
        several = [rng.random() < 0.1 for _ in regions]
        got = suffix_dedup.induced_windows(list(regions), several, list(shards), list(places), length)
        assert all(list(f) == [again or seen[s, p - i, r[i:i + length]] > 1 for i in range(len(f))]
                   for r, p, s, f, again in zip(regions, places, shards, got, several))


def test_near_copies_of_regions_cost_little():
    """Regions that share most of their bytes are marked in a fraction of the time that sorting all their suffixes takes."""
    rng, rows = np.random.default_rng(3), []
    for shard in range(600):
        base = rng.integers(97, 123, 540).astype(np.uint8)
        for k in range(3):
            own = base.copy()
            own[rng.integers(0, 140 if k else 540)] = 65 + k
            rows.append((shard, own.tobytes()))
    table = pa.table({
        "id": range(len(rows)), "at": [0] * len(rows), "shard": [s for s, _ in rows], "piece": range(len(rows)),
        "place": [140] * len(rows), "raw": [r for _, r in rows], "copies": [1] * len(rows)})
    began = time.process_time()
    got = dict(zip(*suffix_dedup._marker(400)(table).to_pydict().values()))
    took, began = time.process_time() - began, time.process_time()
    flags = suffix_dedup.repeated_windows([r for _, r in rows], [False] * len(rows), 400)
    assert got == {i: suffix_dedup.runs(f, 400) for i, f in enumerate(flags) if f.any()}
    assert 3 * took < time.process_time() - began


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_vocabulary())


def test_words_share_pieces(tokenizer, monkeypatch):
    """Columns of texts get the library's ids, and what words share goes to the library once."""
    rng = random.Random(7)
    some = [chr(i) for i in (*range(0x21, 0x250), *range(0x300, 0x310), *range(0x2000, 0x2060), 0x4E2D, 0x1F642)]
    bodies = ["".join(rng.choices([*some, *"'stlvedm  "], k=rng.randint(0, 40))) for _ in range(3000)]
    bodies += [f"a{c}B{c} {c}" for c in some] + ["", " ", "I'll they'RE'S <|endoftext|>x", "a\x1cb\x85c\u00a0d"]
    raw = [b.encode() for b in bodies] + [b"\xff a\xc3", b"\xe2\x80 b"]
    words = WordIds(default_vocabulary())
    ids, ends = words.rows(pa.array(raw, pa.binary()))
    want = [tokenizer.encode(r.decode("utf-8", "replace"), add_special_tokens=False).ids for r in raw]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    words.learn(set(raw[0].split()) | {b"House,"})
    assert words.known[b"House,"] == np.array(tokenizer.encode("House,", add_special_tokens=False).ids, "<u2").tobytes()
    sent, merger = [], words.merger
    monkeypatch.setattr(words, "merger", type("Counted", (), {
        "encode_batch_fast": staticmethod(lambda t, **more: sent.extend(t) or merger.encode_batch_fast(t, **more))}))
    words.learn({b"house;", b"HOUSE.", b"(house)", b"Gartenzaun?", b"gartenzaun!"})
    assert " ".join(sent).split().count("gartenzaun") == 1 and "house" not in " ".join(sent).split()


def test_units_of_byte_level_texts():
    """Whole columns get the ids that single texts have."""
    rng = random.Random(8)
    parts = [*"abcd'st.,019é中ß🙂", *[" x", "\ny", " 'll", "\n.", " don't", " "] * 3]
    more = [*parts, "\t", "  ", "\n", "\x01", "\x85", "<|endoftext|>"]
    raw = ["".join(rng.choices((parts, more)[k % 2], k=rng.randint(0, 20))).encode() for k in range(2000)]
    raw += [b"", b" ", b"\n", b"a ", b" a", b"\xff a"]
    coder = byte_coder(public_path("byte_bpe_50k.json"))
    ids, ends = coder.rows(pa.array(raw, pa.binary()))
    assert all(map(np.array_equal, np.split(ids, ends[:-1]), [coder.ids(r.decode("utf-8", "replace")) for r in raw]))
    assert [len(x) for x in coder.rows(pa.array([], pa.binary()))] == [0, 0]


def test_chunks(docs, rows, empty, tokenizer):
    out = by_id(chunk_bpe.encode_and_decode(docs), rows)
    for i, text in single(rows).items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert out[i]["ids"] == ids and out[i]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert chunk_bpe.encode_and_decode(empty).count() == 0


def test_pack(docs, rows, empty, tokenizer):
    out = packing.pack(docs, window=64).collect()
    place = 0
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 64 + r["offset"] == place and r["offset"] + r["length"] <= 64
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        place += r["length"]
    for i, text in single(rows).items():
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(r["ids"] for r in own) == ids.tobytes() and {r["doc_tokens"] for r in own} == {len(ids)}
    assert packing.pack(empty).count() == 0


def test_licences(docs, rows, empty):
    out = by_id(license_scan.scan(docs), rows)
    for i, text in single(rows).items():
        words = re.findall(license_scan.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        hits = sorted((k, label) for phrase, label in license_scan.PHRASES for k in range(len(words))
                      if words[k:k + len(phrase.split())] == phrase.split())
        base = sorted({label for _, label in hits})
        own = {label for label, t in license_scan.TEMPLATES for block in re.split(license_scan.BLOCK_END, text)
               if len(set(t.split()) & set(re.findall(license_scan.WORD, block.lower()))) >= 0.8 * len(set(t.split())) - 1e-9}
        got = out[i]
        assert got["n_words"] == len(words) and got["n_base"] == len(hits)
        assert (got["first_word"], got["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert got["base_labels"] == ",".join(base) and got["labels"] == ",".join(sorted({*base, *own}))
    assert license_scan.scan(empty).count() == 0


def test_language(spark, docs, rows, empty):
    model = language.fit(docs, F.lit(True))
    out = language.identify(docs, model, carry={"seen": F.col("seen")}).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    told = {r["doc_id"]: r["lang_pred"] for r in out}
    assert all(told[i] == "und" for i in (0, 2, 4)) and told[5] in ("de", "en")
    assert language.identify(empty, language.fit(empty, F.lit(True))).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(empty, F.lit(True))).collect()} == {"und"}


def test_tree(docs, rows, empty):
    out = context_tree.score_texts(docs, F.col("doc_id") % 3 != 0, depth=2)
    learned = [r[1] or "" for r in rows if r[0] is not None and r[0] % 3]
    counts: dict = {}

    def path(text):
        data = b"\0\0" + text.encode() + b"\0"
        for i in range(2, len(data)):
            place = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield [(data[i - d:i], place) for d in range(3)], bit
                place = 2 * place + bit

    for text in learned:
        for nodes, bit in path(text):
            for node in nodes:
                counts.setdefault(node, [0, 0])[bit] += 1

    def kt(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    weight, below = {}, {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        total = kt(node) if len(node[0]) == 2 else np.logaddexp(kt(node), below[node]) - math.log(2)
        weight[node] = 1.0 if len(node[0]) == 2 else math.exp(kt(node) - math.log(2) - total)
        if node[0]:
            up = (node[0][1:], node[1])
            below[up] = below.get(up, 0) + total

    def score(text):
        out = 0.0
        for nodes, bit in path(text):
            p = None
            for node in reversed(nodes):
                if node in counts:
                    own = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
                    p = own if p is None else weight[node] * own + (1 - weight[node]) * p
            p = 0.5 if p is None else p
            out += math.log10(p if bit else 1 - p)
        return out

    got = by_id(out, rows)
    for i, text in single(rows).items():
        if len(text) < 2000:
            assert got[i]["score"] == pytest.approx(score(text), rel=1e-7, abs=1e-7)
    assert context_tree.score_texts(empty, F.lit(True)).count() == 0
    none = by_id(context_tree.score_texts(docs, F.lit(False)), rows)
    assert none[5]["score"] == pytest.approx(16 * math.log10(0.5)) and none[5]["train_tokens"] == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = np.concatenate([base[:60] + 0.05 * rng.normal(size=(60, 16)) for _ in range(3)])
    vectors = [*base.tolist(), *near.tolist(), *base[:5].tolist(), (2 * base[6]).tolist()]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    frame = spark.createDataFrame(
        [(i, v, 1, 2, 3) for i, v in enumerate([*vectors, *bad])],
        "vec_id long, embedding array<double>, label int, node int, list int").repartition(3)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(frame).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= linked.sum(axis=1)).all() and links.sum() >= 0.9 * linked.sum()
    n = len(x)
    assert [got[n + k]["n_links"] for k in range(8)] == [0] * 6 + [1, 1] and got[n + 7]["component_id"] == n + 6
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values()) and not got[300]["kept"]
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    """A list above the block size is verified block by block, with the same result."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=8) + 0.02 * rng.normal(size=(90, 8)), rng.normal(size=(300, 8))])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    whole = {r["vec_id"]: tuple(r) for r in vector_dedup.near_vectors(frame).collect()}
    monkeypatch.setattr(vector_dedup, "BLOCK", 20)
    assert {r["vec_id"]: tuple(r) for r in vector_dedup.near_vectors(frame).collect()} == whole
    assert sum(whole[i][1] for i in range(90)) >= 0.9 * 90 * 89 and {whole[i][2] for i in range(90)} == {0}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    order = list(want.columns)
    assert got.sort_values(order).astype(str).values.tolist() == want.sort_values(order).astype(str).values.tolist()


def test_language_held_out(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in QUERIES["op10_language_id"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0


def test_pipeline(spark, docs, rows):
    """Each stage's decisions, one after the other."""
    stages, at = dict(corpus_pipeline.STAGES), docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert list(stages) == ["language", "exact", "near", "repeats", "pack"]

    def step(name):
        nonlocal at
        at = corpus_pipeline.kept(stages[name](spark, at, ""), name)
        return [(r[0], r["text"] if "text" in at.columns else None) for r in at.collect()]

    worded = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(str, step("language"))) == sorted(map(str, worded))
    exact = step("exact")
    assert len(exact) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in worded})
    near = step("near")
    assert {i for i, _ in exact} - {i for i, _ in near} == {11, 12} or len(near) <= len(exact)
    cut = step("repeats")
    want = brute_repeats([t.encode() for _, t in near], 400)
    assert {i for i, _ in cut} >= {i for (i, _), w in zip(near, want) if not w[1]}
    assert sum(len(t) for _, t in cut) < sum(len(t) for _, t in near)
    assert len({i for i, _ in step("pack")}) == len({i for i, _ in cut})


def brute_language(learned, texts):
    """Language and score of each text by the whole counts of words and n-grams of `(lang, text)` rows."""
    tables = [{} for _ in range(5)]
    for lang, text in learned:
        for word in language.words_of(text.encode()):
            for k in range(5):
                for token in language.grams_of(word.decode("utf-8", "replace"), k) if k else [word]:
                    own = tables[k].setdefault(token, {})
                    own[lang] = own.get(lang, 0) + 1
    langs = sorted({lang for lang, text in learned if language.words_of(text.encode())})
    totals = [[sum(x.get(lang, 0) for x in table.values()) for lang in langs] for table in tables]

    def logs(k, token):
        return np.array([math.log((tables[k][token].get(lang, 0) + 0.1) / (totals[k][i] + 0.1 * (len(tables[k]) + 1)))
                         for i, lang in enumerate(langs)])

    def word_score(word):
        if word in tables[0]:
            return logs(0, word)
        for k in range(4, 0, -1):
            if hits := [logs(k, g) for g in language.grams_of(word.decode("utf-8", "replace"), k) if g in tables[k]]:
                return np.mean(hits, axis=0)
        return np.zeros(len(langs))

    out = []
    for text in texts:
        words = language.words_of(text.encode())
        if not langs or not language.has_letter(words):
            out.append(("und", 0.0))
            continue
        score = sum(map(word_score, words))
        out.append((langs[int(score.argmax())], float(1 / np.exp(np.maximum(score - score.max(), -700)).sum())))
    return out


@pytest.mark.parametrize("cells", [0, 60, 800_000])
def test_language_against_brute_force(spark, docs, rows, monkeypatch, cells):
    """The same result whatever part of the words the tasks hold."""
    monkeypatch.setattr(language, "HELD_CELLS", cells, raising=False)
    model = language.fit(docs, F.coalesce(F.col("doc_id") % 4 != 1, F.lit(False)))
    got = by_id(language.identify(docs, model), rows)
    learned = [(r[2], r[1] or "") for r in rows if r[2] and r[0] is not None and r[0] % 4 != 1]
    want = brute_language(learned, single(rows).values())
    assert len(got) == len(want)
    for i, (lang, score) in zip(single(rows), want):
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, rel=1e-6, abs=1e-9)


def test_language_keeps_rare_words(spark):
    """Words beyond the 30,000 most frequent ones of a language count, in each language that has them."""
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(70_000)]
    names = list(dict.fromkeys(names))[:62_000]
    often, rare = names[:31_000], names[31_000:]
    learned = [("de", " ".join(often + often + rare)), ("en", " ".join(names[:2000] * 30 + rare[:500] * 2))]
    asked = [" ".join(rare[k:k + 40]) for k in (0, 300, 480, 20_000)] + [" ".join(names[5:9]), rare[3], rare[900], "zzzabcq " + rare[7]]
    frame = spark.createDataFrame(
        [(i, lang, text) for i, (lang, text) in enumerate(learned)] + [(10 + i, None, t) for i, t in enumerate(asked)],
        "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in language.identify(frame, language.fit(frame, F.lit(True))).collect()}
    for i, (lang, score) in enumerate(brute_language(learned, asked)):
        assert got[10 + i]["lang_pred"] == lang and got[10 + i]["score"] == pytest.approx(score, rel=1e-6)


def test_wrapped_licences(spark):
    """Notices count however their lines are wrapped, not across a blank line or a sentence end."""
    bsd = ("Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that")
    gpl = ("you can redistribute it and/or modify", "it under the terms of the GNU General Public License")
    bodies = [
        "\n".join(bsd), "\n".join(gpl), "\r\n".join(bsd), " * " + "\n * ".join(bsd), "\n".join(" ".join(bsd).split()),
        "\n\n".join(bsd), ".\n".join(bsd), "\n \t\r\n".join(bsd), " ".join(bsd)]
    frame = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(frame).collect()}
    assert [got[i]["labels"] for i in range(9)] == ["bsd", "gpl,gpl-notice", "bsd", "bsd", "bsd", "", "", "", "bsd"]
    assert [got[i]["score"] for i in (0, 1, 5)] == [1.0, 1.0, 0.0]


def test_pipeline_without_labels(spark, docs, rows):
    """Documents with letters pass the language stage when nothing can be learned, and whatever their language is called."""
    stage, worded = dict(corpus_pipeline.STAGES)["language"], sorted(str(r[0]) for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    for label in (F.lit(None).cast("string"), F.lit("und")):
        told = stage(spark, docs.select("doc_id", "text", label.alias("lang"), "source", "n_chars"), "")
        assert sorted(str(r["doc_id"]) for r in told.collect()) == worded


def test_pipeline_tables_leave_the_disk(spark, docs, monkeypatch):
    """No stage keeps the texts beside its result, and what the near stage made on the way goes when nothing reads it any more."""
    tables = []
    for module in (language, ngram_join):
        monkeypatch.setattr(module, "kept", lambda df, label, *more, write=module.kept: tables.append(
            (label, write(df, label, *more))) or tables[-1][1])
    stages, at = dict(corpus_pipeline.STAGES), docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name in ("language", "exact", "near"):
        at = corpus_pipeline.kept(stages[name](spark, at, ""), name)
    assert at.count() > 0
    held = dict(tables)
    assert not any("text" in json.dumps(df.schema.jsonValue()) for _, df in tables)
    folders = {label: unquote(df.inputFiles()[0].rpartition("/")[0]) for label, df in tables if label.startswith("ngram-") and df.inputFiles()}
    assert spark.read.parquet(folders.pop("ngram-sets")).count() == held["ngram-sets"].count() > 0
    assert {"ngram-shared", "ngram-postings", "ngram-counted", "ngram-segments", "ngram-prefix"} <= set(folders)
    assert all(spark.read.schema(held[label].schema).parquet(path).isEmpty() for label, path in folders.items())
