"""Word-first language identification with n-gram backoff.

Each language has a table of its words and one of character n-grams (4 down to 1). A known word scores its log frequency in
every language; an unseen word scores the mean of its longest known n-grams. Both tables are counted over all learning rows
and stay whole, as tables in the shared folder. Tasks hold the most frequent words only, each with its counts in all
languages; a text's other words are joined with the tables, so what the tasks hold changes no result.

Defined results: a text that is null or has no letter is `und` with score 0; so is any text when nothing can be learned.
Equal scores go to the first language by name. Repeated rows are predicted each, an empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from visitledger.llm.common import kept, slices, text_bytes

UNKNOWN = "und"
LONGEST = 4
#: Bytes that separate words: everything in ASCII but letters; letters are lower-cased before.
LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("token", pa.binary()), ("n", pa.int64())])
GRAMS = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("token", pa.string()), ("n", pa.int64())])
HITS = pa.schema([("word", pa.binary()), ("token", pa.string()), ("n", pa.int64())])
#: Words times languages that a task holds.
HELD_CELLS = 800_000
SMOOTH = 0.1


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split()


def has_letter(words: list[bytes]) -> bool:
    return any(w[0] < 128 for w in words) or any(c.isalpha() for w in words for c in w.decode("utf-8", "replace"))


def grams_of(word: str, n: int) -> list[str]:
    framed = f" {word} " if n > 1 else word
    return [framed[i:i + n] for i in range(len(framed) - n + 1)]


def _flushed(schema, tables):
    for lang, counter in tables.items():
        items = list(counter.items())
        for start in range(0, len(items), 50_000):
            some = items[start:start + 50_000]
            keys = zip(*(k if isinstance(k, tuple) else (k,) for k, _ in some))
            columns = [[lang] * len(some), *map(list, keys), [n for _, n in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    tables.clear()


def _count_words(batches):
    tables: dict[str, Counter] = defaultdict(Counter)
    for part in slices(batches):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            tables[lang].update(words_of(text))
        if sum(map(len, tables.values())) > 400_000:
            yield from _flushed(COUNTED, tables)
    yield from _flushed(COUNTED, tables)


def _count_grams(batches):
    tables: dict[str, Counter] = defaultdict(Counter)
    for part in slices(batches, 20_000):
        for lang, word, n in zip(*(c.to_pylist() for c in part.columns)):
            table, text = tables[lang], word.decode("utf-8", "replace")
            for length in range(1, LONGEST + 1):
                for gram in grams_of(text, length):
                    table[length, gram] += n
        if sum(map(len, tables.values())) > 400_000:
            yield from _flushed(GRAMS, tables)
    yield from _flushed(GRAMS, tables)


@dataclass
class Model:
    """Whole tables of words and n-grams, `(token, found: [(at, n)])` with places in `langs`, and what a task holds.

    Row k of `floors` is the log frequency of what a language has not: of a word for k = 0, else of an n-gram of length k.
    """

    langs: list[str]
    floors: np.ndarray
    held: Broadcast
    words: DataFrame
    grams: DataFrame


_held: dict[str, tuple] = {}


def _scorer(held: Broadcast):
    def score(batches):
        key, found, table = held.value
        if key not in _held:
            _held.clear()
            _held[key] = {word: i + 1 for i, word in enumerate(found)}
        known = _held[key]
        for part in slices(batches):
            lettered, scores, words, counts = [], [], [], []
            for text in part.column(part.num_columns - 1).to_pylist():
                own = words_of(text)
                lettered.append(has_letter(own))
                rest = {}
                if lettered[-1] and table.shape[1]:
                    rows = np.fromiter(map(known.get, own, repeat(0)), np.int64, len(own))
                    scores.append(table[rows].sum(axis=0))
                    rest = Counter(own[i] for i in np.flatnonzero(rows == 0))
                else:
                    scores.append(np.zeros(table.shape[1]))
                words.append(list(rest))
                counts.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays([
                *part.columns[:-1], pa.array(lettered, pa.bool_()), pa.array(scores, pa.list_(pa.float64())),
                pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))],
                names=[*part.schema.names[:-1], "lettered", "held", "words", "counts"])

    return score


def _predictor(langs: list[str], floors: np.ndarray):
    def predict(batches):
        for part in slices(batches, 10_000):
            lettered, held, rest = part.columns[-3:]
            score = pc.list_flatten(held).to_numpy(zero_copy_only=False).reshape(part.num_rows, len(langs)).copy()
            at, total = pc.list_flatten(rest).flatten()
            row, at = pc.list_parent_indices(rest).to_numpy(), at.to_numpy()
            total, kinds = total.to_numpy(), np.zeros((part.num_rows, len(floors)))
            kinds[row[at < 0], -1 - at[at < 0]] = total[at < 0]
            score[row[at >= 0], at[at >= 0]] += total[at >= 0]
            for kind, floor in enumerate(floors):
                score += kinds[:, kind, None] * floor
            told = lettered.to_numpy(zero_copy_only=False)
            best = score.argmax(axis=1)
            sure = 1 / np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -700.0)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([
                part.column(0), lettered, pa.array([langs[b] if t else UNKNOWN for b, t in zip(best, told)], pa.string()),
                pa.array(np.where(told, sure, 0.0))], names=["row", "lettered", "lang_pred", "score"])

    return predict


def _hits_of(length: int):
    def hits(batches):
        for part in slices(batches, 20_000):
            out = [(word, gram, n) for word in part.column(0).to_pylist()
                   for gram, n in Counter(grams_of(word.decode("utf-8", "replace"), length)).items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([], [], []), HITS)], schema=HITS)

    return hits


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of the rows where `learn` holds and the language is known."""
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("text"))
    counted = kept(
        rows.mapInArrow(_count_words, "lang string, token binary, n long").groupBy("lang", "token").agg(F.sum("n").alias("n")),
        "language-words", "zstd")
    gram_counts = kept(
        counted.mapInArrow(_count_grams, "lang string, length int, token string, n long")
        .groupBy("lang", "length", "token").agg(F.sum("n").alias("n")), "language-grams", "zstd")

    totals = {(0, r["lang"]): r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals |= {(r["length"], r["lang"]): r["n"] for r in gram_counts.groupBy("length", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    places = F.broadcast(spark.createDataFrame(list(zip(langs, range(len(langs)))), "lang string, at int"))

    def by_token(df, *keys):
        return df.join(places, "lang").groupBy(*keys, "token").agg(
            F.collect_list(F.struct("at", "n")).alias("found"), F.sum("n").alias("total"))

    words = kept(by_token(counted), "language-model-words", "zstd")
    grams = kept(by_token(gram_counts, "length"), "language-model-grams", "zstd")
    distinct = {r["length"]: r["n"] for r in grams.groupBy("length").agg(F.count("*").alias("n")).collect()} | {0: words.count()}
    floors = np.array([[
        np.log(SMOOTH / (totals.get((kind, lang), 0) + SMOOTH * (distinct.get(kind, 0) + 1))) for lang in langs]
        for kind in range(LONGEST + 1)])

    # Words from the smallest total on that leaves no more than fit: counted in steps of an eighth of a power of two.
    step, room, least = F.floor(8 * F.log2("total")), HELD_CELLS // max(1, len(langs)), None
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if (room := room - r["n"]) < 0:
            break
        least = r["step"]
    is_held = step >= least if least is not None else F.lit(False)
    # As Arrow columns: a row object for each word would be most of the driver's memory.
    held = words.where(is_held).select("token", F.col("found.at").alias("at"), F.col("found.n").alias("n")).toArrow().combine_chunks()
    at, n = (held.column(c).combine_chunks() for c in ("at", "n"))
    table = np.zeros((held.num_rows + 1, len(langs)))
    table[1:] = floors[0]
    row, lang = pc.list_parent_indices(at).to_numpy() + 1, pc.list_flatten(at).to_numpy()
    table[row, lang] += np.log(pc.list_flatten(n).to_numpy() + SMOOTH) - np.log(SMOOTH)
    value = uuid.uuid4().hex, held.column("token").to_pylist(), table
    return Model(langs, floors, spark.sparkContext.broadcast(value), words.where(~is_held), grams)


def _total(values: Column) -> Column:
    """Sum that does not depend on the order of the rows."""
    return F.sum(values.cast("decimal(28,15)")).cast("double")


def _above(found: str, times: Column) -> Column:
    """What the languages of `found` have above the floor, so many times."""
    return F.transform(found, lambda f: F.struct(
        f["at"].alias("at"), (times * (F.log(f["n"] + SMOOTH) - float(np.log(SMOOTH)))).alias("value")))


def _backoff(words: DataFrame, model: Model) -> DataFrame:
    """`(word, kind, above)` of unseen words: means over the longest n-grams that are known; a word with none has no row."""
    out = words.select("word", F.lit(0).alias("kind"), F.array().cast("array<struct<at:int,value:double>>").alias("above")).limit(0)
    for length in range(LONGEST, 0, -1):
        hits = words.mapInArrow(_hits_of(length), "word binary, token string, n long").join(
            model.grams.where(F.col("length") == length).select("token", "found"), "token")
        parts = hits.select("word", "n", "found").repartition("word").select("word", F.explode(F.concat(
            F.array(F.struct(F.lit(-1).alias("at"), F.col("n").cast("double").alias("value"))), _above("found", F.col("n")))).alias("x"))
        sums = parts.groupBy("word", "x.at").agg(_total(F.col("x.value")).alias("value")).groupBy("word").agg(
            F.max(F.when(F.col("at") < 0, F.col("value"))).alias("n"), F.collect_list(F.struct("at", "value")).alias("sums"))
        means = F.transform(F.filter("sums", lambda x: x["at"] >= 0), lambda x: F.struct(
            x["at"].alias("at"), (x["value"] / F.col("n")).alias("value")))
        done = kept(sums.select("word", F.lit(length).alias("kind"), means.alias("above")), f"language-backoff-{length}", "zstd")
        out = out.union(done)
        words = kept(words.join(done.select("word"), "word", "left_anti"), f"language-unseen-{length}", "zstd")
        if words.isEmpty():
            break
    return out


def told(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
         carry: dict[str, Column] | None = None) -> DataFrame:
    """`(doc_id, *carry, lettered, lang_pred, score)`, one row for each input row; `lettered` says if the text has a letter."""
    rows = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in (carry or {}).items()]).alias("row"),
        F.monotonically_increasing_id().alias("place"), text_bytes(text_col).alias("raw_text"))
    scored = rows.mapInArrow(_scorer(model.held), StructType([
        *rows.schema.fields[:-1], StructField("lettered", BooleanType()), StructField("held", ArrayType(DoubleType())),
        StructField("words", ArrayType(BinaryType())), StructField("counts", ArrayType(LongType()))]))
    if not model.langs:
        return scored.select("row.*", "lettered", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    scored = kept(scored, "language-held", "zstd")

    rest = scored.select("place", F.explode(F.arrays_zip("words", "counts")).alias("x")).select(
        "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    looked_up = kept(rest.select("word").distinct().join(
        model.words.select(F.col("token").alias("word"), "found"), "word", "left"), "language-rest", "zstd")
    values = looked_up.where(F.col("found").isNotNull()).select(
        "word", F.lit(0).alias("kind"), _above("found", F.lit(1)).alias("above")).union(
        _backoff(looked_up.where(F.col("found").isNull()).select("word"), model))

    # For each text the sums above the floor by language and, below zero, the words of each kind.
    parts = rest.join(values, "word").select("place", "n", "kind", "above").repartition("place").select(
        "place", "n", F.explode(F.concat(F.array(F.struct(
            (-1 - F.col("kind")).alias("at"), F.lit(1.0).alias("value"))), F.col("above"))).alias("x"))
    sums = parts.groupBy("place", "x.at").agg(_total(F.col("n") * F.col("x.value")).alias("value")).groupBy("place").agg(
        F.collect_list(F.struct("at", "value")).alias("rest"))
    whole = scored.select("place", "row", "lettered", "held").join(sums, "place", "left").select(
        "row", "lettered", "held", F.coalesce("rest", F.array().cast("array<struct<at:int,value:double>>")).alias("rest"))
    return whole.mapInArrow(_predictor(model.langs, model.floors), StructType([
        *whole.schema.fields[:2], StructField("lang_pred", StringType()), StructField("score", DoubleType())])).select(
        "row.*", "lettered", "lang_pred", "score")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """`(doc_id, *carry, lang_pred, score)`, one row for each input row."""
    out = told(docs, model, id_col, text_col, carry)
    return out.select(*[f"`{c}`" for c in out.columns if c != "lettered"])
