"""Licence notices by an exact set-similarity join, in DataFrame functions alone.

Text blocks (paragraphs between blank lines, cut further at sentence ends) are sets of words, so a notice wrapped over lines
is one block. The words of all templates are ordered by the number
of documents that hold them, rarest first. A block that contains at least `threshold` of a template's words must hold one
of the template's rarest words (prefix), enough template words at all (length), and enough of them at and behind the first
shared one (position); what passes is counted exactly. Only template words are ever exploded, and only in blocks that hold a
prefix word, so ordinary text leaves the scan as one row for each document.

Beside the blocks, places of whole phrases are found in the word sequence of the text.

Defined results: null text is empty: no words, no labels, score 0. Repeated rows are scanned each, an empty table gives an
empty result, further columns are ignored. The score is 1 where a phrase stands, else the largest share of a template's
words found in one block if it meets the threshold, else 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_END = r"\n[ \t\r]*\n|[.!?][ \t\r\n]"

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices of well-known licences.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under the creative commons attribution share alike license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", "released under the mit license"),
)


def words_of(text: Column) -> Column:
    """Words of the lower-cased text. Lower-casing beyond A-Z neither makes nor removes a word boundary, nor a phrase."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase in the word array; looked for only where its first and last words occur."""
    parts = phrase.split()

    def stands(i: Column) -> Column:
        hit = F.lit(True)
        for k, part in enumerate(parts):
            hit = hit & (F.get(words, i + k) == part)
        return hit

    present = F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1]) & (F.size(words) >= len(parts))
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)
    return F.when(present, starts).otherwise(F.array().cast("array<int>"))


def template_order(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, text_col: str = "text") -> list[str]:
    """All template words, those in fewest documents first (then by name); its length is that of the templates."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    held = docs.select(F.explode(F.array_intersect(
        F.array(*map(F.lit, vocabulary)), words_of(F.coalesce(F.col(text_col), F.lit("")))).alias("held")).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_index(spark: SparkSession, order: Sequence[str], templates: Sequence[tuple[str, str]],
                   threshold: float) -> DataFrame:
    """One row for each prefix word of each template."""
    rank, rows = {w: i for i, w in enumerate(order)}, []
    for label, text in templates:
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        need = math.ceil(round(threshold * len(tokens), 9))
        rows += [(tokens[i], label, i, len(tokens), need, tokens) for i in range(len(tokens) - need + 1)]
    return spark.createDataFrame(rows, "word string, label string, place int, n_tokens int, need int, tokens array<string>")


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
         threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`, one row for each input row."""
    order = template_order(docs, templates, text_col)
    index = template_index(docs.sparkSession, order, templates, threshold)
    prefix = sorted({r["word"] for r in index.select("word").collect()})

    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("seen"),
        F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    worded = texts.withColumn("words", words_of(F.col("raw")))
    placed = worded.select("doc_id", "seen", "raw", F.size("words").cast("bigint").alias("n_words"), *[
        _places(F.col("words"), phrase).alias(f"at{k}") for k, (phrase, _) in enumerate(phrases)],
        F.arrays_overlap("words", F.array(*map(F.lit, prefix))).alias("may"))
    starts = F.concat(*[F.col(f"at{k}") for k in range(len(phrases))])
    found = F.array_sort(F.array_compact(F.array(*[
        F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)])))

    # Each block's template words in global order, kept only where one of them is a prefix word.
    held = F.transform(F.split("raw", BLOCK_END), lambda block: F.array_intersect(
        F.array(*map(F.lit, order)), words_of(block)))
    blocks = F.filter(held, lambda block: F.arrays_overlap(block, F.array(*map(F.lit, prefix))))
    scanned = placed.select(
        "doc_id", "seen", "n_words", F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_distinct(found).alias("found"), F.when(F.col("may"), blocks).alias("blocks"))

    keys = ["doc_id", "seen", "n_words", "n_base", "first_word", "last_word", "found"]
    candidates = scanned.select(*keys, F.explode_outer("blocks").alias("block")).select(
        *keys, "block", F.posexplode_outer("block").alias("behind", "word"))
    first_shared = F.element_at(F.array_intersect("tokens", "block"), 1) == F.col("word")
    room = F.least(F.col("n_tokens") - F.col("place"), F.size("block") - F.col("behind"))
    share = F.when(
        (F.size("block") >= F.col("need")) & (room >= F.col("need")) & first_shared,
        F.size(F.array_intersect("tokens", "block")))
    matched = candidates.join(index, "word", "left").select(
        *keys, F.when(share >= F.col("need"), F.col("label")).alias("label"),
        F.when(share >= F.col("need"), share / F.col("n_tokens")).alias("share"))
    own = matched.groupBy(*keys).agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    return own.select(
        *[k for k in keys if k not in ("seen", "found")], F.array_join("found", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("found", "own")), ",").alias("labels"),
        F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
