"""From raw documents to packed token sequences.

Each stage takes all its predecessor kept and returns the columns of `documents`, the last one the packed pieces. Between
stages the documents are a table in the shared folder, so a lost executor repeats tasks of one stage only.

* language: documents without a letter have no language and go, whatever could be learned;
* exact: of equal texts (white space aside) the smallest id stays;
* near: of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more the smallest id stays;
* repeats: strings of 400 bytes that occur more than once are cut out of the texts; a character that a cut splits goes whole,
  a document of which nothing but white space is left goes;
* pack: the texts' tokens in sequences of 4096.

Null texts and empty tables pass through each stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitledger.llm import exact_dedup, language, ngram_join, packing, suffix_dedup
from visitledger.llm.common import kept, read_table
from visitledger.llm.queries import id_fold


def _only(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of `docs` that `groups` keeps, matched by their place in the order of reading."""
    wanted = groups.where("kept").select("seen")
    return docs.withColumn("seen", F.monotonically_increasing_id()).join(wanted, "seen", "left_semi").drop("seen")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs, id_fold(4) != 2)
    told = language.told(docs, model, carry={"seen": F.monotonically_increasing_id()})
    return _only(docs, told.withColumnRenamed("lettered", "kept"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, exact_dedup.grouped(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, ngram_join.grouped(docs))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, cut = suffix_dedup.long_repeats(docs)
    rows = docs.withColumn("seen", F.monotonically_increasing_id()).join(cut.select("seen", "kept_text"), "seen", "left")
    changed = F.col("kept_text").isNotNull()
    text = {"text": F.coalesce("kept_text", "text"),
            "n_chars": F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))}
    return rows.where(~changed | F.col("kept_text").rlike(r"\S")).select(
        *[text.get(c, F.col(c)).alias(c) for c in docs.columns])


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("repeats", repeats_stage),
    ("pack", pack_stage),
]

#: Language models, connected components and token ids are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return docs
