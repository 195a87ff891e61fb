"""The registered queries: each operator over its whole table with production parameters, and SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitledger.llm import (
    alignment, chunk_bpe, context_tree, dual_tree, exact_dedup, language, license_scan, ngram_join, packing, repair, sharding,
    suffix_dedup, vector_dedup)
from visitledger.llm.common import read_table


def id_fold(folds: int, id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo the folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def op1_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))


def op2_pivot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_fold(10) == 0
    scored = context_tree.score_texts(read_table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", ~F.col("learned")).drop("learned")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = chunk_bpe.encode_and_decode(read_table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_fold(4) == 2
    return language.identify(docs, language.fit(docs, ~held_out), carry={"held_out": held_out})


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), written=False).drop("groups")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.written_and_read(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_shard_bytes, op2_pivot_vectors, op3_context_tree, op4_ngram_join, op5_pack, op6_license_scan, op7_suffix_dedup, op8_chunk_bpe, op9_exact_dedup, op10_language_id,
    op11_align, op12_repair, op13_dual_tree)}

ORACLES = {
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op4_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op13_dual_tree": r"""
        WITH t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        q AS (
            SELECT item_id, term, count(*) AS reps FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY item_id, term),
        g AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS words FROM t WHERE len(ws) > 0),
        p AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM t)
            WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
        w AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM p, g GROUP BY term, docs),
        x AS (
            SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)) AS impact FROM p, g),
        s AS (
            SELECT item_id, doc_id, CAST(sum(reps * w * impact) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN x USING (term) GROUP BY item_id, doc_id)
        SELECT * FROM (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank,
                   doc_id, score FROM s WHERE score > 0)
        WHERE rank <= 20
    """,
}
