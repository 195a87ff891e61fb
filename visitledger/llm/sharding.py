"""Contiguous shards of near equal bytes by global prefix sums.

Rows are dealt into blocks by ranges of their id. Only one total per block is summed globally; inside a block the running
sum starts at the block's base. A row belongs to the shard in which the middle of its bytes lies, so shards are contiguous
in id order and differ from the target by less than one row.

Defined results: a null text counts 0 bytes (plus 1 per row), its checksum is 0; a null id sorts first; rows that repeat
an id (or everything) stay separate rows in the order they are read; an empty table gives an empty result; shards that no
row's middle falls into stay empty. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitledger.llm.common import kept, shuffle_parts, text_bytes


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, size, text_crc32, law, shard, slot, grown_shard)`, one row for each input row."""
    sized = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("raw")).select(
        "doc_id", (F.octet_length("raw") + F.lit(1)).cast("bigint").alias("size"), F.crc32("raw").alias("text_crc32"),
        F.monotonically_increasing_id().alias("seen"))
    parts = shuffle_parts(docs.sparkSession)
    blocks = kept(
        sized.repartitionByRange(parts, "doc_id", "seen").withColumn("block", F.spark_partition_id()), "shard-blocks")

    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("block").agg(F.sum("size").alias("block_size"), F.count("*").alias("block_rows"))
    bases = totals.select(
        "block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("base"),
        F.sum("block_size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("total"))

    inside = Window.partitionBy("block").orderBy("doc_id", "seen").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("base")
    placed = (
        blocks.join(bases, "block").withColumn("before", before)
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * before + size) * {shards}) div (2 * total)) as int)")))

    # Places: rows of the same shard in earlier blocks, then rows of it before this one in the block.
    cells = placed.groupBy("block", "shard").agg(F.count("*").alias("n"))
    firsts = cells.select(
        "block", "shard", F.coalesce(
            F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("block", "shard").orderBy("doc_id", "seen")) - 1
    return placed.join(firsts, ["block", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + place).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
