"""Charge files as a stream: re-read overlap absorbed by key, micro-batches merged into the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitledger.functions import dates
from visitledger.operators.dedup import present
from visitledger.session import shared_dir
from visitledger.sources import tables
from visitledger.sources.keyed import append_new

HORIZON = "120 days"


def _is_directory(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).isDirectory()


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream; a single file is read through its folder with a name filter."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if not _is_directory(spark, path):
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.load(path)


def unique_lines(lines: DataFrame, key: str, event_time: str, horizon: str = HORIZON, salts: int = 16) -> DataFrame:
    """First arrival of each key within the horizon; state older than the horizon is dropped.

    Copies of a key are first reduced per (key, input partition group), so a key with a large share of a
    batch spreads over `salts` tasks and reaches the second, exact step as a few rows.
    """
    salted = lines.withColumn("_salt", F.spark_partition_id() % salts).withWatermark(event_time, horizon)
    reduced = salted.dropDuplicatesWithinWatermark([key, "_salt"])
    return reduced.dropDuplicatesWithinWatermark([key]).drop("_salt")


def merge_into(lines: DataFrame, table: str, checkpoint: str, key: str, fallback=(), day: str = "service_date"):
    """Append what the table does not hold yet, batch by batch, until the input is read up. Only the months that may hold
    rows of a batch are opened.

    A batch that is replayed after a failure adds nothing twice, since the table decides what is new. Blank keys are stored
    as null, so the keyless part of the table is found by a pushed-down filter.
    """
    def merge(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        named = batch.withColumn(key, F.when(present(F.col(key)), F.col(key)))
        staged_at = shared_dir(spark, "stream-stage")
        tables.write_snapshot(named, staged_at)
        append_new(spark, table, spark.read.schema(named.schema).parquet(staged_at), key, fallback, day)

    return (
        lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def weekly_totals(lines: DataFrame, event_time: str, value: str, by: tuple[str, ...] = (),
                  lateness: str = HORIZON) -> DataFrame:
    """Friday-ending weekly totals as tumbling windows, Saturday to Friday."""
    span = F.window(F.col(event_time), "7 days", "7 days", "2 days")
    totals = lines.withWatermark(event_time, lateness).groupBy(span, *by).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))
    return totals.select(F.date_sub(F.to_date("window.end"), 1).alias("week"), *by, "total", "rows")


def drain(df: DataFrame, path: str, checkpoint: str):
    """Write an append-mode stream to Parquet until the input is read up."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def batch_weekly_totals(lines: DataFrame, event_time: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The same totals as a batch job over the whole table: the correction path for rows that came too late."""
    return lines.groupBy(dates.week_end(F.to_date(event_time)).alias("week"), *by).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))
