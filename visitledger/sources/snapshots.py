"""Tables that are replaced whole: versions and a list of them, so that a replacement is seen whole or not at all.

Each replacement is written to a folder of its own. Publishing it appends one row to the list of versions, a single small file
that Spark's writer moves into place at the end; readers take the newest listed version. A writer that dies before that has
changed nothing for readers, and who began to read keeps the version that was found.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitledger.sources import tables

VERSIONS = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("folder", T.StringType()), T.StructField("rows", T.LongType())])


def versions(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_table(spark, f"{path}/versions", VERSIONS)


def newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of the newest published version; of two with one number, the later folder name."""
    row = versions(spark, path).agg(F.max(F.struct("version", "folder")).alias("v")).first()["v"]
    return (row["version"], row["folder"]) if row else (0, None)


def stage(df: DataFrame, path: str) -> str:
    """Write a version that no reader sees yet; its folder name."""
    folder = f"data-{uuid.uuid4().hex}"
    tables.write_snapshot(df, f"{path}/{folder}")
    return folder


def publish(spark: SparkSession, path: str, folder: str) -> int:
    """Make a staged version the one that readers get; its number."""
    number, rows = newest(spark, path)[0] + 1, spark.read.parquet(f"{path}/{folder}").count()
    spark.createDataFrame([(number, folder, rows)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return number


def replace(df: DataFrame, path: str) -> int:
    return publish(df.sparkSession, path, stage(df, path))


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest published version; empty with the given schema when there is none."""
    folder = newest(spark, path)[1]
    if folder is not None:
        return spark.read.parquet(f"{path}/{folder}")
    if schema is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    return spark.createDataFrame([], schema)


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the folders of all but the newest `keep` versions, and of staged ones that were never published; their names.
    Run it when no writer is at work."""
    listed = [r["folder"] for r in versions(spark, path).orderBy(F.desc("version"), F.desc("folder")).limit(keep).collect()]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [status.getPath().getName() for status in system.listStatus(place)]
    gone = [name for name in names if name.startswith("data-") and name not in listed]
    for name in gone:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return gone
