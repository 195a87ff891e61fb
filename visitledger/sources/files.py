"""Readers of the landing files: CSV exports, positional sheets, XML responses, review JSON.

Every reader returns the raw layer (strings under the export headers); typing happens in `loaders`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitledger.functions import dates, rules
from visitledger.sources import csv_blocks
from visitledger.sources import schemas as S


def unique_headers(header: list[str]) -> dict[str, int]:
    """Header -> position of its first occurrence; later repeats are dropped."""
    first: dict[str, int] = {}
    for position, name in enumerate(header):
        first.setdefault(name, position)
    return first


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header line as strings, repeated headers reduced to the first.

    Quoted fields may hold doubled quotes and line breaks, and a large file is still many tasks (`csv_blocks`). Files of a
    folder are grouped by their header and brought together by name, in the column order of the first file; a column that a
    file lacks is null. Columns are taken by position, so Spark never renames a header.
    """
    known = csv_blocks.layout(spark, path)
    if not known.headers:
        return spark.createDataFrame([], T.StructType([]))
    frames = []
    for header, files in known.headers.items():
        names = csv_blocks.header_names(header)
        rows = csv_blocks.read_positions(spark, path if len(known.headers) == 1 else files, len(names), known)
        frames.append(rows.select(*[F.col(f"_c{i}").alias(name) for name, i in unique_headers(names).items()]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_named(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A stored CSV by name; a table that does not exist yet is an empty frame with the expected columns."""
    try:
        return read_csv(spark, f"{root.rstrip('/')}/{name}")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem.getCondition() or problem):
            raise
        return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of `schema`, missing ones as null."""
    return df.select(*[
        F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def repair_provider_header(df: DataFrame, legacy_headers: tuple[str, ...]) -> DataFrame:
    """The exam provider under `Provider`, filled from legacy headers where it is missing."""
    candidates = [name for name in ("Provider", *legacy_headers) if name in df.columns]
    if not candidates:
        return df
    merged = F.coalesce(*[F.col(f"`{name}`") for name in candidates])
    others = [F.col(f"`{name}`") for name in df.columns if name not in candidates]
    return df.select(*others, merged.alias("Provider"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Exam rows from positional cells `_c0.._c15`; rows without a case key are skipped."""
    def cell(position: int) -> Column:
        name = f"_c{position}"
        return F.trim(F.coalesce(F.col(name), F.lit(""))) if name in cells.columns else F.lit("")

    picked = cells.select(*[cell(position).alias(name) for name, position in S.EXAM_POSITIONS.items()])
    return picked.filter(F.col("`Case ID`") != "")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An exported sheet, one header line, columns by position."""
    width = max(S.EXAM_POSITIONS.values()) + 1
    return sheet_rows(csv_blocks.read_positions(spark, path, width, csv_blocks.layout(spark, path)))


def charge_rows(records: DataFrame) -> DataFrame:
    """Charge records (one column per element) -> the 16 export columns."""
    def element(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    plain = {header: element(name) for name, header in S.CHARGE_ELEMENTS.items()}
    day = dates.parse_date(element("ServiceStartDate"))
    plain["Date Of Service"] = F.coalesce(dates.us_date_text(day), element("ServiceStartDate"))
    plain["Procedure Codes with Modifiers"] = rules.codes_with_modifiers(
        F.col("ProcedureCode"), *[F.col(name) for name in S.MODIFIER_ELEMENTS]
    )
    return records.select(*[plain[header].alias(header) for header in S.CHARGE_HEADERS])


def parse_charge_xml(df: DataFrame, xml: str) -> DataFrame:
    """Charge rows from a string column that holds one charge record per row."""
    record = F.from_xml(F.col(xml), S.CHARGE_RECORD, {"ignoreNamespace": "true"})
    return charge_rows(df.select(record.alias("r")).select("r.*"))


def _flag_files(spark: SparkSession, path: str, row_tag: str, element: str, keep) -> DataFrame:
    flags = (
        spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true")
        .schema(S.all_strings([element, "ErrorMessage"])).load(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    flag = F.lower(F.trim(F.coalesce(F.col(element), F.lit(""))))
    return flags.filter(keep(flag)).select("file", F.lit(element).alias("reason"), F.col("ErrorMessage").alias("message"))


def read_xml_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Responses that report an error or a failed login: `(file, reason, message)`."""
    errors = _flag_files(spark, path, "ErrorResponse", "IsError", lambda flag: flag == "true")
    logins = _flag_files(spark, path, "SecurityResponse", "Authenticated", lambda flag: flag != "true")
    return errors.unionByName(logins)


def _read_records(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    rows = (
        spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true")
        .schema(schema).load(path).withColumn("_file", F.col("_metadata.file_path"))
    )
    rejected = read_xml_rejects(spark, path).select(F.col("file").alias("_file")).distinct()
    return rows.join(rejected, "_file", "left_anti").drop("_file")


def read_charge_xml(spark: SparkSession, path: str) -> DataFrame:
    """Charge rows of all accepted response files."""
    return charge_rows(_read_records(spark, path, "ChargeData", S.CHARGE_RECORD))


def appointment_rows(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Appointment records -> `(start_at, end_at, status)` in clinic wall-clock time; unreadable times are dropped.

    A time with a zone or offset is converted; a time without one is already local.
    """
    def local(name: str) -> Column:
        text = F.trim(F.col(name))
        zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & F.contains(text, F.lit("T"))
        return F.when(zoned, dates.clinic_local(text.try_cast("timestamp")).cast("timestamp_ntz")).otherwise(
            text.try_cast("timestamp_ntz")
        )

    rows = records.select(
        *keep, local("StartDate").alias("start_at"), local("EndDate").alias("end_at"),
        F.trim(F.coalesce("ConfirmationStatus", F.lit(""))).alias("status"),
    )
    return rows.filter("start_at is not null and end_at is not null")


def parse_appointment_xml(df: DataFrame, xml: str, keep: tuple[str, ...] = ()) -> DataFrame:
    record = F.from_xml(F.col(xml), S.APPOINTMENT_RECORD, {"ignoreNamespace": "true"})
    return appointment_rows(df.select(*keep, record.alias("r")).select(*keep, "r.*"), keep)


def read_appointment_xml(spark: SparkSession, path: str) -> DataFrame:
    return appointment_rows(_read_records(spark, path, "AppointmentData", S.APPOINTMENT_RECORD))


def reason_rows(records: DataFrame) -> DataFrame:
    """Appointment reasons; an unreadable duration is 30 minutes, a reason without id is skipped."""
    identifier = F.trim(F.coalesce("ID", F.lit("")))
    return records.filter(identifier != "").select(
        identifier.alias("id"), F.trim(F.coalesce("Name", F.lit(""))).alias("name"),
        F.coalesce(F.trim("Duration").try_cast("int"), F.lit(30)).alias("duration_minutes"),
    )


def read_reason_xml(spark: SparkSession, path: str) -> DataFrame:
    return reason_rows(_read_records(spark, path, "AppointmentReasonData", S.REASON_RECORD))


def parse_reason_xml(df: DataFrame, xml: str) -> DataFrame:
    record = F.from_xml(F.col(xml), S.REASON_RECORD, {"ignoreNamespace": "true"})
    return reason_rows(df.select(record.alias("r")).select("r.*"))


def review_rows(payloads: DataFrame) -> DataFrame:
    """Reviews of accepted payloads, one row each."""
    ok = payloads.filter(F.col("status") == "OK")
    return ok.select(F.explode("result.reviews").alias("review")).select("review.*")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return review_rows(spark.read.schema(S.REVIEW_PAYLOAD).option("multiLine", True).json(path))


def five_star(reviews: DataFrame) -> DataFrame:
    text = F.trim(F.coalesce("text", F.lit("")))
    return reviews.filter((F.col("rating") == 5) & (text != "")).withColumn("text", text)
