"""The central facts: productivity points per line, and revenue with points."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig
from visitledger.functions import dates, rules
from visitledger.operators.merge import not_confirmed

CONFIRMED, PIPELINE = "confirmed", "pipeline"
ROW_TEXT = ("provider_raw", "procedure_code", "code_text", "encounter_id", "patient_id", "epid")


def charge_points(charges: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Charge lines with `rvu` and `category`."""
    columns = tuple(name for name in ROW_TEXT if name in charges.columns)
    return rules.with_clinical_rvu(charges, "code_text", "charge_amount", columns, cfg)


def exam_points(exams: DataFrame) -> DataFrame:
    """Exam rows with `rvu` and `category`."""
    return exams.withColumns({
        "rvu": rules.exam_rvu(F.col("opinions"), F.col("no_show")),
        "category": rules.exam_category(F.col("opinions"), F.col("no_show")),
    })


def _since(df: DataFrame, start: date) -> DataFrame:
    return df.filter(F.col("service_date") >= F.lit(start))


def rvu_fact(
    charges: DataFrame | None, exams: DataFrame | None, aliases: DataFrame, cfg: PracticeConfig,
    drafts: DataFrame | None = None, source: str = "all",
) -> DataFrame:
    """`service_date, provider, rvu, category, source, week` since the reporting start.

    `source` is all, pc (charges only) or va (exams only); drafts are charges, so `va` leaves them out.
    A branch that is not chosen is not part of the plan.
    """
    branches = []
    if source != "va" and charges is not None:
        branches.append(charge_points(_since(charges, cfg.fact_start), cfg).withColumn("source", F.lit(CONFIRMED)))
    if source != "pc" and exams is not None:
        branches.append(exam_points(_since(exams, cfg.fact_start)).withColumn("source", F.lit(CONFIRMED)))
    if source != "va" and drafts is not None:
        pending = drafts if charges is None else not_confirmed(drafts, charges, "epid")
        branches.append(charge_points(_since(pending, cfg.fact_start), cfg).withColumn("source", F.lit(PIPELINE)))
    if not branches:
        raise ValueError(f"no input for source {source!r}")
    picked = [b.select("service_date", "provider_raw", "rvu", "category", "source") for b in branches]
    fact = picked[0]
    for branch in picked[1:]:
        fact = fact.unionByName(branch)
    named = rules.with_canonical_provider(fact, "provider_raw", aliases)
    return named.select(
        "service_date", "provider", "rvu", "category", "source", dates.week_end(F.col("service_date")).alias("week")
    )


def revenue_fact(charges: DataFrame, exams: DataFrame, aliases: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """`service_date, provider, rvu, revenue, week, source` of the listed providers."""
    pc = charge_points(_since(charges, cfg.fact_start), cfg).select(
        "service_date", "provider_raw", "rvu", F.col("allowed").alias("revenue"), "week", F.lit("PC").alias("source"))
    va = exam_points(_since(exams, cfg.fact_start)).select(
        "service_date", "provider_raw", "rvu", F.col("exam_revenue").cast("decimal(22,6)").alias("revenue"),
        "week", F.lit("VA").alias("source"))
    named = rules.with_canonical_provider(pc.unionByName(va), "provider_raw", aliases)
    return named.filter(F.col("provider").isin(*cfg.providers)).drop("provider_raw")
