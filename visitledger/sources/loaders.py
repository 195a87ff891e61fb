"""Raw layer -> typed layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig
from visitledger.functions import dates, money, rules
from visitledger.operators.dedup import keep_first
from visitledger.sources import schemas as S
from visitledger.sources.files import conform, repair_provider_header


CHARGE_NAMES = ("epid", "patient_id", "encounter_id", "provider_raw")
EXAM_NAMES = ("case_id", "patient_id", "provider_raw")


def named(text: Column) -> Column:
    """An id or name, trimmed; blank and `nan` are missing values."""
    bare = F.trim(text)
    return F.when(~F.lower(bare).isin("", "nan"), bare)


def type_charges(raw: DataFrame) -> DataFrame:
    """Dates and money typed, missing money columns 0, ids and names trimmed with one missing value, other text as entered."""
    whole = conform(raw, S.RAW_CHARGES).withColumnsRenamed(S.CHARGE_HEADERS)
    has_code_text = "Procedure Codes with Modifiers" in raw.columns
    typed = {"service_date": dates.parse_date(F.col("service_date"))}
    typed |= {name: money.clean_money(F.col(name)) for name in S.CHARGE_MONEY}
    typed |= {name: named(F.col(name)) for name in CHARGE_NAMES if name in whole.columns}
    if not has_code_text:
        typed["code_text"] = F.coalesce("procedure_code", F.lit(""))
    return whole.withColumns(typed)


def derive_charges(charges: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Totals, allowed amount, revenue and the Friday week of typed charge lines."""
    adjustments = money.add_all(F.col("pri_adjustment"), F.col("sec_adjustment"), F.col("oth_adjustment"))
    payments = money.add_all(
        F.col("pat_payment"), F.col("pri_payment"), F.col("sec_payment"), F.col("oth_payment")
    )
    return (
        charges.withColumns({"total_adjustments": adjustments, "total_payments": payments})
        .withColumns({
            "allowed": money.allowed_amount(
                F.col("charge_amount"), F.col("total_adjustments"), F.col("total_payments"), cfg),
            "revenue": F.col("total_payments"),
            "week": dates.week_end(F.col("service_date")),
        })
        .withColumn("revenue_model", money.model_revenue(F.col("allowed"), cfg))
    )


def load_charges(raw: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Charges export, unique by line id, typed and derived."""
    return derive_charges(keep_first(type_charges(raw), ["epid"]), cfg)


def load_drafts(raw: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Draft charges through the same cleaner, exact duplicates removed, tagged as not confirmed."""
    return derive_drafts(type_charges(raw).dropDuplicates(), cfg)


def derive_drafts(typed: DataFrame, cfg: PracticeConfig) -> DataFrame:
    return derive_charges(typed, cfg).withColumn("charge_status", F.lit("draft"))


def derive_exams(exams: DataFrame) -> DataFrame:
    fee = rules.exam_fee(F.col("focused"), F.col("opinions"), F.col("tbi"), F.col("genmed"), F.col("no_show"))
    return exams.withColumns({
        "exam_revenue": fee,
        "is_no_show": rules.is_no_show(F.col("no_show")),
        "week": dates.week_end(F.col("service_date")),
    })


def load_exams(raw: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Exam export with a repaired provider header; rows without a readable date are dropped."""
    fixed = repair_provider_header(raw, cfg.legacy_provider_headers)
    extra = ["Patient_ID"] if "Patient_ID" in fixed.columns else []
    typed = conform(fixed, S.all_strings([*S.EXAM_HEADERS, *extra])).withColumnsRenamed(S.EXAM_HEADERS)
    patient = F.col("Patient_ID") if extra else F.col("case_id")
    dated = typed.withColumns({
        "service_date": dates.parse_date(F.col("service_date")), "patient_id": named(patient),
        **{name: named(F.col(name)) for name in EXAM_NAMES if name in typed.columns and name != "patient_id"},
    }).drop(*extra)
    return derive_exams(dated.filter("service_date is not null"))


def load_bank(raw: DataFrame) -> DataFrame:
    whole = conform(raw, S.RAW_BANK).withColumnsRenamed(S.BANK_HEADERS)
    return whole.withColumns({
        "entry_date": dates.parse_date(F.col("entry_date")),
        "amount": money.clean_money(F.col("amount")),
        "running_balance": money.clean_money(F.col("running_balance")),
    })
