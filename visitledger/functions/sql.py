"""The row functions as temporary SQL functions; Spark inlines their bodies into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from visitledger import config as C
from visitledger.config import PracticeConfig
from visitledger.functions import money, rules


def _band_case(argument: str, fees: dict[str, int]) -> str:
    arms = " ".join(f"WHEN '{name}' THEN {fee}" for name, fee in fees.items())
    return f"(CASE {argument} {arms} ELSE 0 END)"


def _in_list(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def register_functions(spark: SparkSession, cfg: PracticeConfig) -> list[str]:
    """Create week_end, clean_money, rvu_value, rvu_category, exam_fee and tier_payout; returns their names."""
    band = "regexp_replace(trim(coalesce({0}, '')), '[.]0$', '')"
    focused, opinions, genmed = band.format("focused"), band.format("opinions"), band.format("genmed")
    tiers = " + ".join(
        f"greatest(0, {'points' if tier.cap is None else f'least(points, {tier.cap})'} - {tier.floor}) * {tier.rate}.0D"
        for tier in cfg.tiers
    )
    bare = "trim(translate(raw, '$,', ''))"
    pattern = money.NUMBER_PATTERN.replace("\\", "\\\\")
    bodies = {
        "week_end(day DATE)": ("DATE", "next_day(date_sub(day, 1), 'FRI')"),
        "clean_money(raw STRING)": (
            "DECIMAL(18,2)",
            f"coalesce(CASE WHEN {bare} RLIKE '{pattern}' THEN try_cast({bare} AS DECIMAL(18,2)) END, 0)",
        ),
        "rvu_value(services STRING, charge DECIMAL(18,2), row_text STRING)": (
            rules.RVU.upper(), rules.points_sql(rules.clinical_rule_sql(cfg.clinical_rules), cfg.clinical_rules)),
        "rvu_category(services STRING, charge DECIMAL(18,2), row_text STRING)": (
            "STRING", rules.category_sql(rules.clinical_rule_sql(cfg.clinical_rules), cfg.clinical_rules)),
        "exam_fee(focused STRING, opinions STRING, tbi STRING, genmed STRING, no_show STRING)": (
            "DECIMAL(18,2)",
            f"{_band_case(focused, C.FOCUSED_FEES)} + {_band_case(opinions, C.OPINION_FEES)}"
            f" + (CASE WHEN lower({band.format('tbi')}) IN ({_in_list(C.TBI_MARKS)}) THEN {C.TBI_FEE} ELSE 0 END)"
            f" + {_band_case(genmed, C.GENMED_FEES)}"
            f" + (CASE WHEN {band.format('no_show')} = '1' THEN {C.NO_SHOW_FEE} ELSE 0 END)",
        ),
        "tier_payout(points DOUBLE)": ("DOUBLE", tiers),
    }
    for signature, (result, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    return [signature.split("(")[0] for signature in bodies]
