"""Business configuration. Every bound, rate, rule and name list used by a report lives here.

Nothing in this module reads a clock, a file or the environment: `as_of` and all windows are plain
values that the caller sets, so a report is a pure function of its inputs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Sequence[tuple[str, ...]], names: Sequence[str]) -> DataFrame:
    """A configured string table as part of the plan, so that its size is known when joins are planned."""
    structs = [F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


@dataclass(frozen=True)
class RvuRule:
    """One productivity rule. `predicate` is SQL over `services`, `charge` and `row_text`."""

    category: str
    rvu: str
    predicate: str


@dataclass(frozen=True)
class Tier:
    """Marginal payout: `rate` per point above `floor`, up to `cap` (None = open ended)."""

    floor: int
    cap: int | None
    rate: int


@dataclass(frozen=True)
class Threshold:
    """Weekly targets in force from `valid_from` until the next entry."""

    valid_from: date
    company_breakeven: int
    company_target: int
    provider_breakeven: int
    provider_target: int


# Clinical productivity rules, first match wins.
CLINICAL_RULES = (
    RvuRule("Func Med Initial", "3.75", "contains(services, 'FUNCTIONAL') AND contains(services, 'INITIAL')"),
    RvuRule("Func Med Subsequent", "2.50", "contains(services, 'FUNCTIONAL')"),
    RvuRule("Nexus Letter", "2.50", "contains(services, 'NEXUS') OR charge = 200.00"),
    RvuRule("DOT Physical", "1.00",
            "contains(services, 'DOT') OR (contains(services, 'PHYSICAL') AND contains(row_text, 'DOT'))"),
    RvuRule("Primary Care Visit", "1.30", "services RLIKE '992[01][1-5]'"),
    RvuRule("Primary Care Visit", "1.30", "services RLIKE '993[89][0-9]'"),
    RvuRule("Primary Care Visit", "1.30", "contains(services, 'ANNUAL') OR contains(services, 'PHYSICAL')"),
    RvuRule("Vaccine Only", "0.50",
            "services RLIKE '90[4-7][0-9]{2}' OR contains(services, 'VACCINE') OR contains(services, 'ADMIN')"),
)
CLINICAL_DEFAULT = ("Other/Unclassified", "0.00")

# Exam productivity.
EXAM_NO_SHOW = ("No Show", "0.75")
EXAM_NO_OPINION = ("VA Exam (0 IMOs)", "2.50")
EXAM_FEW_OPINIONS = ("VA Exam (1-3 IMOs)", "4.50")
EXAM_MANY_OPINIONS = ("VA Exam (4+ IMOs)", "6.50")
FEW_OPINION_BANDS = ("1-3", "1-5", "1", "2", "3")

# Exam fee schedule per component and band.
GENMED_FEES = {"0": 0, "1-5": 180, "6-10": 360, "11-15": 520, "16+": 700}
FOCUSED_FEES = {"0": 0, "1-5": 200, "6-10": 280, "11-15": 370, "16+": 480}
OPINION_FEES = {"0": 0, "1-3": 150, "4-6": 260, "7-9": 330, "10-12": 350, "13-15": 465, "16-18": 525, "19+": 600}
TBI_FEE = 250
NO_SHOW_FEE = 60
TBI_MARKS = ("1", "r-tbi", "tbi")

# Visit code groups.
ESTABLISHED_CODES = ("99211", "99212", "99213", "99214", "99215")
NEW_PATIENT_CODES = ("99202", "99203", "99204", "99205")
PHYSICAL_CODES = (
    "99381", "99382", "99383", "99384", "99385", "99386", "99387",
    "99391", "99392", "99393", "99394", "99395", "99396", "99397",
    "G0402", "G0438", "G0439",
)

# Categories a fact row may carry.
KNOWN_CATEGORIES = (
    "Primary Care Visit", "VA Exam", "VA Exam (0 IMOs)", "VA Exam (1-3 IMOs)", "VA Exam (4+ IMOs)",
    "No Show", "Vaccine Only", "DOT Physical", "Nexus Letter", "Func Med Initial",
    "Func Med Subsequent", "Other/Unclassified", "Manual Adjustment",
)


@dataclass(frozen=True)
class PracticeConfig:
    """Parameters of the reports; the defaults are the fixed business values."""

    as_of: date = date(2026, 6, 30)
    providers: tuple[str, ...] = ("P1", "P2", "P3", "P4")
    aliases: tuple[tuple[str, str], ...] = ()

    # reporting windows
    fact_start: date = date(2025, 10, 1)
    forecast_start: date = date(2024, 1, 1)
    campaign_start: date = date(2025, 12, 29)
    exam_start: date = date(2025, 1, 1)
    outlier_weeks: tuple[date, ...] = (date(2025, 5, 2), date(2025, 5, 9), date(2025, 9, 19))

    # productivity targets and payout
    thresholds: tuple[Threshold, ...] = (
        Threshold(date(1, 1, 1), 196, 328, 49, 82),
        Threshold(date(2026, 4, 24), 146, 278, 49, 93),
    )
    tiers: tuple[Tier, ...] = (Tier(689, 735, 25), Tier(735, 827, 30), Tier(827, None, 35))
    adjusted_provider: str = "P1"
    adjustment_rvu: int = 216
    draft_rate_default: float = 0.85
    hidden_providers: tuple[str, ...] = ()
    clinical_rules: tuple[RvuRule, ...] = CLINICAL_RULES

    # money
    uncollected_allowed_rate: str = "0.3287"
    model_revenue_rate: str = "0.90"
    collection_rate: str = "0.33"
    collection_lag_weeks: int = 10
    revenue_per_rvu_benchmark: int = 80
    quarter_costs: tuple[tuple[int, int, int], ...] = (
        (2025, 1, 9569), (2025, 2, 11223), (2025, 3, 13752), (2025, 4, 13063), (2026, 1, 13063),
    )
    default_cost: int = 9569
    receivable_lag_days: int = 35

    # exam groups: label -> lower-case name fragment, and the weekly cap per group
    exam_groups: tuple[tuple[str, str], ...] = (("a", "p4"), ("b", "p3"))
    exam_cap: int = 18

    # data-quality bounds
    name_fragments: tuple[str, ...] = ()
    min_charge_rows: int = 1000
    min_exam_rows: int = 2000
    earliest_date: date = date(2024, 1, 1)

    legacy_provider_headers: tuple[str, ...] = ()
    display_names: tuple[tuple[str, str], ...] = field(default_factory=tuple)

    def alias_table(self, spark: SparkSession) -> DataFrame:
        """The configured aliases as the `(alias_norm, canonical)` dimension."""
        rows = [(alias.strip().upper(), canonical) for alias, canonical in self.aliases]
        rows += [(name, name) for name in self.providers]
        return literal_table(spark, sorted(dict(reversed(rows)).items()), ("alias_norm", "canonical"))
