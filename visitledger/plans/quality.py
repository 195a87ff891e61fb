"""Data-quality checks: one row `(table_name, check_name, passed, measured, bound)` per check.

A table is read twice: once for all row-level measures and its provider names, once for all duplicate counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger import config as C
from visitledger.config import PracticeConfig
from visitledger.functions import dates, money, rules
from visitledger.operators import series
from visitledger.operators.dedup import present
from visitledger.operators.merge import overlap_count
from visitledger.sources import schemas as S


def _check(name: str, measured: Column, bound: float, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("check_name"), F.coalesce(passed, F.lit(False)).alias("passed"),
                    measured.cast("double").alias("measured"), F.lit(float(bound)).alias("bound"))


def at_most(name: str, measured: Column, bound: float) -> Column:
    return _check(name, measured, bound, measured <= bound)


def at_least(name: str, measured: Column, bound: float) -> Column:
    return _check(name, measured, bound, measured >= bound)


def above(name: str, measured: Column, bound: float) -> Column:
    return _check(name, measured, bound, measured > bound)


def _rows(table: str, measures: DataFrame, checks: list[Column]) -> DataFrame:
    return measures.select(F.lit(table).alias("table_name"), F.inline(F.array(*checks)))


def _share(hit: Column, of: Column | None = None) -> Column:
    """Share of rows that hit, of the rows in `of`; 0 for an empty base."""
    base = F.count(F.lit(1)) if of is None else F.count_if(of)
    top = F.count_if(hit if of is None else hit & of)
    return F.coalesce(F.try_divide(top.cast("double"), base), F.lit(0.0))


def header_checks(table: str, df: DataFrame, header: list[str], required: tuple[str, ...],
                  provider_headers: tuple[str, ...] = ()) -> DataFrame:
    """Checks on the header line alone: missing, repeated and artifact columns, conflicting provider columns."""
    missing = len([name for name in required if name not in header])
    repeated = len(header) - len(set(header))
    artifacts = len([name for name in header if name.startswith("Unnamed:")])
    providers = max(len([name for name in provider_headers if name in header]) - 1, 0)
    rows = [(table, name, value == 0, float(value), 0.0) for name, value in (
        ("missing columns", missing), ("duplicate columns", repeated),
        ("artifact columns", artifacts), ("conflicting provider columns", providers))]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, check_name string, passed boolean, measured double, bound double")


class Scan:
    """Measures of a table from two reads of it, which run side by side.

    One counts what rows show by themselves, by provider name where names are judged too. The other folds rows to distinct ones,
    known by a 128-bit digest, and those to their keys, to count what repeats. `count` and the others give columns of the
    one-row result.
    """

    def __init__(self, df: DataFrame, name: str | None = None):
        self.df, self.name, self.flags, self.keys, self.day = df, name, {}, [], None

    def count(self, hit: Column) -> Column:
        name = f"count_{len(self.flags)}"
        self.flags[name] = hit
        return F.col(name)

    def share(self, hit: Column, of: Column | None = None, empty: float = 0.0) -> Column:
        """Share of rows that hit, of the rows in `of`; `empty` for an empty base."""
        base = F.col("n") if of is None else self.count(of)
        return F.coalesce(F.try_divide(self.count(hit if of is None else hit & of).cast("double"), base), F.lit(empty))

    def repeats(self, keys: Sequence[str]) -> Column:
        """Rows that repeat an earlier key; rows with a blank part of it are left out."""
        self.keys.append(keys)
        return F.col(f"repeats_{len(self.keys)}")

    def result(self, judged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """One row: `n`, `exact` (rows that repeat an earlier row), `first_day`, `last_day` and what was asked for.

        `judged` adds a flag `unknown` to the table's names; the result then has the share of unknown ones.
        """
        day = F.lit(None).cast("date") if self.day is None else self.day
        counts = {"n": F.count(F.lit(1))} | {name: F.count_if(hit) for name, hit in self.flags.items()}
        by_name = self.df.groupBy(*[self.name] if judged else []).agg(
            F.min(day).alias("first_day"), F.max(day).alias("last_day"), *[c.alias(name) for name, c in counts.items()])
        listed = F.col("unknown").isNotNull() if judged else F.lit(False)
        rows = judged(by_name) if judged else by_name.withColumn("unknown", F.lit(None).cast("boolean"))
        measures = rows.agg(
            F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
            *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts],
            F.coalesce(F.try_divide(F.count_if("unknown").cast("double"), F.count_if(listed)), F.lit(0.0)).alias("unknown"))
        # Two single rows; as parts of a union, unlike a subquery, both are computed at the same time.
        both = measures.unionByName(self._repeats(), allowMissingColumns=True)
        return both.agg(*[F.max(name).alias(name) for name in both.columns])

    def _repeats(self) -> DataFrame:
        columns = dict(zip(("row_a", "row_b"), _row_digest(self.df.columns)))
        for i, keys in enumerate(self.keys, 1):
            filled = reduce(and_, [present(F.col(key)) for key in keys])
            columns |= {f"key_{i}{half}": F.when(filled, digest) for half, digest in zip("ab", _row_digest(keys))}
        distinct = self.df.select(*[c.alias(name) for name, c in columns.items()]).groupBy("row_a", "row_b").agg(
            F.count(F.lit(1)).alias("n"), *[F.max(name).alias(name) for name in columns if name.startswith("key")])
        # A line for the row's own copies (of 0) and one for each of its keys; a blank key has no line.
        lines = [F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.col("n") - 1]
        for i in range(1, len(self.keys) + 1):
            lines += [F.lit(i), F.col(f"key_{i}a"), F.col(f"key_{i}b"), F.col("n")]
        stacked = distinct.select(F.stack(F.lit(1 + len(self.keys)), *lines).alias("of", "a", "b", "n")).where("a is not null")
        grouped = stacked.groupBy("of", "a", "b").agg(F.sum("n").alias("n"))
        extra = F.when(F.col("of") == 0, F.col("n")).otherwise(F.col("n") - 1)

        def total(of: int, name: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col("of") == of, extra)), F.lit(0)).alias(name)

        return grouped.agg(total(0, "exact"), *[total(i, f"repeats_{i}") for i in range(1, len(self.keys) + 1)])


def _row_digest(columns: Sequence[str]) -> tuple[Column, Column]:
    """128 bits of a row, nulls told apart from their place."""
    cells = [part for name in columns for part in (F.col(name), F.col(name).isNull())]
    return F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *cells)


def _date_checks(scan: Scan, day: Column, cfg: PracticeConfig) -> list[Column]:
    scan.day = day
    span = F.coalesce(F.date_diff("last_day", "first_day"), F.lit(0))
    return [
        at_most("unreadable dates", scan.share(day.isNull()), 0.05), at_least("date span days", span, 60),
        at_most("dates before start", scan.count(day < F.lit(cfg.earliest_date)), 0),
        at_most("dates far ahead", scan.count(day > F.lit(cfg.as_of + timedelta(days=90))), 0),
    ]


def _id_checks(scan: Scan, column: str, prefix: str) -> list[Column]:
    text, filled = F.trim(F.col(column).cast("string")), present(F.col(column))
    return [
        at_least(f"{column} hashed", scan.share(F.startswith(text, F.lit(prefix)), filled, 1.0), 1.0),
        at_most(f"{column} raw numbers", scan.count(filled & text.rlike("^[0-9]{5,}$")), 0),
    ]


def _null_checks(scan: Scan, columns: tuple[str, ...]) -> list[Column]:
    return [at_most(f"{name} missing", scan.share(~present(F.col(name))), 0.10) for name in columns]


def provider_mapping(df: DataFrame, aliases: DataFrame, raw: str = "provider_raw") -> DataFrame:
    """Distinct raw names with their canonical form and row count."""
    names = df.filter(present(F.col(raw))).groupBy(F.col(raw).alias("provider_raw")).agg(F.count(F.lit(1)).alias("rows"))
    return rules.with_canonical_provider(names, "provider_raw", aliases)


def unknown_providers(df: DataFrame, aliases: DataFrame, cfg: PracticeConfig, raw: str = "provider_raw") -> DataFrame:
    """Raw names that no alias maps to a listed provider; the productivity reports leave their rows out."""
    return provider_mapping(df, aliases, raw).filter(~F.col("provider").isin(*cfg.providers))


def charge_checks(charges: DataFrame, aliases: DataFrame, cfg: PracticeConfig) -> DataFrame:
    """Checks of the typed charge table before de-duplication."""
    scan = Scan(charges, "provider_raw")
    checks = [above("row count", F.col("n"), cfg.min_charge_rows)]
    checks += _date_checks(scan, F.col("service_date"), cfg)
    checks += _id_checks(scan, "patient_id", "pid_") + _id_checks(scan, "encounter_id", "eid_")
    checks += _null_checks(scan, ("service_date", "provider_raw", "charge_amount", "procedure_code"))
    if cfg.name_fragments:
        known = reduce(or_, [rules.name_matches(F.col("provider_raw"), f) for f in cfg.name_fragments])
        checks.append(at_least("rows with a known name", scan.share(known, present(F.col("provider_raw"))), 0.80))
    checks += [
        at_most("exact duplicates", F.col("exact"), 0), at_most("line id duplicates", scan.repeats(["epid"]), 0),
        at_most("composite duplicates", scan.repeats(["service_date", "encounter_id", "procedure_code"]), 0),
        at_most("unknown provider names", F.col("unknown"), 0.05)]

    def judged(names: DataFrame) -> DataFrame:
        named = rules.with_canonical_provider(names, "provider_raw", aliases)
        listed = F.coalesce(F.col("provider").isin(*cfg.providers), F.lit(False))
        return named.withColumn("unknown", F.when(present(F.col("provider_raw")), ~listed))

    return _rows("charges", scan.result(judged), checks)


def exam_checks(exams: DataFrame, cfg: PracticeConfig) -> DataFrame:
    scan = Scan(exams)
    checks = [above("row count", F.col("n"), cfg.min_exam_rows)]
    checks += _date_checks(scan, F.col("service_date"), cfg)[:2]
    checks += _id_checks(scan, "case_id", "cid_")[:1]
    checks += _null_checks(scan, ("service_date", "focused", "opinions"))
    checks += [at_most("exact duplicates", F.col("exact"), 0), at_most("case id duplicates", scan.repeats(["case_id"]), 0)]
    return _rows("exams", scan.result(), checks)


def landing_checks(table: str, raw: DataFrame, money_headers: Sequence[str], day_header: str) -> DataFrame:
    """Checks of a raw export before typing, one scan: amounts that are no numbers or lose part of a cent, dates no form fits."""
    measures = {}
    for name in money_headers:
        text = F.col(f"`{name}`")
        filled = F.coalesce(F.trim(text) != "", F.lit(False))
        measures[f"{name} unreadable"] = F.count_if(filled & ~money.is_money_text(text))
        measures[f"{name} below cents"] = F.count_if(money.loses_cents(text))
    text = F.col(f"`{day_header}`")
    measures[f"{day_header} unreadable"] = F.count_if(F.coalesce(F.trim(text) != "", F.lit(False)) & dates.parse_date(text).isNull())
    scan = raw.agg(*[column.alias(name) for name, column in measures.items()])
    return _rows(table, scan, [at_most(name, F.col(f"`{name}`"), 0) for name in measures])


def alias_checks(aliases: DataFrame) -> DataFrame:
    """Names that the alias table gives more than one canonical name."""
    scan = rules.alias_conflicts(aliases).agg(F.count(F.lit(1)).alias("n"))
    return _rows("aliases", scan, [at_most("conflicting names", F.col("n"), 0)])


def draft_checks(drafts: DataFrame, charges: DataFrame) -> DataFrame:
    return _rows("drafts", overlap_count(drafts, charges, "epid"),
                 [at_most("drafts already confirmed", F.col("overlap"), 0)])


def fact_checks(fact: DataFrame, cfg: PracticeConfig) -> DataFrame:
    scan = fact.agg(
        _share(F.col("rvu") > 0).alias("positive"),
        F.count_if(~F.col("category").isin(*C.KNOWN_CATEGORIES)).alias("categories"),
        F.count_if(~F.coalesce(F.col("provider").isin(*cfg.providers), F.lit(False))).alias("providers"),
    )
    return _rows("rvu_fact", scan, [
        at_least("positive points", F.col("positive"), 0.50),
        at_most("unknown categories", F.col("categories"), 0),
        at_most("rows of unlisted providers", F.col("providers"), 0),
    ])


def schedule_checks(schedule: DataFrame) -> DataFrame:
    """Rows with hours, minutes, slot lengths, closing or break times out of range."""
    def outside(name: str, low: int, high: int) -> Column:
        return ~F.coalesce(F.col(name), F.lit(low)).between(low, high)

    opens = F.col("start_hour") * 60 + F.coalesce("start_minute", F.lit(0))
    closes = F.col("end_hour") * 60 + F.coalesce("end_minute", F.lit(0))
    measures = schedule.agg(
        F.count_if(outside("day_of_week", 0, 6)).alias("days"),
        F.count_if(
            outside("start_hour", 0, 23) | outside("end_hour", 0, 23)
            | outside("break_start_hour", 0, 23) | outside("break_end_hour", 0, 23)).alias("hours"),
        F.count_if(outside("start_minute", 0, 59) | outside("end_minute", 0, 59)).alias("minutes"),
        F.count_if(outside("slot_minutes", 5, 240)).alias("slots"),
        F.count_if(closes <= opens).alias("order"),
        F.count_if(F.col("break_end_hour") <= F.col("break_start_hour")).alias("breaks"),
    )
    names = {"days": "day out of range", "hours": "hour out of range", "minutes": "minute out of range",
             "slots": "slot length out of range", "order": "end not after start", "breaks": "break end not after start"}
    return _rows("schedule", measures, [at_most(text, F.col(name), 0) for name, text in names.items()])


# -- informational tables -----------------------------------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def column_profile(df: DataFrame, columns: tuple[str, ...], day: str) -> DataFrame:
    """Missing share per column with the date bounds of the table, one scan."""
    scan = df.agg(*[_share(~present(F.col(c))).alias(c) for c in columns], F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_share")) for c in columns])
    return scan.select(F.inline(items), F.col("_lo").alias("first_date"), F.col("_hi").alias("last_date"))


def origin_split(charges: DataFrame, prefix: str = "eid_") -> DataFrame:
    """Rows by origin (interface or manual upload, told by the id prefix) and provider name."""
    origin = F.when(F.startswith(F.coalesce(F.col("encounter_id").cast("string"), F.lit("")), F.lit(prefix)),
                    F.lit("interface")).otherwise(F.lit("manual"))
    return charges.groupBy(origin.alias("origin"), "provider_raw").agg(F.count(F.lit(1)).alias("rows"))


def _last_periods(df: DataFrame, period: str, value: Column, cfg: PracticeConfig, keep: int) -> DataFrame:
    wide = df.filter(F.col("provider").isin(*cfg.providers)).groupBy(period).pivot(
        "provider", list(cfg.providers)).agg(value)
    filled = wide.select(period, *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(p) for p in cfg.providers])
    return filled.withColumn("_age", series.recency(period)).filter(F.col("_age") <= keep).drop("_age")


def provider_months(charges: DataFrame, aliases: DataFrame, cfg: PracticeConfig, keep: int = 12) -> DataFrame:
    """Rows per listed provider and month, newest months only."""
    named = rules.with_canonical_provider(charges, "provider_raw", aliases)
    dated = named.filter("service_date is not null").withColumn("month", dates.month_start(F.col("service_date")))
    return _last_periods(dated, "month", F.count(F.lit(1)), cfg, keep)


def provider_weeks(fact: DataFrame, cfg: PracticeConfig, keep: int = 16) -> DataFrame:
    """Points per listed provider and week, newest weeks only."""
    return _last_periods(fact.filter("week is not null"), "week", F.sum("rvu"), cfg, keep)


REQUIRED_CHARGES = tuple(name for name in S.CHARGE_HEADERS if name in (
    "Date Of Service", "Rendering Provider", "Service Charge Amount", "Pri Ins Insurance Payment",
    "Procedure Code", "Procedure Codes with Modifiers", "Patient ID", "Encounter ID"))
REQUIRED_EXAMS = ("Date of Service", "Focused DBQs", "Routine IMOs", "TBI", "Gen Med DBQs", "No Show")
