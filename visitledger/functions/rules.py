"""Rule columns: productivity categories, exam fees, flags, thresholds, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitledger import config as C
from visitledger.config import PracticeConfig

RVU = "decimal(8,2)"


def services_text(codes: Column) -> Column:
    return F.upper(F.coalesce(codes, F.lit("")))


def clinical_rule_sql(rules=C.CLINICAL_RULES) -> str:
    """SQL CASE for the number (from 1) of the first matching rule; one past the last when none matches."""
    arms = " ".join(f"WHEN {rule.predicate} THEN {i}" for i, rule in enumerate(rules, 1))
    return f"CASE {arms} ELSE {len(rules) + 1} END"


def points_sql(rule: str, rules=C.CLINICAL_RULES) -> str:
    """SQL for the points of a rule number."""
    values = [r.rvu for r in rules] + [C.CLINICAL_DEFAULT[1]]
    return f"element_at(array({', '.join(f'CAST({v} AS {RVU})' for v in values)}), {rule})"


def category_sql(rule: str, rules=C.CLINICAL_RULES) -> str:
    values = [r.category for r in rules] + [C.CLINICAL_DEFAULT[0]]
    return f"element_at(array({', '.join(repr(v) for v in values)}), {rule})"


def with_clinical_rvu(df, codes: str, charge: str, row_columns: tuple[str, ...], cfg: PracticeConfig):
    """Add `rvu` and `category`. `row_columns` are the text columns searched by the row-wide rule.

    The rule number is its own projection, so the rule chain runs once per line for both outputs.
    """
    row_text = F.upper(F.concat_ws(" ", *[F.col(name).cast("string") for name in row_columns]))
    staged = df.withColumns({"services": services_text(F.col(codes)), "charge": F.col(charge), "row_text": row_text})
    added = [name for name in ("services", "charge", "row_text") if name not in df.columns]
    numbered = staged.withColumn("_rule", F.expr(clinical_rule_sql(cfg.clinical_rules))).drop(*added)
    return numbered.withColumns({
        "rvu": F.expr(points_sql("_rule", cfg.clinical_rules)),
        "category": F.expr(category_sql("_rule", cfg.clinical_rules)),
    }).drop("_rule")


def band(text: Column) -> Column:
    """Band or flag text as entered: trimmed, a spreadsheet's trailing `.0` removed, missing -> ''."""
    return F.regexp_replace(F.trim(F.coalesce(text.cast("string"), F.lit(""))), r"\.0$|^(?i:nan|none)$", "")


def is_no_show(text: Column) -> Column:
    return band(text) == "1"


def _lookup(key: Column, entries: dict[str, object], default: object) -> Column:
    """Value of a small literal table; the key is computed once."""
    table = ", ".join(f"{name!r}, {value!r}" for name, value in entries.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({table})"), key), F.lit(default))


def _band_fee(value: Column, fees: dict[str, int]) -> Column:
    return _lookup(value, fees, 0)


def exam_fee(focused: Column, opinions: Column, tbi: Column, genmed: Column, no_show: Column) -> Column:
    """Fee of one exam: the sum of its component bands, plus the no-show fee.

    Text such as `lab`, `visual screen` or `bp check`, a blank and an unknown band all count as no fee.
    """
    total = (
        _band_fee(band(focused), C.FOCUSED_FEES)
        + _band_fee(band(opinions), C.OPINION_FEES)
        + F.when(F.lower(band(tbi)).isin(*C.TBI_MARKS), F.lit(C.TBI_FEE)).otherwise(F.lit(0))
        + _band_fee(band(genmed), C.GENMED_FEES)
        + F.when(is_no_show(no_show), F.lit(C.NO_SHOW_FEE)).otherwise(F.lit(0))
    )
    return total.cast("decimal(18,2)")


def _exam_class(opinions: Column, no_show: Column, part: int) -> Column:
    none, few = C.EXAM_NO_OPINION[part], C.EXAM_FEW_OPINIONS[part]
    classes = {"0": none, "": none} | {name: few for name in C.FEW_OPINION_BANDS}
    by_band = _lookup(band(opinions), classes, C.EXAM_MANY_OPINIONS[part])
    return F.when(is_no_show(no_show), F.lit(C.EXAM_NO_SHOW[part])).otherwise(by_band)


def exam_rvu(opinions: Column, no_show: Column) -> Column:
    return _exam_class(opinions, no_show, 1).cast(RVU)


def exam_category(opinions: Column, no_show: Column) -> Column:
    return _exam_class(opinions, no_show, 0)


def name_matches(name: Column, fragment: str) -> Column:
    """Case-insensitive keyword flag; a missing name does not match."""
    return F.coalesce(F.contains(F.lower(name), F.lit(fragment.lower())), F.lit(False))


def threshold(week: Column, measure: str, cfg: PracticeConfig) -> Column:
    """The target in force at `week`; `measure` is a field of `Threshold`."""
    steps = sorted(cfg.thresholds, key=lambda step: step.valid_from)
    value = F.lit(getattr(steps[0], measure))
    for step in steps[1:]:
        value = F.when(week >= F.lit(step.valid_from), F.lit(getattr(step, measure))).otherwise(value)
    return value


def weekly_cost(week: Column, cfg: PracticeConfig) -> Column:
    """Cost of a week by its calendar quarter, else the default."""
    cost = F.lit(cfg.default_cost)
    for year, quarter, amount in cfg.quarter_costs:
        hit = (F.year(week) == year) & (F.quarter(week) == quarter)
        cost = F.when(hit, F.lit(amount)).otherwise(cost)
    return cost.cast("decimal(18,2)")


def normalize_name(name: Column) -> Column:
    """Upper-cased trimmed name, the key of the alias table."""
    return F.upper(F.trim(name))


def with_canonical_provider(df, raw: str, aliases, out: str = "provider"):
    """Left join on the alias table; an unknown name falls back to its upper-cased form, null stays null.

    A name listed twice stands for the first of its canonical names in text order, so no fact row is ever multiplied;
    `alias_conflicts` lists such names. The alias table is unhinted: Spark broadcasts it when its measured size allows and
    shuffles otherwise.
    """
    keyed = df.withColumn("_alias", normalize_name(F.col(raw)))
    names = aliases.groupBy(F.col("alias_norm").alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    joined = keyed.join(names, "_alias", "left")
    return joined.withColumn(out, F.coalesce("_canonical", "_alias")).drop("_alias", "_canonical")


def alias_conflicts(aliases):
    """Names that the alias table gives more than one canonical name: `(alias_norm, canonical_names, used)`."""
    listed = aliases.groupBy("alias_norm").agg(
        F.count_distinct("canonical").alias("canonical_names"), F.min("canonical").alias("used"))
    return listed.filter("canonical_names > 1")


def display_name(canonical: Column) -> Column:
    return F.initcap(F.lower(canonical))


def booking_status(external_id: Column) -> Column:
    return F.when(external_id.isNotNull(), F.lit("booked")).otherwise(F.lit("pending"))


def codes_with_modifiers(code: Column, *modifiers: Column) -> Column:
    """Procedure code followed by its non-blank modifiers."""
    parts = [F.nullif(F.trim(part), F.lit("")) for part in (code, *modifiers)]
    return F.concat_ws(" ", *parts)


def markup_only(xml: Column, max_chars: int | None = None) -> Column:
    """A payload with its text content removed, safe to log."""
    bare = F.regexp_replace(xml, ">([^<]+)<", "><")
    return bare if max_chars is None else F.substring(bare, 1, max_chars)
