"""Money columns: cleaning, totals, allowed amount, payout tiers, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig, Tier

MONEY = "decimal(18,2)"
RATED = "decimal(22,6)"

# Fixed value: the number forms accepted after removing '$' and ','.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _stripped(text: Column) -> Column:
    return F.trim(F.translate(text.cast("string"), "$,", ""))


def is_money_text(text: Column) -> Column:
    """True where the text is a number once the currency marks are gone."""
    return F.coalesce(_stripped(text).rlike(NUMBER_PATTERN), F.lit(False))


def clean_money(text: Column) -> Column:
    """`$1,234.56` -> 1234.56; missing or unreadable text -> 0."""
    bare = _stripped(text)
    return F.coalesce(F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast(MONEY)), F.lit(0).cast(MONEY))


def loses_cents(text: Column) -> Column:
    """True where rounding to cents changed the value (reported by the quality checks)."""
    bare = _stripped(text)
    exact = F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast("decimal(38,10)"))
    return F.coalesce(exact != clean_money(text), F.lit(False))


def add_all(*parts: Column) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total.cast(MONEY)


def allowed_amount(charge: Column, adjustments: Column, payments: Column, cfg: PracticeConfig) -> Column:
    """Charge less adjustments; an untouched positive charge counts at the uncollected rate."""
    untouched = (adjustments == 0) & (payments == 0) & (charge > 0)
    rate = F.lit(cfg.uncollected_allowed_rate).cast("decimal(5,4)")
    return F.when(untouched, (charge * rate).cast(RATED)).otherwise((charge - adjustments).cast(RATED))


def model_revenue(allowed: Column, cfg: PracticeConfig) -> Column:
    return (allowed * F.lit(cfg.model_revenue_rate).cast("decimal(3,2)")).cast(RATED)


def tier_payout(points: Column, tiers: tuple[Tier, ...]) -> Column:
    """Marginal payout summed over the tiers."""
    total = F.lit(0.0)
    for tier in tiers:
        top = points if tier.cap is None else F.least(points, F.lit(tier.cap))
        total = total + F.greatest(F.lit(0), top - F.lit(tier.floor)) * F.lit(float(tier.rate))
    return total


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Double quotient, 0 where the denominator is not positive."""
    return F.when(
        denominator > 0, F.try_divide(numerator.cast("double"), denominator.cast("double"))
    ).otherwise(F.lit(0.0))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    if high is not None:
        value = F.least(value, F.lit(high))
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value
