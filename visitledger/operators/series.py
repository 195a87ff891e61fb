"""Weekly and monthly series: windows, grids, runs, regression.

Windows without a partition key are used on week or month grain only, where the calendar bounds the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(order: str, by: tuple[str, ...], descending: bool = False):
    window = Window.partitionBy(*by) if by else Window.partitionBy()
    return window.orderBy(F.col(order).desc() if descending else F.col(order).asc())


def rolling_mean(value: Column, order: str, rows: int, by: tuple[str, ...] = ()) -> Column:
    """Mean of the last `rows` rows present, fewer at the start. The sum stays exact for decimals."""
    frame = _ordered(order, by).rowsBetween(-(rows - 1), 0)
    return F.sum(value).over(frame).cast("double") / F.count(value).over(frame)


def running_sum(value: Column, order: str, by: tuple[str, ...] = ()) -> Column:
    return F.sum(value).over(_ordered(order, by).rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(value: Column, order: str, by: tuple[str, ...] = ()) -> Column:
    return F.last(value, ignorenulls=True).over(_ordered(order, by).rowsBetween(Window.unboundedPreceding, 0))


def recency(order: str, by: tuple[str, ...] = ()) -> Column:
    """1 for the newest row."""
    return F.row_number().over(_ordered(order, by, descending=True))


def position(order: str, by: tuple[str, ...] = ()) -> Column:
    """0 for the oldest row."""
    return F.row_number().over(_ordered(order, by)) - 1


def change_pct(value: Column, order: str, by: tuple[str, ...] = (), limit: float = 200.0) -> Column:
    """Percent change on the row before, clipped; from zero it is the limit, zero to zero is 0."""
    before = F.lag(value).over(_ordered(order, by)).cast("double")
    now = value.cast("double")
    change = (
        F.when(before.isNull() | ((before == 0) & (now == 0)), F.lit(0.0))
        .when(before == 0, F.signum(now) * limit)
        .otherwise((F.try_divide(now, before) - 1.0) * 100.0)
    )
    return F.least(F.greatest(change, F.lit(-limit)), F.lit(limit))


def provider_week_grid(
    weekly: DataFrame, providers: tuple[str, ...], value: str, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Every week of `weekly` for every listed provider, 0 where nothing happened.

    `weekly` has one row per (provider, week). Each week keeps a map of the listed providers only, so its
    size is bounded by the registry, and no join against a calendar is needed. `week_count` is the number
    of weeks of the whole grid; weeks of unlisted providers count too.
    """
    listed = F.when(F.col("provider").isin(*providers), F.struct("provider", value))
    by_week = weekly.groupBy("week").agg(F.map_from_entries(F.collect_list(listed)).alias("_values"))
    counted = by_week.withColumn("week_count", F.count(F.lit(1)).over(Window.partitionBy()))
    names = F.explode(F.array(*[F.lit(name) for name in providers])).alias("provider")
    grid = counted.select("week", "week_count", "_values", names)
    found = F.try_element_at(F.col("_values"), F.col("provider"))
    return grid.select("week", "provider", "week_count", F.coalesce(found, F.lit(0)).alias(value))


def longest_run(series: DataFrame, order: str, condition: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Longest run of consecutive rows that meet the condition, and whether any row does."""
    marked = series.select(*by, F.col(order), condition.alias("_hit"), position(order, by).alias("_pos"))
    hits = marked.filter("_hit").withColumn(
        "_island", F.col("_pos") - F.row_number().over(_ordered(order, by))
    )
    runs = hits.groupBy(*by, "_island").agg(F.count(F.lit(1)).alias("_length"))
    return runs.groupBy(*by).agg(F.coalesce(F.max("_length"), F.lit(0)).alias("longest_run"))


def weekly_calendar(totals: DataFrame, week: str, value: str) -> DataFrame:
    """Fill the weeks missing between the first and the last with 0."""
    bounds = totals.agg(F.min(week).alias("lo"), F.max(week).alias("hi"))
    weeks = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 7 DAYS"))).alias(week))
    return weeks.join(totals, week, "left").select(week, F.coalesce(value, F.lit(0)).alias(value))


def regression(y: Column, x: Column) -> dict[str, Column]:
    """Least-squares fit as aggregate columns."""
    return {
        "slope": F.regr_slope(y, x),
        "intercept": F.regr_intercept(y, x),
        "r2": F.coalesce(F.regr_r2(y, x), F.lit(0.0)),
        "n": F.regr_count(y, x),
    }


def regression_p_value(r2: Column, n: Column) -> Column:
    """Two-sided p-value of the slope, from the finite series of the t distribution with n-2 degrees of freedom."""
    freedom = (n - 2).cast("int")
    sine, cosine = F.sqrt(r2), F.sqrt(F.lit(1.0) - r2)
    odd = freedom % 2 == 1
    first = F.when(odd, cosine).otherwise(F.lit(1.0))
    start = F.when(odd, F.lit(3)).otherwise(F.lit(2))
    terms = F.when(freedom - 2 >= start, F.sequence(start, F.greatest(freedom - 2, start), F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )
    state = F.aggregate(
        terms,
        F.struct(first.alias("term"), first.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * cosine * cosine * (k - 1) / k).alias("term"),
            (acc["total"] + acc["term"] * cosine * cosine * (k - 1) / k).alias("total"),
        ),
    )
    angle = F.atan2(sine, cosine)
    series = F.when(freedom == 1, F.lit(0.0)).otherwise(state["total"])
    inside = F.when(odd, (angle + sine * series) * (2.0 / math.pi)).otherwise(sine * series)
    return F.when(freedom >= 1, F.greatest(F.lit(1.0) - inside, F.lit(0.0)))
