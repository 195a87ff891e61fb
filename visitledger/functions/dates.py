"""Date columns: lenient parsing, week / month / quarter keys, local times."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLINIC_ZONE = "America/New_York"
MONTHS = (
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?")
#: Names by their first three letters, in the order of the months.
MONTH_ORDER = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAMED = rf"(?i)^({MONTHS})[.]? +([0-9]{{1,2}}),? +((?!0000)[0-9]{{4}})($|[ ])"
DAY_NAMED = rf"(?i)^([0-9]{{1,2}})(?:[ ]+|-)({MONTHS})[.]?,?(?:[ ]+|-)((?!0000)[0-9]{{4}})($|[ ])"
#: Day and month as numbers, in either order, and what stands between them and the year.
NUMBERED = r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})($|[ ])"


def _part(text: Column, mark: str, number: int) -> Column:
    return F.substring_index(F.substring_index(text, mark, number), mark, -1)


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """The day of three numbers in text; null for a year 0 or a month that is none, without the cost of a failed parse."""
    possible = month.cast("int").between(1, 12) & (year != "0000")
    return F.when(possible, F.concat_ws("-", year, month, day).try_cast("date"))


def _numbered(day: Column, mark: str, day_first: Column | None) -> Column:
    """Numbers in the usual order (month first, or as `day_first` says), else in the other one."""
    first, second, last = (_part(day, mark, i) for i in (1, 2, 3))
    year = F.when(F.length(last) == 4, last).otherwise(F.concat(F.when(last >= "69", F.lit("19")).otherwise(F.lit("20")), last))
    month_first, other = _ymd(year, first, second), _ymd(year, second, first)
    usual = F.coalesce(month_first, other)
    return usual if day_first is None else F.when(day_first, F.coalesce(other, month_first)).otherwise(usual)


def parse_date(text: Column, day_first: Column | None = None) -> Column:
    """Date text -> DATE, anything else -> NULL. A time of day after a blank is ignored.

    Forms: `1/15/2023`, `1-15-2023`, `1.15.2023`, with two-digit years `1/15/23`, `2023-01-15`, `2023/1/15`, `20230115`,
    `Jan 15, 2023`, `15 Jan 2023`, `15-Jan-2023` (or the whole month name). Numbers are month and day; where only day and month
    fits (`15/1/2023`) they are that, and where both fit `day_first` decides (see `day_first_by`). Two-digit years from 69 on
    are of the last century.
    """
    text = F.trim(text.cast("string"))
    day, digit = F.substring_index(text, " ", 1), (text >= "0") & (text < ":")
    # Cheap tests stand before the patterns: most texts need one or two of these.
    slashed = F.contains(day, F.lit("/"))
    iso = digit & (F.substring(text, 5, 1) == "-") & text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")
    year_first = slashed & text.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}(\z|[ ])")
    compact = digit & (F.length(day) == 8) & text.rlike(r"^(19|20)[0-9]{6}(\z|[ ])")

    def numbered(mark: str, escaped: str) -> Column:
        form = rf"^[0-9]{{1,2}}{escaped}[0-9]{{1,2}}{escaped}([0-9]{{4}}|[0-9]{{2}})(\z|[ ])"
        return F.when(digit & F.contains(day, F.lit(mark)) & text.rlike(form), _numbered(day, mark, day_first))

    def named(pattern: str, name: Column, number: int) -> Column:
        month = (F.position(F.lower(F.substring(name, 1, 3)), F.lit(MONTH_ORDER)) + 2) / 3
        parts = F.regexp_extract(text, pattern, 3), month.cast("int").cast("string"), F.regexp_extract(text, pattern, number)
        return F.concat_ws("-", *parts).try_cast("date")

    return (
        F.when(slashed & ~year_first, numbered("/", "/"))
        .when(iso, text.try_cast("date"))
        .when(year_first, _ymd(*(_part(day, "/", i) for i in (1, 2, 3))))
        .when(compact, _ymd(F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
        .when(~digit & text.rlike(MONTH_NAMED), named(MONTH_NAMED, text, 2))
        .when(digit & text.rlike(DAY_NAMED), named(DAY_NAMED, F.regexp_extract(text, DAY_NAMED, 2), 1))
        .otherwise(F.coalesce(numbered("-", "-"), numbered(".", "[.]")))
    )


def day_first_vote(text: Column) -> Column:
    """1 for a numbered date that is only read with the day first, -1 for one with the month first, 0 for all else."""
    text = F.trim(text.cast("string"))
    first, second = (F.regexp_extract(text, NUMBERED, i).try_cast("int") for i in (1, 3))
    return F.when((first > 12) & (second <= 12), F.lit(1)).when((second > 12) & (first <= 12), F.lit(-1)).otherwise(F.lit(0))


def day_first_by(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """`(*by, day_first)`: whether a column's numbered dates have the day first, told by all rows of the group (a file, say)
    whose order is certain. A group without such rows keeps the month first."""
    return df.groupBy(*by).agg((F.coalesce(F.sum(day_first_vote(F.col(column))), F.lit(0)) > 0).alias("day_first"))


def with_elected_dates(df: DataFrame, column: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """`out` (by default `column` itself) as DATE, the order of day and month elected for each group."""
    if by:
        names = [f"_{name}" for name in by]
        elected = day_first_by(df, column, by).withColumnsRenamed(dict(zip(by, names)))
        same = [F.col(name).eqNullSafe(F.col(other)) for name, other in zip(by, names)]
        joined = df.join(elected, reduce(and_, same)).drop(*names)
        order = F.col("day_first")
    else:
        joined, order = df, day_first_by(df, column).scalar()
    return joined.withColumn(out or column, parse_date(F.col(column), order)).drop("day_first")


def unreadable_dates(df: DataFrame, column: str, parsed: str) -> DataFrame:
    """Rows with a date text that no form fits."""
    return df.filter((F.trim(F.col(column)) != "") & F.col(parsed).isNull())


def us_date_text(day: Column) -> Column:
    """`M/D/YYYY` without leading zeros, the export form."""
    return F.date_format(day, "M/d/yyyy")


def week_end(day: Column, ends_on: str = "FRI") -> Column:
    """The week-ending day on or after the date; `ends_on` is a day name such as FRI, MON or SUN."""
    return F.next_day(F.date_sub(day, 1), ends_on)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def next_quarter_start(day: Column) -> Column:
    return F.add_months(quarter_start(day), 3)


def quarter_label(day: Column) -> Column:
    """`Q1 2026`."""
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))


def quarter_key(day: Column) -> Column:
    """`2026Q1`, sorts by time."""
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def half_month_key(day: Column) -> Column:
    """`2026-01-H1` up to the 15th, `-H2` after."""
    half = F.when(F.dayofmonth(day) <= 15, F.lit("-H1")).otherwise(F.lit("-H2"))
    return F.concat(F.date_format(day, "yyyy-MM"), half)


def weekday_index(day: Column) -> Column:
    """0 = Monday."""
    return F.weekday(day)


def clinic_local(ts: Column) -> Column:
    """UTC instant -> clinic wall-clock time."""
    return F.from_utc_timestamp(ts, CLINIC_ZONE)


def slot_label(ts: Column) -> Column:
    """`9:00 AM`."""
    return F.date_format(ts, "h:mm a")


def quarter_bounds(day: date) -> tuple[date, date]:
    """First day of the quarter of `day` and first day of the next one."""
    first = 3 * ((day.month - 1) // 3) + 1
    start = date(day.year, first, 1)
    return start, date(day.year + (first == 10), 1 if first == 10 else first + 3, 1)
