"""Free appointment slots of many providers and days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: appointment states that do not block a slot.
FREE_STATES = ("Cancelled", "No Show")


def _minutes(ts) -> F.Column:
    """Minutes since midnight of the clinic day `day`, fractional, negative before it."""
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.col("day").cast("timestamp"))) / 60_000_000.0


def working_days(schedule: DataFrame, days: DataFrame) -> DataFrame:
    """Active schedule rows of each day: one row per (provider, day); `days` has a `day` column."""
    dated = days.select("day").distinct().withColumn("day_of_week", F.weekday("day"))
    return schedule.filter("is_active").join(dated, "day_of_week").select(
        "provider", "day", "slot_minutes",
        (F.col("start_hour") * 60 + F.coalesce("start_minute", F.lit(0))).alias("opens"),
        (F.col("end_hour") * 60 + F.coalesce("end_minute", F.lit(0))).alias("closes"),
        (F.col("break_start_hour") * 60).alias("break_from"),
        (F.col("break_end_hour") * 60).alias("break_to"),
    )


def free_slots(schedule: DataFrame, days: DataFrame, appointments: DataFrame) -> DataFrame:
    """Slots `(provider, day, start_at, end_at, label)` not touched by an appointment or the break.

    Slots are a regular grid, so an appointment blocks a computable range of slot numbers. Each day's
    blocked numbers are collected as a set bounded by the slots of a day; appointments and slots meet by
    an equi join on (provider, day) with one working-day row each, never by comparing intervals pairwise.
    """
    work = working_days(schedule, days)
    busy = (
        appointments.filter(~F.coalesce(F.col("status").isin(*FREE_STATES), F.lit(False)))
        .filter("start_at is not null and end_at is not null")
        .select(
            "provider", "start_at", "end_at",
            F.explode(F.sequence(F.to_date("start_at"), F.greatest(F.to_date("start_at"), F.to_date("end_at")))).alias("day"),
        )
    )
    # Slot edges are whole minutes, so widening to whole minutes blocks the same slots; of the intervals that
    # begin in one minute only the longest matters. At most 1,440 rows per (provider, day) reach the join.
    blocking = busy.groupBy(
        "provider", "day", F.greatest(F.floor(_minutes(F.col("start_at"))), F.lit(0)).alias("from_min")
    ).agg(F.max(F.least(F.ceil(_minutes(F.col("end_at"))), F.lit(24 * 60))).alias("to_min"))
    count = F.floor((F.col("closes") - F.col("opens")) / F.col("slot_minutes")).cast("int")
    first = F.greatest(F.floor((F.col("from_min") - F.col("opens")) / F.col("slot_minutes")).cast("int"), F.lit(0))
    last = F.least(
        F.ceil((F.col("to_min") - F.col("opens")) / F.col("slot_minutes")).cast("int") - 1, count - 1
    )
    taken = (
        blocking.join(work, ["provider", "day"])
        .select("provider", "day", first.alias("first"), last.alias("last"))
        .filter("first <= last")
        .select("provider", "day", F.explode(F.sequence("first", "last")).alias("slot"))
        .groupBy("provider", "day")
        .agg(F.collect_set("slot").alias("taken"))
    )
    opened = work.withColumn("slots", count).filter("slots > 0")
    numbered = opened.join(taken, ["provider", "day"], "left").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")
    )
    begins = F.col("opens") + F.col("slot") * F.col("slot_minutes")
    ends = begins + F.col("slot_minutes")
    in_break = F.coalesce((begins < F.col("break_to")) & (ends > F.col("break_from")), F.lit(False))
    free = numbered.filter(~F.coalesce(F.array_contains("taken", F.col("slot")), F.lit(False)) & ~in_break)

    def at(minutes):
        return F.timestamp_add("MINUTE", minutes.cast("int"), F.col("day").cast("timestamp_ntz"))

    return free.select("provider", "day", at(begins).alias("start_at"), at(ends).alias("end_at")).withColumn(
        "label", F.date_format("start_at", "h:mm a")
    )
