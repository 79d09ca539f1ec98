"""City-wide activity features per target hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions.geo import safe_divide
from zonecast.functions.timecols import activity_target, hour_bucket, hours, with_calendar, with_cycles
from zonecast.functions.timecols import floor_hour, seconds_between
from zonecast.operators.windows import (
    axis_bounds,
    densify,
    distinct_active,
    hour_table,
    label_rows,
    merge_sparse,
    trailing,
)


def hourly_axis(events: DataFrame, lookback_hours: int) -> DataFrame:
    """Target hours: first hour plus the lookback through the last hour."""
    span = events.agg(floor_hour(F.min("ts")).alias("lo"), floor_hour(F.max("ts")).alias("hi"))
    start = F.col("lo") + hours(lookback_hours)
    return span.filter(start <= F.col("hi")).select(
        F.explode(F.sequence(start, F.col("hi"), hours(1))).alias("target_time")
    )


def effective_lookback(events: DataFrame, requested: int = 168, minimum: int = 3) -> DataFrame:
    """One row: history span and the lookback it allows."""
    span = F.coalesce(seconds_between(F.max("ts"), F.min("ts")) / F.lit(3600.0), F.lit(0.0))
    one = events.agg(span.alias("available_hours"))
    short = F.greatest(
        F.lit(minimum), F.greatest(F.lit(1.0), F.col("available_hours")).cast("int") - 1
    )
    return one.withColumn(
        "lookback_hours",
        F.when(F.col("available_hours") <= requested, short).otherwise(F.lit(requested)),
    )


def activity_features(
    events: DataFrame, horizon_minutes: int = 60, lookback_hours: int = 168
) -> DataFrame:
    """Trailing city counts, active districts and regions, and the activity label.

    The table has one row per hour, so its windows run on that small aggregate.
    """
    hourly = hour_table(events.withColumn("city", F.lit(0)), ["city", "district", "region"], horizon_minutes)
    lo, hi = axis_bounds(hourly)
    key = ["city"]
    own = hourly.groupBy("city", "hour").agg(F.sum("cnt").alias("cnt"))
    span = min(24, lookback_hours)
    active = lambda member, out: distinct_active(hourly, key, [member], span).withColumnRenamed(
        "step", out
    )
    sums = ["cnt", "fut", "sd", "sr"]
    sparse = merge_sparse(
        [own, label_rows(hourly, key, horizon_minutes), active("district", "sd"), active("region", "sr")],
        key,
        sums,
        lo,
        hi,
    )
    dense = densify(
        sparse,
        key,
        lo,
        hi,
        here=["fut"],
        totals={"c": "cnt"},
        levels={"active_districts_24h": "sd", "active_regions_24h": "sr"},
    )
    past = lambda h: trailing("c", min(h, lookback_hours), key)
    rows = dense.select(
        F.col("hour").alias("target_time"),
        past(1).alias("city_event_count_1h"),
        past(3).alias("city_event_count_3h"),
        past(24).alias("city_event_count_24h"),
        past(168).alias("city_event_count_7d"),
        "active_districts_24h",
        "active_regions_24h",
        F.col("fut").alias("event_count_next_horizon"),
    ).filter(F.col("target_time") >= lo + hours(lookback_hours))
    timed = with_cycles(with_calendar(rows, "target_time", "hour", "day_of_week", "is_weekend"))
    return timed.withColumns(
        {
            "hour_bucket": hour_bucket(F.col("hour")),
            "city_3h_to_24h_ratio": _ratio("city_event_count_3h", "city_event_count_24h"),
            "city_24h_to_7d_ratio": _ratio("city_event_count_24h", "city_event_count_7d"),
            activity_target(horizon_minutes): (F.col("event_count_next_horizon") > 0).cast("int"),
        }
    )


def _ratio(a: str, b: str) -> Column:
    return safe_divide(F.col(a), F.col(b))
