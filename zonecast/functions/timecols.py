"""Time expressions: local wall clock, calendar parts, hour buckets, cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
HOUR_US = 3_600_000_000


def local_time(col: Column, zone: str) -> Column:
    """Text to local wall clock: naive text is local, an offset is converted then dropped."""
    text = F.trim(col.cast("string"))
    instant = text.try_cast("timestamp").cast("timestamp_ntz")
    converted = F.convert_timezone(F.current_timezone(), F.lit(zone), instant)
    naive = F.substring(text, 1, 19).try_cast("timestamp_ntz")
    return F.when(text.rlike(_OFFSET), converted).otherwise(naive)


def parse_any_time(col: Column, zone: str) -> Column:
    """``local_time`` first, then slash dates and plain dates; null when nothing fits."""
    text = F.trim(col.cast("string"))
    patterns = ((r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}", 19, "yyyy/MM/dd HH:mm:ss"),)
    attempts = [local_time(col, zone)]
    for shape, width, fmt in patterns:
        parsed = F.try_to_timestamp(F.substring(text, 1, width), F.lit(fmt)).cast("timestamp_ntz")
        attempts.append(F.when(text.rlike(shape), parsed))
    attempts.append(F.substring(text, 1, 10).try_cast("timestamp_ntz"))
    return F.when(text != "", F.coalesce(*attempts))


def floor_hour(ts: Column) -> Column:
    """Start of the hour, kept as ``timestamp_ntz``."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hours(n: Column | int) -> Column:
    """``n`` hours as an interval."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0.0))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds between two wall-clock columns, as a double."""
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(1e6)


def epoch_micros(ts: Column) -> Column:
    """Wall-clock microseconds, read as if the clock were UTC.

    Session-independent: the difference to the epoch is taken on the wall clock.
    """
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def hour_bucket(hour: Column) -> Column:
    return (
        F.when((hour >= 7) & (hour < 10), "commute_am")
        .when((hour >= 10) & (hour < 15), "midday")
        .when((hour >= 15) & (hour < 20), "commute_pm")
        .when((hour >= 20) | (hour < 2), "late")
        .otherwise("overnight")
    )


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Monday=0), weekend flag, month, hour start and day name."""
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "month": F.month(ts),
        "hour_start": floor_hour(ts),
        "day_name": F.date_format(ts, "EEEE"),
    }


def with_calendar(df: DataFrame, ts: str, *names: str) -> DataFrame:
    parts = calendar_columns(F.col(ts))
    return df.withColumns({n: parts[n] for n in names})


def with_cycles(df: DataFrame) -> DataFrame:
    """Sine and cosine of ``hour`` and ``day_of_week``."""
    hs, hc = cyclical(F.col("hour"), 24)
    ds, dc = cyclical(F.col("day_of_week"), 7)
    return df.withColumns({"hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc})


def horizon_slug(minutes: int) -> str:
    return f"{minutes // 60}h" if minutes % 60 == 0 else f"{minutes}m"


def zone_target(minutes: int) -> str:
    return f"alert_next_{horizon_slug(minutes)}"


def activity_target(minutes: int) -> str:
    return f"activity_next_{horizon_slug(minutes)}"
