"""Past-only features per (target time, square cell), and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.functions.geo import cell_name, cell_part, safe_divide
from zonecast.functions.timecols import hours, seconds_between, with_calendar
from zonecast.operators.windows import (
    axis_bounds,
    before,
    densify,
    distinct_active,
    hour_table,
    merge_sparse,
    trailing,
)
from zonecast.session import materialize

NEVER_HOURS = 9999.0


def cell_hours(events: DataFrame) -> DataFrame:
    """Stored hour table per (cell, district): counts, votes, first and last event."""
    return hour_table(
        events,
        ["grid_cell", "district"],
        60,
        F.sum("total_upvotes").alias("up"),
        F.sum("total_downvotes").alias("down"),
        F.sum("report_count").alias("reports"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min(F.struct("ts", "event_id", "district", "region")).alias("first"),
    )


def cell_universe(hourly: DataFrame) -> DataFrame:
    """Every cell with the district and region of its first event."""
    return hourly.groupBy("grid_cell").agg(F.min("first").alias("f")).select(
        "grid_cell", F.col("f.district").alias("district"), F.col("f.region").alias("region")
    )


def around_cells(cell: Column, step: float = 0.005) -> Column:
    """Names of the eight surrounding lattice cells."""
    i, j = cell_part(cell, 1, step), cell_part(cell, 2, step)
    return F.array(
        *[
            cell_name(i + di, j + dj, step)
            for di in (-1, 0, 1)
            for dj in (-1, 0, 1)
            if (di, dj) != (0, 0)
        ]
    )


def streak_start(hourly: DataFrame) -> DataFrame:
    """First moment a cell has two consecutive active days behind it."""
    days = hourly.groupBy("grid_cell", F.to_date("hour").alias("day")).agg(
        F.min("first_ts").alias("day_first")
    )
    w = W.partitionBy("grid_cell").orderBy("day")
    gap = F.datediff("day", F.lag("day").over(w))
    return (
        days.withColumn("_gap", gap)
        .groupBy("grid_cell")
        .agg(F.min(F.when(F.col("_gap") == 1, F.col("day_first"))).alias("streak_from"))
    )


def _whole_days(later: Column, earlier: Column) -> Column:
    return F.floor(seconds_between(later, earlier) / F.lit(86400.0))


def _cell_rows(hourly: DataFrame, window_hours: int, lo, hi) -> DataFrame:
    own = hourly.groupBy("grid_cell", "hour").agg(
        *[F.sum(c).alias(c) for c in ("cnt", "up", "down", "reports")],
        F.max("last_ts").alias("last_ts"),
    )
    universe = hourly.select("grid_cell").distinct()
    near = (
        own.select("cnt", "hour", F.explode(around_cells(F.col("grid_cell"))).alias("grid_cell"))
        .join(universe, "grid_cell", "left_semi")
        .groupBy("grid_cell", "hour")
        .agg(F.sum("cnt").alias("near"))
    )
    sums = ["cnt", "up", "down", "reports", "near"]
    sparse = merge_sparse([own, near], ["grid_cell"], sums, lo, hi, latest="last_ts")
    key = ["grid_cell"]
    dense = densify(
        sparse,
        key,
        lo,
        hi,
        here=["cnt"],
        totals={"c": "cnt", "u": "up", "d": "down", "r": "reports", "n": "near"},
        latest={"seen": "last_ts"},
    )
    ahead = W.partitionBy(*key).orderBy("hour").rowsBetween(0, window_hours - 1)
    return dense.select(
        "grid_cell",
        F.col("hour").alias("target_time"),
        F.col("c").alias("cell_historical_freq"),
        trailing("c", 168, key).alias("cell_7d_count"),
        trailing("c", 24, key).alias("cell_24h_count"),
        F.coalesce(
            seconds_between(F.col("hour"), F.col("seen")) / F.lit(3600.0), F.lit(NEVER_HOURS)
        ).alias("cell_last_seen_hours_ago"),
        F.when(F.col("u") + F.col("d") > 0, F.col("u") / (F.col("u") + F.col("d")))
        .otherwise(F.lit(0.5))
        .alias("upvote_ratio"),
        safe_divide(F.col("r"), F.col("c")).alias("avg_report_count"),
        trailing("n", 24, key).alias("neighbor_24h_count"),
        (F.sum("cnt").over(ahead) > 0).cast("int").alias("has_event"),
    )


def _district_rows(hourly: DataFrame, lo, hi) -> DataFrame:
    key = ["district"]
    own = hourly.groupBy("district", "hour").agg(F.sum("cnt").alias("cnt"))
    first = hourly.groupBy("district").agg(F.min("first_ts").alias("since"))
    sparse = merge_sparse(
        [own, distinct_active(hourly, key, ["grid_cell"])], key, ["cnt", "step"], lo, hi
    )
    dense = densify(sparse, key, lo, hi, ["cnt"], {"c": "cnt"}, {"district_active_cells": "step"})
    at_hour = F.coalesce(F.sum("cnt").over(before([*key, F.hour("hour")])), F.lit(0))
    days = F.greatest(_whole_days(F.col("hour"), F.col("since")), F.lit(1))
    return dense.withColumn("_same", at_hour).join(first, "district").select(
        "district",
        F.col("hour").alias("target_time"),
        trailing("c", 24, key).alias("district_24h_count"),
        "district_active_cells",
        F.when(F.col("c") > 0, F.col("c") / days).otherwise(F.lit(0.0)).alias("district_historical_rate"),
        F.when(F.col("c") > 0, F.col("_same") / days).otherwise(F.lit(0.0)).alias("district_hour_rate"),
    )


def _global_rows(hourly: DataFrame, lo, hi) -> DataFrame:
    """Rates of the whole table per target hour: one row per hour that has an event."""
    own = hourly.groupBy("hour").agg(F.sum("cnt").alias("cnt")).withColumn("city", F.lit(0))
    since = hourly.agg(F.min("first_ts").alias("m")).scalar()
    dense = densify(own, ["city"], lo, hi, here=["cnt"], totals={"c": "cnt"})
    hod, dow = F.hour("hour"), F.weekday(F.col("hour"))
    days = _whole_days(F.col("hour"), since)
    weeks = F.greatest(F.floor(days / F.lit(7.0)), F.lit(1))
    with_past = dense.withColumns(
        {
            "_h": F.coalesce(F.sum("cnt").over(before(["city", hod])), F.lit(0)),
            "_dh": F.coalesce(F.sum("cnt").over(before(["city", hod, dow])), F.lit(0)),
        }
    )
    return with_past.filter("cnt > 0").select(
        F.col("hour").alias("target_time"),
        F.when(F.col("c") > 0, F.col("_h") / F.greatest(days, F.lit(1)))
        .otherwise(F.lit(0.0))
        .alias("hour_historical_rate"),
        F.when(F.col("c") > 0, F.col("_dh") / weeks).otherwise(F.lit(0.0)).alias("dow_hour_rate"),
    )


def cell_features(events: DataFrame, window_hours: int = 1) -> DataFrame:
    """Training rows: every cell at every floor-hour that has an event."""
    hourly = cell_hours(events)
    lo, hi = axis_bounds(hourly)
    rows = _cell_rows(hourly, window_hours, lo, hi).join(_global_rows(hourly, lo, hi), "target_time")
    placed = rows.join(cell_universe(hourly), "grid_cell").join(
        streak_start(hourly), "grid_cell"
    )
    joined = placed.join(_district_rows(hourly, lo, hi), ["district", "target_time"], "left")
    filled = joined.withColumns(
        {
            "streak_active": F.coalesce(
                (F.col("streak_from") < F.col("target_time")).cast("int"), F.lit(0)
            ),
            **{
                c: F.coalesce(c, F.lit(0))
                for c in ("district_24h_count", "district_active_cells")
            },
            **{
                c: F.coalesce(c, F.lit(0.0))
                for c in ("district_historical_rate", "district_hour_rate")
            },
        }
    ).drop("streak_from")
    return with_calendar(filled, "target_time", "hour", "day_of_week", "is_weekend", "month")


def cell_features_at(events: DataFrame, at: Column) -> DataFrame:
    """Features of every cell at one arbitrary moment, from raw events before it."""
    t = at.cast("timestamp_ntz")
    past = F.col("ts") < t
    recent = past & (F.col("ts") >= t - hours(24))
    week = past & (F.col("ts") >= t - hours(168))
    same_hour = past & (F.hour("ts") == F.hour(t))
    n = lambda c: F.count(F.when(c, 1))
    tagged = materialize(
        events.groupBy("grid_cell", "district").agg(
            n(past).alias("c"),
            n(week).alias("w"),
            n(recent).alias("d1"),
            n(same_hour).alias("h"),
            n(same_hour & (F.weekday("ts") == F.weekday(t))).alias("dh"),
            F.max(F.when(past, F.col("ts"))).alias("seen"),
            F.min(F.when(past, F.col("ts"))).alias("since"),
            F.coalesce(F.sum(F.when(past, F.col("total_upvotes"))), F.lit(0)).alias("u"),
            F.coalesce(F.sum(F.when(past, F.col("total_downvotes"))), F.lit(0)).alias("v"),
            F.coalesce(F.sum(F.when(past, F.col("report_count"))), F.lit(0)).alias("r"),
            F.min(F.struct("ts", "event_id", "district", "region")).alias("first"),
        )
    )
    cells = tagged.groupBy("grid_cell").agg(
        *[F.sum(c).alias(c) for c in ("c", "w", "d1", "u", "v", "r")],
        F.max("seen").alias("seen"),
        F.min("first").alias("f"),
    )
    near = (
        tagged.filter("d1 > 0")
        .select("d1", F.explode(around_cells(F.col("grid_cell"))).alias("grid_cell"))
        .groupBy("grid_cell")
        .agg(F.sum("d1").alias("neighbor_24h_count"))
    )
    days = lambda since: F.greatest(_whole_days(t, since), F.lit(1))
    district = tagged.groupBy("district").agg(
        F.sum("d1").alias("district_24h_count"),
        F.count(F.when(F.col("d1") > 0, 1)).alias("district_active_cells"),
        safe_divide(F.sum("c"), days(F.min("since"))).alias("district_historical_rate"),
        safe_divide(F.sum("h"), days(F.min("since"))).alias("district_hour_rate"),
    )
    one = tagged.agg(
        safe_divide(F.sum("h"), days(F.min("since"))).alias("hour_historical_rate"),
        safe_divide(
            F.sum("dh"), F.greatest(F.floor(_whole_days(t, F.min("since")) / F.lit(7.0)), F.lit(1))
        ).alias("dow_hour_rate"),
    )
    streak = streak_start(cell_hours(events.filter(past)))
    rows = cells.select(
        "grid_cell",
        F.col("f.district").alias("district"),
        F.col("f.region").alias("region"),
        t.alias("target_time"),
        F.col("c").alias("cell_historical_freq"),
        F.col("w").alias("cell_7d_count"),
        F.col("d1").alias("cell_24h_count"),
        F.coalesce(seconds_between(t, F.col("seen")) / F.lit(3600.0), F.lit(NEVER_HOURS)).alias(
            "cell_last_seen_hours_ago"
        ),
        F.when(F.col("u") + F.col("v") > 0, F.col("u") / (F.col("u") + F.col("v")))
        .otherwise(F.lit(0.5))
        .alias("upvote_ratio"),
        safe_divide(F.col("r"), F.col("c")).alias("avg_report_count"),
        F.coalesce(one.select("hour_historical_rate").scalar(), F.lit(0.0)).alias("hour_historical_rate"),
        F.coalesce(one.select("dow_hour_rate").scalar(), F.lit(0.0)).alias("dow_hour_rate"),
    )
    joined = rows.join(near, "grid_cell", "left").join(district, "district", "left").join(
        streak, "grid_cell", "left"
    )
    return with_calendar(
        joined.withColumns(
            {
                "neighbor_24h_count": F.coalesce("neighbor_24h_count", F.lit(0)),
                "streak_active": F.col("streak_from").isNotNull().cast("int"),
            }
        ).drop("streak_from"),
        "target_time",
        "hour",
        "day_of_week",
        "is_weekend",
        "month",
    )
