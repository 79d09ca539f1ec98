"""Past-only features and labels per (target hour, zone)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions import geo
from zonecast.functions.geo import MISSING_DISTANCE_M, haversine_m, safe_divide
from zonecast.functions.stations import URBAN_CORE
from zonecast.functions.timecols import (
    hour_bucket,
    hours,
    seconds_between,
    with_calendar,
    with_cycles,
    zone_target,
)
from zonecast.operators.nearest import close_places, nearest_join
from zonecast.operators.spatial import neighbors
from zonecast.operators.windows import (
    axis_bounds,
    coverage_deltas,
    densify,
    distinct_active,
    hour_table,
    label_rows,
    merge_sparse,
    trailing,
    same_hour_sum,
)
from zonecast.scale import group_ranks
from zonecast.session import materialize

NEVER_HOURS = 9999.0


def zone_hours(events: DataFrame, horizon_minutes: int) -> DataFrame:
    """Stored hour table of (zone, district, region) with the last event of each hour."""
    return hour_table(
        events,
        ["zone_id", "district", "region"],
        horizon_minutes,
        F.max(F.struct("ts", "event_id", "district", "region")).alias("latest"),
    )


def _zone_sparse(hourly: DataFrame, horizon_minutes: int, lo, hi) -> DataFrame:
    """Everything a zone's hours need, one row per (zone, hour) that has any of it."""
    own = hourly.groupBy("zone_id", "hour").agg(
        F.sum("cnt").alias("cnt"), F.max("latest").alias("latest")
    )
    universe = hourly.select("zone_id").distinct()

    def spread(table: DataFrame, ring: int, source: str, out: str) -> DataFrame:
        near = neighbors(table, ring).join(
            universe.withColumnRenamed("zone_id", "neighbor_id"), "neighbor_id", "left_semi"
        )
        return near.groupBy(F.col("neighbor_id").alias("zone_id"), "hour").agg(F.sum(source).alias(out))

    active = coverage_deltas(own.select("zone_id", "hour"), ["zone_id"], 24)
    parts = [
        own,
        label_rows(hourly, ["zone_id"], horizon_minutes),
        spread(own.select("zone_id", "hour", "cnt"), 1, "cnt", "n1"),
        spread(own.select("zone_id", "hour", "cnt"), 2, "cnt", "n2"),
        spread(active, 1, "step", "a1"),
        spread(active, 2, "step", "a2"),
    ]
    return merge_sparse(
        parts, ["zone_id"], ["cnt", "fut", "n1", "n2", "a1", "a2"], lo, hi, latest="latest"
    )


def _district_hours(hourly: DataFrame, lookback_hours: int, lo, hi) -> DataFrame:
    """Trailing district counts per (district, hour)."""
    key = ["district"]
    own = hourly.groupBy("district", "hour").agg(F.sum("cnt").alias("cnt"))
    sparse = merge_sparse(
        [own, distinct_active(hourly, key, ["zone_id"])], key, ["cnt", "step"], lo, hi
    )
    dense = densify(
        sparse, key, lo, hi, ["cnt"], {"c": "cnt"}, {"district_active_zones_24h": "step"}
    )
    return dense.select(
        F.col("district").alias("_d"),
        F.col("hour").alias("target_time"),
        trailing("c", min(3, lookback_hours), key).alias("district_event_count_3h"),
        trailing("c", min(24, lookback_hours), key).alias("district_event_count_24h"),
        "district_active_zones_24h",
        safe_divide(
            same_hour_sum("cnt", lookback_hours // 24, key), trailing("c", lookback_hours, key)
        ).alias("district_same_hour_rate"),
    )


def _city_totals(hourly: DataFrame, lookback_hours: int, lo, hi) -> DataFrame:
    """Events of the whole table in the lookback, per hour (one row per hour)."""
    own = hourly.groupBy("hour").agg(F.sum("cnt").alias("cnt")).withColumn("city", F.lit(0))
    dense = densify(own, ["city"], lo, hi, totals={"c": "cnt"})
    return dense.select(
        F.col("hour").alias("target_time"), trailing("c", lookback_hours, ["city"]).alias("_history")
    )


def zone_base_features(
    events: DataFrame,
    lookback_days: int = 7,
    horizon_minutes: int = 120,
    resolution: int = geo.DEFAULT_RESOLUTION,
    urban_core: Sequence[str] = URBAN_CORE,
) -> DataFrame:
    """Counts, recency, rates, neighbour counts and label per (target hour, zone).

    Only (zone, hour) aggregates are shuffled. The dense hour axis is generated
    after that shuffle and all zone columns come from windows on the same
    partitioning.
    """
    hourly = zone_hours(events, horizon_minutes)
    lo, hi = axis_bounds(hourly)
    look = lookback_days * 24
    key = ["zone_id"]
    dense = densify(
        _zone_sparse(hourly, horizon_minutes, lo, hi),
        key,
        lo,
        hi,
        here=["cnt", "fut"],
        totals={"c": "cnt", "r1": "n1", "r2": "n2"},
        levels={"neighbor_active_zones_24h": "a1", "ring2_active_zones_24h": "a2"},
        latest={"_seen": "latest"},
    )
    windows = {"1h": 1, "3h": 3, "24h": 24, "7d": 168}
    cols = {f"zone_event_count_{n}": trailing("c", min(h, look), key) for n, h in windows.items()}
    cols |= {f"neighbor_event_count_{n}": trailing("r1", min(windows[n], look), key) for n in ("3h", "24h", "7d")}
    cols |= {f"ring2_event_count_{n}": trailing("r2", min(windows[n], look), key) for n in ("24h", "7d")}
    run = dense.withColumns(
        {
            **cols,
            "_total": trailing("c", look, key),
            "_past": same_hour_sum("cnt", lookback_days, key),
        }
    )
    rows = run.filter(F.col("hour") >= lo + hours(look)).withColumnRenamed("hour", "target_time")

    known = F.col("_total") > 0
    last = F.when(known, F.col("_seen"))
    q, r = geo.hex_qr(F.col("zone_id"))
    zlat, zlng = geo.hex_center(q, r, resolution)
    rows = rows.select(
        "target_time",
        "zone_id",
        F.lit(resolution).alias("zone_resolution"),
        F.coalesce(last["district"], F.lit("Unknown")).alias("district"),
        F.coalesce(last["region"], F.lit("Unknown")).alias("region"),
        zlat.alias("zone_lat"),
        zlng.alias("zone_lng"),
        *cols,
        "neighbor_active_zones_24h",
        "ring2_active_zones_24h",
        F.coalesce(
            seconds_between(F.col("target_time"), last["ts"]) / F.lit(3600.0), F.lit(NEVER_HOURS)
        ).alias("zone_hours_since_last_event"),
        safe_divide(F.col("_past"), F.col("_total")).alias("zone_same_hour_rate"),
        F.col("fut").alias("event_count_next_horizon"),
        (F.col("fut") > 0).cast("int").alias(zone_target(horizon_minutes)),
    )
    history = _city_totals(hourly, look, lo, hi).filter("_history > 0").select("target_time")
    rows = rows.join(history, "target_time", "left_semi")
    dist = _district_hours(hourly, look, lo, hi)
    joined = rows.join(
        dist.withColumnRenamed("_d", "district"), ["target_time", "district"], "left"
    ).withColumns(
        {
            c: F.coalesce(c, F.lit(0))
            for c in ("district_event_count_3h", "district_event_count_24h", "district_active_zones_24h")
        }
        | {"district_same_hour_rate": F.coalesce("district_same_hour_rate", F.lit(0.0))}
    )
    timed = with_calendar(joined, "target_time", "hour", "day_of_week", "is_weekend")
    return timed.withColumns(
        {
            "hour_bucket": hour_bucket(F.col("hour")),
            "is_urban_core": F.col("district").isin(*urban_core).cast("int"),
        }
    )


# --- engineered columns -----------------------------------------------------------


def add_ratios(df: DataFrame) -> DataFrame:
    r = lambda a, b: safe_divide(F.col(a), F.col(b))
    return df.withColumns(
        {
            "zone_3h_to_24h_ratio": r("zone_event_count_3h", "zone_event_count_24h"),
            "zone_24h_to_7d_ratio": r("zone_event_count_24h", "zone_event_count_7d"),
            "district_3h_to_24h_ratio": r("district_event_count_3h", "district_event_count_24h"),
        }
    )


def add_ring(df: DataFrame, ring: int) -> DataFrame:
    """Counts over the zones of one ring that are present at the same time.

    Rows with a zero 7-day count add nothing, so only the others are sent to
    their neighbours, already summed per receiving row before the shuffle. The sums
    are not broadcast: Spark would not count that each row goes to many neighbours.
    """
    name = {1: "neighbor", 2: "ring2"}[ring]
    windows = ("3h", "24h", "7d") if ring == 1 else ("24h", "7d")
    sources = [f"zone_event_count_{n}" for n in ("3h", "24h", "7d")]
    senders = df.select("target_time", "zone_id", *sources).filter(
        " OR ".join(f"{c} > 0" for c in sources)
    )
    got = (
        neighbors(senders, ring)
        .groupBy("target_time", F.col("neighbor_id").alias("zone_id"))
        .agg(
            *[F.sum(f"zone_event_count_{n}").alias(f"{name}_event_count_{n}") for n in windows],
            F.count(F.when(F.col("zone_event_count_24h") > 0, 1)).alias(f"{name}_active_zones_24h"),
        )
    )
    outs = [*[f"{name}_event_count_{n}" for n in windows], f"{name}_active_zones_24h"]
    return (
        df.drop(*outs)
        .join(got.hint("merge"), ["target_time", "zone_id"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in outs})
    )


def add_district_relative(df: DataFrame) -> DataFrame:
    """Share, rank and percentile of a zone among its district at the same time."""
    group = ["target_time", "district"]
    totals = df.groupBy(*group).agg(F.sum("zone_event_count_24h").alias("_dt"))
    shared = df.join(totals, group, "left")
    base = F.when(F.col("_dt") > 0, F.col("_dt")).otherwise(F.col("district_event_count_24h"))
    shared = shared.withColumn(
        "zone_24h_share_of_district", safe_divide(F.col("zone_event_count_24h"), base)
    ).drop("_dt")
    ranked = group_ranks(
        shared, "zone_event_count_7d", group, {"zone_7d_rank_in_district": "min_desc"}
    )
    return group_ranks(
        ranked, "zone_same_hour_rate", group, {"zone_same_hour_percentile_in_district": "max_pct"}, among=shared
    )


def add_hotspot_distances(df: DataFrame) -> DataFrame:
    """Distance to the nearest active zone and to the weighted centre of recent activity."""
    base = materialize(df)
    counts = {"3h": "zone_event_count_3h", "24h": "zone_event_count_24h"}
    at = {"zone_lat": "lat", "zone_lng": "lng"}
    # Zones stay where they are: their near neighbours are listed once, and active zones report to those that list them.
    # An active zone is its own nearest. Only quiet rows whose lists hold no active zone are searched for.
    # Places come back at every hour, so stored tables are far smaller on disk than in memory: those by hour are not broadcast.
    places = materialize(
        base.select(*at).dropna().distinct().withColumnsRenamed(at).withColumn("place", F.monotonically_increasing_id())
    )
    close = materialize(close_places(places))
    spots = (
        base.join(places.withColumnsRenamed({v: k for k, v in at.items()}), list(at))
        .groupBy("target_time", "place", *[F.col(k).alias(v) for k, v in at.items()])
        .agg(*[F.max(c).alias(c) for c in counts.values()])
    )
    told = (
        spots.filter(" OR ".join(f"{c} > 0" for c in counts.values()))
        .select("target_time", F.col("place").alias("near"), *counts.values())
        .join(close.hint("merge"), "near")
        .groupBy("target_time", "place")
        .agg(*[F.min(F.when(F.col(c) > 0, F.col("distance_m"))).alias(f"_d{w}") for w, c in counts.items()])
    )
    known = materialize(spots.join(told.hint("merge"), ["target_time", "place"], "left"))
    tagged = lambda test: known.select(
        "target_time",
        "place",
        *at.values(),
        F.explode(F.array_compact(F.array(*[F.when(F.expr(test.format(c=c, w=w)), F.lit(w)) for w, c in counts.items()]))).alias("window"),
    )
    lost = tagged("{c} <= 0 AND _d{w} IS NULL")
    asked = lost.select("target_time", "window").distinct()
    found = nearest_join(
        lost, tagged("{c} > 0").join(asked, ["target_time", "window"], "left_semi"), ["target_time", "window"], ["place"]
    )
    wide = found.groupBy("target_time", "place").agg(
        *[F.max(F.when(F.col("window") == w, F.col("distance_m"))).alias(f"_f{w}") for w in counts]
    )
    every = known.join(wide.hint("merge"), ["target_time", "place"], "left").select(
        "target_time",
        *[F.col(v).alias(k) for k, v in at.items()],
        *[
            F.when(F.col(c) > 0, F.lit(0.0)).otherwise(F.round(F.coalesce(f"_d{w}", f"_f{w}"), 3)).alias(f"_d{w}")
            for w, c in counts.items()
        ],
    )
    out = base.join(every.hint("merge"), ["target_time", *at], "left").withColumns(
        {
            f"distance_to_nearest_event_{w}_m": F.when(F.col(c) > 0, F.lit(0.0)).otherwise(
                F.coalesce(f"_d{w}", F.lit(MISSING_DISTANCE_M))
            )
            for w, c in counts.items()
        }
    ).drop("_d3h", "_d24h")
    weight = F.col("zone_event_count_24h").cast("double")
    active = base.filter("zone_event_count_24h > 0")
    sums = [
        F.sum(F.col("zone_lat") * weight).alias("_y"),
        F.sum(F.col("zone_lng") * weight).alias("_x"),
        F.sum(weight).alias("_w"),
    ]
    by_district = active.groupBy("target_time", "district").agg(*sums)
    by_time = (
        by_district.groupBy("target_time")
        .agg(*[F.sum(c).alias(f"{c}t") for c in ("_y", "_x", "_w")])
    )
    joined = out.join(by_district, ["target_time", "district"], "left").join(
        by_time, "target_time", "left"
    )
    lat = F.coalesce(F.col("_y") / F.col("_w"), F.col("_yt") / F.col("_wt"))
    lng = F.coalesce(F.col("_x") / F.col("_w"), F.col("_xt") / F.col("_wt"))
    d = F.round(haversine_m(F.col("zone_lat"), F.col("zone_lng"), lat, lng), 3)
    return joined.withColumn(
        "distance_to_district_recent_centroid_24h_m", F.coalesce(d, F.lit(MISSING_DISTANCE_M))
    ).drop("_y", "_x", "_w", "_yt", "_xt", "_wt")


LINE_DEFAULTS = {
    "nearest_road_m": MISSING_DISTANCE_M,
    "road_segment_count": 0.0,
    "road_source_mismatch": 0.0,
    "has_drivable_road": 0.0,
}


def add_line_context(df: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Left join of per-zone line columns, typed defaults where missing."""
    if lines is None:
        return df.withColumns({c: F.lit(v) for c, v in LINE_DEFAULTS.items()})
    have = [c for c in LINE_DEFAULTS if c in lines.columns]
    joined = df.drop(*LINE_DEFAULTS).join(lines.select("zone_id", *have), "zone_id", "left")
    return joined.withColumns(
        {
            c: F.coalesce(F.col(c).try_cast("double") if c in have else F.lit(None), F.lit(v))
            for c, v in LINE_DEFAULTS.items()
        }
    )


def add_engineered(
    df: DataFrame, lines: DataFrame | None = None, rings: bool = True,
    resolution: int = geo.DEFAULT_RESOLUTION,
) -> DataFrame:
    """All engineered columns on any zone-time frame; absent count columns start at 0.

    ``rings=False`` keeps ring columns that are already there.
    """
    for c in (
        "zone_event_count_3h",
        "zone_event_count_24h",
        "zone_event_count_7d",
        "district_event_count_3h",
        "district_event_count_24h",
        "zone_same_hour_rate",
    ):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    if "zone_lat" not in df.columns or "zone_lng" not in df.columns:
        lat, lng = geo.hex_center(*geo.hex_qr(F.col("zone_id")), resolution)
        df = df.withColumns({"zone_lat": lat, "zone_lng": lng})
    df = with_cycles(add_ratios(df))
    if rings:
        df = add_ring(add_ring(df, 1), 2)
    df = df.withColumn(
        "ring2_to_ring1_24h_ratio",
        safe_divide(F.col("ring2_event_count_24h"), F.col("neighbor_event_count_24h")),
    )
    return add_line_context(add_hotspot_distances(add_district_relative(df)), lines)


def zone_features(
    events: DataFrame,
    lookback_days: int = 7,
    horizon_minutes: int = 120,
    resolution: int = geo.DEFAULT_RESOLUTION,
    lines: DataFrame | None = None,
) -> DataFrame:
    """The full training table of the zone stage."""
    base = zone_base_features(events, lookback_days, horizon_minutes, resolution)
    return add_engineered(base, lines, rings=False, resolution=resolution)
