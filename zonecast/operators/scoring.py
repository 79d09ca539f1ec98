"""Combining, ranking and looking up forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.functions.geo import (
    DEFAULT_RESOLUTION,
    FORECAST_BANDS,
    haversine_km,
    hex_zone,
    location_band,
    risk_band,
)
from zonecast.functions.timecols import epoch_micros, floor_hour, hours
from zonecast.operators.nearest import nearest_join
from zonecast.scale import group_ranks, ordered_rank
from zonecast.session import materialize


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))


def _ranked(df: DataFrame, score: str = "probability") -> DataFrame:
    return ordered_rank(df, [F.col(score).desc(), F.col("zone_id"), F.col("target_time")], name="rank")


def activity_lookup(spatial: DataFrame, activity: DataFrame) -> DataFrame:
    """Attach each time's activity probability; times without one get the mean."""
    default = activity.agg(F.avg("activity_probability")).scalar()
    per_time = activity.groupBy("target_time").agg(F.max("activity_probability").alias("activity_probability"))
    return spatial.join(per_time, "target_time", "left").withColumn(
        "activity_probability", F.coalesce("activity_probability", default, F.lit(1.0))
    )


def combine_scores(df: DataFrame) -> DataFrame:
    """Product of clipped stage probabilities, global rank and risk band."""
    a = clip01(F.col("activity_probability"))
    p = clip01(clip01(F.col("spatial_probability")) * a)
    scored = df.withColumns({"activity_probability": a, "probability": p, "score": p})
    return _ranked(scored).withColumn("risk_band", risk_band(F.col("probability")))


# Weights of the recent prior.
PRIOR_WEIGHTS = {
    "zone_event_count_24h": 0.45,
    "neighbor_event_count_24h": 0.25,
    "district_event_count_24h": 0.15,
    "zone_same_hour_percentile_in_district": 0.15,
}


def blend_alpha(target: str) -> float:
    return 0.15 if target.endswith("_2h") else 0.05


def blend_recent_prior(df: DataFrame, alpha: float = 0.05, score: str = "score") -> DataFrame:
    """Pull scores towards the within-time percentiles of recent activity.

    Percentiles are average ranks from per-time value histograms, so a time with
    very many rows is never sorted in one task.
    """
    if "target_time" not in df.columns or any(c not in df.columns for c in PRIOR_WEIGHTS):
        return df.withColumn(score, clip01(F.col(score)))
    out = df
    prior = F.lit(0.0)
    for c, weight in PRIOR_WEIGHTS.items():
        out = group_ranks(
            out.withColumn(f"_v_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0))),
            f"_v_{c}",
            ["target_time"],
            {f"_p_{c}": "avg_pct"},
        )
        prior = prior + F.lit(weight) * F.col(f"_p_{c}")
    blended = clip01(F.lit(1.0 - alpha) * F.col(score) + F.lit(alpha) * prior)
    return out.withColumn(score, blended).drop(*[f"_{k}_{c}" for k in "vp" for c in PRIOR_WEIGHTS])


def dispatch_quota(target: str) -> int:
    if target.endswith("_2h"):
        return 1
    return 20 if target.endswith("_1h") else 10


def dispatch_rank(df: DataFrame, quota: int, score: str = "probability") -> DataFrame:
    """Each time's best ``quota`` rows first, then the rest, both by score.

    Only the selected rows need a rank inside their time, which Spark limits before
    the shuffle; the rest are everything else.
    """
    quota = max(1, int(quota))
    best = W.partitionBy("target_time").orderBy(F.desc(score), "zone_id")
    keys = ["target_time", "zone_id"]
    chosen = (
        df.withColumn("_rn", F.row_number().over(best))
        .filter(F.col("_rn") <= quota)
        .select(*keys, F.lit(0).alias("_later"))
    )
    tagged = df.join(chosen, keys, "left").withColumn("_later", F.coalesce("_later", F.lit(1)))
    ranked = ordered_rank(
        tagged, [F.col("_later"), F.col(score).desc(), F.col("zone_id"), F.col("target_time")], name="dispatch_rank"
    )
    return ranked.drop("_later").withColumn("dispatch_score", F.lit(1.0) / F.col("dispatch_rank"))


def format_predictions(df: DataFrame, score: str = "score") -> DataFrame:
    """Clipped probability, global rank and band, ready to publish."""
    p = clip01(F.col(score))
    ranked = _ranked(df.withColumns({"score": p, "probability": p, "actual": F.col("actual").cast("int")}))
    return ranked.withColumn("risk_band", risk_band(F.col("probability")))


def cell_forecast(scored: DataFrame, events: DataFrame, at: Column, recent: int = 5, newest_first: bool = False) -> DataFrame:
    """Band every scored cell and list a few recent events of the high-risk ones."""
    t = at.cast("timestamp_ntz")
    order = [F.col("ts").desc() if newest_first else F.col("ts"), F.col("event_id")]
    w = W.partitionBy("grid_cell").orderBy(*order)
    cells = scored.select(
        "grid_cell",
        F.split_part("grid_cell", F.lit("_"), F.lit(1)).cast("double").alias("lat"),
        F.split_part("grid_cell", F.lit("_"), F.lit(2)).cast("double").alias("lng"),
        "district",
        "region",
        F.round("probability", 4).alias("probability"),
        risk_band(F.col("probability"), **FORECAST_BANDS).alias("risk"),
    )
    lists = (
        events.filter(F.col("ts") >= t - hours(24))
        .join(cells.filter("risk = 'high'").select("grid_cell"), "grid_cell", "left_semi")
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= recent)
        .groupBy("grid_cell")
        .agg(
            F.transform(
                F.sort_array(
                    F.collect_list(F.struct("_rn", "lat", "lng", "address", "ts", "report_count"))
                ),
                lambda e: e.dropFields("_rn"),
            ).alias("recent_events")
        )
    )
    return cells.join(lists, "grid_cell", "left").orderBy(F.desc("probability"), "grid_cell")


def _snapshots(points: DataFrame, predictions: DataFrame) -> DataFrame:
    """Nearest prediction time of every distinct requested time, the earlier on ties.

    Requests meet the prediction times of their own hour and the closest ones of the
    hours around, found on a spine with one row per hour.
    """
    asked = points.select("requested_time", floor_hour(F.col("requested_time")).alias("h")).distinct()
    known = predictions.select(F.col("target_time").alias("t")).distinct()
    per_hour = known.groupBy(floor_hour(F.col("t")).alias("h")).agg(
        F.collect_list("t").alias("inside"), F.min("t").alias("lo"), F.max("t").alias("hi")
    )
    w = W.partitionBy(F.lit(0)).orderBy("h")
    spine = (
        asked.select("h")
        .union(per_hour.select("h"))
        .distinct()
        .join(per_hour, "h", "left")
        .select(
            "h",
            F.array_compact(
                F.concat(
                    F.coalesce("inside", F.array().cast("array<timestamp_ntz>")),
                    F.array(
                        F.last("hi", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),
                        F.first("lo", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)),
                    ),
                )
            ).alias("options"),
        )
    )
    t = epoch_micros(F.col("requested_time"))
    best = F.array_min(
        F.transform("options", lambda o: F.struct(F.abs(epoch_micros(o) - t).alias("d"), o.alias("t")))
    )
    return asked.join(spine, "h").select("requested_time", best["t"].alias("target_time"))


def score_locations(
    points: DataFrame, predictions: DataFrame, resolution: int = DEFAULT_RESOLUTION, top_n: int = 5
) -> DataFrame:
    """Risk of many points: (point_id, lat, lng, requested_time) against scored zones.

    Each point uses the prediction time nearest to its request, its own zone if
    scored there and otherwise the nearest scored zone, plus the top zones with
    their distance.
    """
    times = _snapshots(points, predictions)
    used = predictions.join(times.select("target_time").distinct(), "target_time", "left_semi")
    ranked = ordered_rank(used, [F.col("score").desc(), F.col("zone_id")], ["target_time"], "zone_rank")
    sizes = ranked.groupBy("target_time").agg(F.count(F.lit(1)).alias("total_zones"))
    snap = materialize(ranked)
    asked = materialize(
        points.join(times, "requested_time").withColumn(
            "own_zone", hex_zone(F.col("lat"), F.col("lng"), resolution)
        )
    )
    own = asked.join(
        snap.select("target_time", F.col("zone_id").alias("own_zone")), ["target_time", "own_zone"], "left_semi"
    ).select("point_id", "target_time", F.col("own_zone").alias("zone_id"))
    lost = asked.join(own.select("point_id"), "point_id", "left_anti")
    zones = snap.select("target_time", F.col("zone_lat").alias("lat"), F.col("zone_lng").alias("lng"), "zone_rank", "zone_id")
    found = nearest_join(lost, zones, ["target_time"], ["point_id"], ["zone_rank", "zone_id"]).select(
        "point_id", "target_time", "zone_id"
    )
    matched = own.withColumn("_own", F.lit(1)).unionByName(found.withColumn("_own", F.lit(0)))
    top = (
        snap.filter(F.col("zone_rank") <= top_n)
        .groupBy("target_time")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("zone_rank", "zone_id", "district", "region", "score", "zone_lat", "zone_lng")
                )
            ).alias("_top")
        )
    )
    rank, n = F.col("zone_rank"), F.col("total_zones")
    pct = F.when(n == 1, F.lit(1.0)).otherwise(F.lit(1.0) - (rank - 1) / (n - 1))
    km = lambda lat, lng: haversine_km(F.col("lat"), F.col("lng"), lat, lng)
    hot = F.transform(
        F.col("_top"),
        lambda z: F.struct(
            z["zone_id"].alias("zone_id"),
            z["district"].alias("district"),
            z["region"].alias("region"),
            z["score"].alias("score"),
            z["zone_rank"].alias("rank"),
            F.round(km(z["zone_lat"], z["zone_lng"]), 3).alias("distance_km"),
        ),
    )
    joined = (
        asked.join(matched, ["point_id", "target_time"])
        .join(snap, ["target_time", "zone_id"])
        .join(sizes, "target_time")
        .join(top, "target_time")
    )
    return joined.select(
        "point_id",
        "lat",
        "lng",
        "requested_time",
        F.col("target_time").alias("matched_time"),
        "own_zone",
        F.col("zone_id").alias("matched_zone"),
        "district",
        "region",
        "score",
        rank.alias("rank"),
        "total_zones",
        pct.alias("rank_percentile"),
        location_band(F.col("score"), pct).alias("risk_band"),
        F.when(F.col("_own") == 1, F.lit(0.0))
        .otherwise(km(F.col("zone_lat"), F.col("zone_lng")))
        .alias("distance_km"),
        hot.alias("hot_zones"),
    )


def score_locations_multi_horizon(
    points: DataFrame, by_horizon: dict[str, DataFrame], order: Sequence[str] = ("30m", "1h", "2h")
) -> DataFrame:
    """One wide row per point: band, score and rank for each horizon."""
    used = [h for h in order if h in by_horizon]
    stacked = None
    for h in used:
        one = score_locations(points, by_horizon[h]).select(
            "point_id", F.lit(h).alias("horizon"), "risk_band", "score", "rank"
        )
        stacked = one if stacked is None else stacked.unionByName(one)
    wide = stacked.groupBy("point_id").pivot("horizon", used).agg(
        F.first("risk_band").alias("risk"), F.first("score").alias("score"), F.first("rank").alias("rank")
    )
    return wide.select(
        "point_id",
        *[F.col(f"{h}_{c}").alias(f"{c}_{h}") for h in used for c in ("risk", "score", "rank")],
    )
