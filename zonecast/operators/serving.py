"""Dashboard queries over published marts and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published columns that are whole numbers or reals.
WHOLE = (
    "resolution", "has_observed_history", "is_zero_history", "event_count", "district_event_count",
    "region_event_count", "has_drivable_road", "road_source_mismatch", "road_segment_count",
)
REAL = ("zone_lat", "zone_lng", "log_event_count")


def to_whole(c: Column, default: int = 0) -> Column:
    """Lenient integer: text that is no number takes the default."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(default))


def to_real(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def merged_zones(coverage: DataFrame, sparsity: DataFrame) -> DataFrame:
    """Coverage with sparsity columns laid over it; history seen by coverage wins."""
    over = [c for c in sparsity.columns if c != "zone_id"]
    right = sparsity.select("zone_id", F.lit(1).alias("_hit"), *[F.col(c).alias(f"_s_{c}") for c in over])
    joined = coverage.join(right, "zone_id", "left")
    names = [*coverage.columns, *[c for c in over if c not in coverage.columns]]
    cols = {}
    for c in names:
        left = F.col(c) if c in coverage.columns else F.lit(None)
        cols[c] = F.when(F.col("_hit") == 1, F.col(f"_s_{c}")).otherwise(left) if c in over else left
    seen = to_whole(F.col("has_observed_history")) != 0
    cols["has_observed_history"] = F.when(seen, F.lit("1")).otherwise(cols["has_observed_history"].cast("string"))
    cols["is_zero_history"] = F.when(seen, F.lit("0")).otherwise(cols["is_zero_history"].cast("string"))
    typed = {
        c: to_whole(v.cast("string")) if c in WHOLE else to_real(v.cast("string")) if c in REAL else v
        for c, v in cols.items()
    }
    return joined.select(*[v.alias(c) for c, v in typed.items()])


def coverage_summary(zones: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    seen = F.col("has_observed_history") == 1
    extra = [
        n(F.col(c) == 1).alias(a)
        for c, a in (("has_drivable_road", "road_access_cells"), ("road_source_mismatch", "road_source_mismatch_cells"))
        if c in zones.columns
    ]
    return zones.agg(
        F.count(F.lit(1)).alias("coverage_cells"),
        n(seen).alias("observed_cells"),
        n(~seen).alias("zero_history_cells"),
        F.sum("event_count").alias("event_count"),
        *extra,
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("region") != "", F.col("region")))), "|").alias("regions"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("district") != "", F.col("district")))), "|").alias("districts"),
    )


def filter_zones(
    zones: DataFrame, region: str = "All", district: str = "All", zone: str = "", min_events: int = 0
) -> DataFrame:
    out = zones
    if region != "All":
        out = out.filter(F.col("region") == region)
    if district != "All":
        out = out.filter(F.col("district") == district)
    if zone:
        out = out.filter(F.contains(F.col("zone_id"), F.lit(zone)))
    return out.filter(F.col("event_count") >= min_events)


def coverage_page(zones: DataFrame, limit: int = 250, offset: int = 0, **filters) -> DataFrame:
    """One page of the busiest zones with the total number of matches."""
    limit, offset = max(1, min(limit, 5000)), max(0, offset)
    kept = filter_zones(zones, **filters)
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = kept.orderBy(F.desc("event_count"), "zone_id").offset(offset).limit(limit)
    return page.withColumn("total", total)


def time_profile(profile: DataFrame, grain: str = "hour") -> DataFrame:
    """Events per hour or weekday over all zones, zero-filled."""
    part, size = ("day_of_week", 7) if grain == "day" else ("hour", 24)
    sums = profile.groupBy(F.col(part).cast("int").alias(part)).agg(F.sum("event_count").alias("n"))
    slots = profile.sparkSession.range(size).select(F.col("id").cast("int").alias(part))
    return slots.join(sums, part, "left").select(part, F.coalesce("n", F.lit(0)).alias("event_count"))


def prediction_rows(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """Two-stage rows if there are any, else single-stage; probability falls back to score."""
    has = F.coalesce(preferred.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(0)) > 0
    names = [c for c in ("target_time", "zone_id", "district", "region", "score", "probability", "rank",
                         "activity_probability", "spatial_probability")
             if c in preferred.columns or c in fallback.columns]
    pick = lambda df: df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in names]
    )
    both = pick(preferred).unionByName(pick(fallback.filter(~has)))
    score = to_real(F.col("score"))
    typed = {"score": score}
    if "probability" in names:
        given = F.coalesce("probability", F.lit("")) != ""
        typed["probability"] = F.when(given, to_real(F.col("probability"))).otherwise(score)
    for c in ("activity_probability", "spatial_probability"):
        if c in names:
            typed[c] = F.when(F.col(c).isNotNull(), to_real(F.col(c)))
    if "rank" in names:
        typed["rank"] = F.when(F.coalesce("rank", F.lit("")) != "", to_whole(F.col("rank")))
    return both.select(*[typed.get(c, F.col(c)).alias(c) for c in names])


def latest_per_zone(predictions: DataFrame) -> DataFrame:
    """Newest row per zone; within a time the best rank, then the best score, then the largest other columns."""
    rank = F.coalesce(F.col("rank"), F.lit(10**9)) if "rank" in predictions.columns else F.lit(10**9)
    when = F.col("target_time")
    if predictions.schema["target_time"].dataType.simpleString() == "string":
        when = F.coalesce(when.try_cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    rest = sorted(c for c in predictions.columns if c not in ("zone_id", "target_time", "rank", "score"))
    order = F.struct(when.alias("t"), (-rank).alias("r"), "score", *rest)
    others = [c for c in predictions.columns if c != "zone_id"]
    return (
        predictions.filter("zone_id <> ''")
        .groupBy("zone_id")
        .agg(F.max_by(F.struct(*others), order).alias("_r"))
        .select("zone_id", "_r.*")
    )


def zone_overlay(zones: DataFrame, geometry: DataFrame, predictions: DataFrame, **filters) -> DataFrame:
    """Filtered zones with their polygon and newest prediction, one feature per row."""
    latest = latest_per_zone(predictions).select(
        "zone_id",
        *[F.col(c).alias(f"prediction_{c}" if c in zones.columns else c)
          for c in predictions.columns if c not in ("zone_id", "district", "region")],
    )
    return filter_zones(zones, **filters).join(geometry.select("zone_id", "ring"), "zone_id").join(
        latest, "zone_id", "left"
    )


def model_metrics(two_stage: DataFrame, single: DataFrame) -> DataFrame:
    """Two-stage summary rows if there are any, else the single-stage ones, by horizon."""
    has = F.coalesce(two_stage.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(0)) > 0
    tagged = two_stage.withColumn("model_family", F.lit("two_stage")).unionByName(
        single.withColumn("model_family", F.lit("single_stage")).filter(~has), allowMissingColumns=True
    )
    return tagged.withColumn("horizon_minutes", to_whole(F.col("horizon_minutes"))).orderBy("horizon_minutes")
