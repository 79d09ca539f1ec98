"""Reports and events derived from the driver's ``events`` table.

That table has no coordinates; integer arithmetic on its ids places every user
on one spot with a few metres of jitter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.functions.geo import grid_cell, hex_axial, hex_center, hex_id
from zonecast.functions.stations import with_nearest_station

_D = lambda v: F.lit(float(v))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    uid, eid = F.col("user_id"), F.col("event_id")
    return ev.select(
        eid.cast("string").alias("report_id"),
        (_D(22.2) + (uid * 37 % 300).cast("double") / _D(1000) + (eid % 7).cast("double") * _D(0.00003)).alias("lat"),
        (_D(113.9) + (uid * 53 % 400).cast("double") / _D(1000) + (eid % 5).cast("double") * _D(0.00003)).alias("lng"),
        F.concat(F.lit("addr-"), (uid % 50).cast("string")).alias("address"),
        F.col("event_type").alias("report_type"),
        F.col("ts").alias("create_dt"),
        (k % 6).alias("upvote"),
        (k % 5).alias("downvote"),
        F.col("ts").alias("seen_at"),
    )


def reports_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth report a second time, one hour later and with other votes."""
    base = reports(spark, sf_dir)
    copies = base.filter(F.col("report_id").cast("bigint") % 10 == 0).withColumns(
        {
            "seen_at": F.col("seen_at") + F.expr("INTERVAL 1 HOUR"),
            "upvote": (F.col("upvote") + 1) % 6,
            "downvote": (F.col("downvote") + 2) % 5,
            "address": F.concat("address", F.lit("-later")),
        }
    )
    return base.unionByName(copies)


def with_places(df: DataFrame, resolution: int = 9) -> DataFrame:
    """Add square cell, hex zone with centre, and nearest-station district and region."""
    lat, lng = F.col("lat"), F.col("lng")
    q, r = hex_axial(lat, lng, resolution)
    placed = df.withColumns(
        {
            "grid_cell": grid_cell(lat, lng),
            "_q": q,
            "_r": r,
        }
    )
    zlat, zlng = hex_center(F.col("_q"), F.col("_r"), resolution)
    zoned = placed.withColumns(
        {"zone_id": hex_id(F.col("_q"), F.col("_r"), resolution), "zone_lat": zlat, "zone_lng": zlng}
    ).drop("_q", "_r")
    return with_nearest_station(zoned)


def events(spark: SparkSession, sf_dir: str, resolution: int = 9) -> DataFrame:
    """Reports taken as events, one each, in the shape the feature operators read."""
    eid = F.col("report_id").cast("bigint")
    base = reports(spark, sf_dir).select(
        eid.alias("event_id"),
        "lat",
        "lng",
        "address",
        F.col("create_dt").alias("ts"),
        (eid % 3 + 1).alias("report_count"),
        F.col("upvote").alias("total_upvotes"),
        F.col("downvote").alias("total_downvotes"),
    )
    return with_places(base, resolution)
