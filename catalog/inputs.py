"""Tables the registered queries share, all derived by Spark from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.functions.timecols import floor_hour
from zonecast.operators import city_features, spatial, zone_features
from zonecast.session import materialize, shared_dir
from zonecast.sources import adapter

LOOKBACK_DAYS = 7
HORIZON = 120
TARGET = "alert_next_2h"
#: One file per row; tasks move their files to the folder themselves, as the driver alone would take the longer the more there are.
MANY_FILES = {"maxRecordsPerFile": "1", "mapreduce.fileoutputcommitter.algorithm.version": "2"}

_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table stored once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = materialize(build())
    return _kept[key]


def forget() -> None:
    """Drop the stored tables, so a benchmark times the full work."""
    _kept.clear()


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.reports(spark, sf_dir)


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.reports_with_copies(spark, sf_dir)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.events(spark, sf_dir)


def zone_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(
        spark, sf_dir, "zone_base",
        lambda: zone_features.zone_base_features(events(spark, sf_dir), LOOKBACK_DAYS, HORIZON),
    )


def zone_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(
        spark, sf_dir, "zone_full",
        lambda: zone_features.add_engineered(zone_base(spark, sf_dir), rings=False),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(
        spark, sf_dir, "activity",
        lambda: city_features.activity_features(events(spark, sf_dir), 60, LOOKBACK_DAYS * 24),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone rows with a score that needs no model, so metrics have an oracle."""
    z = zone_base(spark, sf_dir)
    return z.select(
        "target_time", "zone_id", "district", "region", "zone_lat", "zone_lng", "hour",
        "zone_event_count_24h", "zone_event_count_7d", "neighbor_event_count_24h",
        "district_event_count_24h", "zone_same_hour_rate",
        (((F.col("zone_event_count_7d") * 7 + F.col("hour")) % 101) / F.lit(100.0)).alias("score"),
        F.col(TARGET).alias("actual"),
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two such scores as two models, times dealt to four folds by day."""
    s = scored(spark, sf_dir)
    fold = (F.dayofmonth("target_time") % 4 + 1).alias("fold")
    other = (((F.col("zone_event_count_24h") * 5 + F.col("hour")) % 97) / F.lit(96.0)).alias("score")
    cols = ["target_time", "zone_id", "district", "region", "actual"]
    return s.select(F.lit("a").alias("model"), fold, *cols, "score").unionByName(
        s.select(F.lit("b").alias("model"), fold, *cols, other)
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage grid, stored as a mart: observed zones and their ring-1 surroundings."""
    return kept(spark, sf_dir, "grid", lambda: _grid(spark, sf_dir))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spatial.observed_zones(reports(spark, sf_dir))
    fill = spatial.neighbors(seen, 1).select(F.col("neighbor_id").alias("zone_id")).union(seen).distinct()
    return spatial.coverage_grid(fill, seen)


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One five-cornered polygon per nation, tiled over the region with gaps at the cut corners."""
    k = F.col("n_nationkey")
    x0 = F.lit(113.9) + (k % 5).cast("double") * F.lit(0.08)
    y0 = F.lit(22.2) + F.floor(k / F.lit(5.0)).cast("double") * F.lit(0.06)
    at = lambda dx, dy: F.array(x0 + F.lit(dx), y0 + F.lit(dy))
    ring = F.array(at(0.0, 0.0), at(0.08, 0.0), at(0.08, 0.03), at(0.05, 0.06), at(0.0, 0.06), at(0.0, 0.0))
    regions = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "nation")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(k.alias("poly_id"), F.col("n_name").alias("district"), F.col("r_name").alias("region"), F.array(ring).alias("rings"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.polygon_edges(polygons(spark, sf_dir))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short line per user, starting at the user's spot."""
    u = F.col("user_id")
    lat = F.lit(22.2) + (u * 37 % 300).cast("double") / F.lit(1000.0)
    lng = F.lit(113.9) + (u * 53 % 400).cast("double") / F.lit(1000.0)
    classes = F.array(*[F.lit(c) for c in ("residential", "primary", "service", "tertiary")])
    return users(spark, sf_dir).select(
        u.alias("segment_id"),
        F.get(classes, (u % 4).cast("int")).alias("road_class"),
        F.concat(F.lit("road-"), u.cast("string")).alias("name"),
        lat.alias("lat_a"),
        lng.alias("lng_a"),
        (lat + (u % 3).cast("double") * F.lit(0.003)).alias("lat_b"),
        (lng + (u % 5).cast("double") * F.lit(0.002)).alias("lng_b"),
    )


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as GeoJSON text, every fourth one not drivable, some as multi-lines."""
    s = segments(spark, sf_dir)
    a, b = F.array("lng_a", "lat_a"), F.array("lng_b", "lat_b")
    coords = F.when(
        F.col("segment_id") % 2 == 0, F.to_json(F.array(a, b, a))
    ).otherwise(F.to_json(F.array(F.array(a, b))))
    kind = F.when(F.col("segment_id") % 2 == 0, "LineString").otherwise("MultiLineString")
    hw = F.when(F.col("segment_id") % 4 == 3, F.lit('["footway","service"]')).otherwise(
        F.concat(F.lit('"'), "road_class", F.lit('"'))
    )
    name = F.when(F.col("segment_id") % 3 == 0, F.lit('"name":"",')).otherwise(
        F.concat(F.lit('"name":"'), "name", F.lit('",'))
    )
    text = F.concat(
        F.lit('{"type":"Feature","properties":{'), name, F.lit('"ref":"R'), F.col("segment_id").cast("string"),
        F.lit('","highway":'), hw, F.lit('},"geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit("}}"),
    )
    return s.select(text.alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to look up: one per order customer, spread over the region and the last days."""
    c = F.col("c_custkey")
    start = events(spark, sf_dir).agg(floor_hour(F.max("ts")).alias("t")).scalar()
    return table(spark, sf_dir, "customer").select(
        c.alias("point_id"),
        (F.lit(22.2) + (c * 31 % 300).cast("double") / F.lit(1000.0)).alias("lat"),
        (F.lit(113.9) + (c * 71 % 400).cast("double") / F.lit(1000.0)).alias("lng"),
        (start - F.make_dt_interval(hours=(c % 48).cast("int"), mins=(c % 50).cast("int"))).alias("requested_time"),
    )


def archive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports packed as archives of 500 records: (b, value)."""
    r = reports(spark, sf_dir)
    rid = F.col("report_id").cast("bigint")
    record = F.struct(
        F.when(rid % 3 > 0, F.col("report_id")).alias("alert_record_id"),
        F.col("lat").cast("string").alias("lat"),
        F.col("lng").cast("string").alias("lng"),
        "address",
        F.col("report_type").alias("alert_type"),
        F.date_format("create_dt", "yyyy-MM-dd HH:mm:ss").alias("create_dt"),
        F.col("upvote").cast("string").alias("upvote"),
        F.when(rid % 4 > 0, F.col("downvote").cast("string")).alias("downvote"),
    )
    entry = F.struct(rid.alias("o"), F.concat(F.lit('"'), "report_id", F.lit('":'), F.to_json(record)).alias("j"))
    packed = r.groupBy(F.floor(rid / F.lit(500.0)).alias("b")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    body = F.array_join(F.transform("e", lambda e: e["j"]), ",")
    return packed.select("b", F.concat(F.lit('{"meta":{"v":1},"alerts":{'), body, F.lit("}}")).alias("value"))


def archive_files(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "archive")
    archive_text(spark, sf_dir).repartition("b").write.partitionBy("b").options(**MANY_FILES).text(path)
    return path


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.zone_polygons(grid(spark, sf_dir).select("zone_id"))


def resolution_events(spark: SparkSession, sf_dir: str, resolution: int) -> DataFrame:
    return adapter.events(spark, sf_dir, resolution)


