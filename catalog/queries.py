"""Registered queries: one or more per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import inputs as I
from zonecast.functions import geo, timecols
from zonecast.operators import (
    cell_features as cells,
    city_features as city,
    clean,
    diagnose,
    marts,
    metrics,
    models,
    mutual_info,
    ranker,
    scoring,
    serving,
    spatial,
    splits,
    zone_features as zones,
)
from zonecast.plans import runs, upkeep
from zonecast.session import materialize
from zonecast.sources import adapter, archive, ranges, versioned
from zonecast.streaming import ingest, keyed, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ZONE = "Asia/Hong_Kong"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so engines can be compared."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- ingest ---------------------------------------------------------------------


@query
def i1_read_report_archive(spark, sf):
    return archive.read_report_archive(spark, I.archive_files(spark, sf) + "/*/*.txt")


@query
def i1_split_archive(spark, sf):
    """The same archives by byte ranges that many tasks share."""
    return ranges.read_report_ranges(spark, I.archive_files(spark, sf) + "/*/*.txt")


def _damaged(spark, sf) -> str:
    """Archive files whose ends are cut off and whose addresses hold braces and quotes."""
    path = I.folder(spark, "damaged")
    braces = F.regexp_replace("value", '"address":"', '"address":"{at} \\\\"')
    cut = I.archive_text(spark, sf).select("b", braces.alias("value"))
    cut = cut.select("b", F.substring("value", F.lit(1), F.length("value") - 40).alias("value"))
    cut.repartition("b").write.partitionBy("b").options(**I.MANY_FILES).text(path)
    return path + "/*/*.txt"


def _salvaged(spark, sf) -> tuple[DataFrame, DataFrame]:
    return archive.salvage_reports(archive.read_text_files(spark, _damaged(spark, sf)))


@query
def i2_split_reports(spark, sf):
    """Whole records of the same files, read in byte ranges."""
    found = ranges.read_report_ranges(spark, _damaged(spark, sf))
    return found.select("report_id", "lat", "lng", "address", "upvote", "downvote")


@query
def i2_split_leftovers(spark, sf):
    b = F.regexp_extract("file", "b=([0-9]+)", 1).cast("bigint")
    rest = ranges.archive_segments(spark, _damaged(spark, sf)).filter(~F.col("whole"))
    return rest.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("pieces"))


@query
def i2_salvage_reports(spark, sf):
    return _salvaged(spark, sf)[0].select("report_id", "lat", "lng", "address", "upvote", "downvote")


@query
def i2_salvage_quarantine(spark, sf):
    b = F.regexp_extract("path", "b=([0-9]+)", 1).cast("bigint")
    return _salvaged(spark, sf)[1].groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("pieces"))


@query
def i3_ingest_audit(spark, sf):
    return archive.ingest_audit(I.copies(spark, sf))


@query
def i4_resolve_columns(spark, sf):
    rid = F.col("report_id").cast("bigint")
    odd = I.reports(spark, sf).select(
        "report_id",
        F.when(rid % 11 == 0, F.lit("n/a")).otherwise(F.col("lat").cast("string")).alias("Latitude"),
        F.when(rid % 13 == 0, None).otherwise(F.col("lng").cast("string")).alias("LONG"),
        F.when(rid % 17 == 0, F.lit("soon"))
        .otherwise(F.date_format("create_dt", "yyyy-MM-dd HH:mm:ss"))
        .alias("Created_At"),
    )
    return r6(archive.resolve_columns(odd, lambda c: timecols.parse_any_time(c, ZONE)))


@query
def i5_append_and_rebuild(spark, sf):
    path = I.folder(spark, "reports")
    rep = I.reports(spark, sf)
    archive.append_reports(rep, path)
    archive.append_reports(rep, path)
    appended = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("appended_rows"))
    table = I.folder(spark, "events")
    archive.rebuild_events(rep.limit(1), table, "create_dt")
    archive.rebuild_events(rep, table, "create_dt")
    rebuilt = versioned.read_version(spark, table).agg(F.count(F.lit(1)).alias("n")).scalar()
    return appended.withColumn("rebuilt_rows", rebuilt)


@query
def i5_replace_days(spark, sf):
    """Two days are replaced by shifted rows, then one more is emptied; days as read back."""
    rep = I.reports(spark, sf).select("report_id", "create_dt")
    path = I.folder(spark, "by_day")
    versioned.replace_table(rep, path, F.col("create_dt"))
    some = rep.filter(F.to_date("create_dt").isin("2024-01-05", "2024-01-06") & (F.col("report_id").cast("long") % 2 == 0))
    versioned.replace_days(some, path, F.col("create_dt"), also=("2024-01-07",))
    read = versioned.read_version(spark, path)
    return read.groupBy(F.to_date("create_dt").alias("day")).agg(F.count(F.lit(1)).alias("reports"), F.max("report_id").alias("last_id"))


@query
def i6_events_since(spark, sf):
    return archive.events_since(I.events(spark, sf), "2024-01-20 12:00:00").select("event_id", "ts", "zone_id")


@query
def i6_all_events(spark, sf):
    return archive.all_events(I.events(spark, sf)).select("event_id", "ts", "grid_cell")


@query
def i7_coverage_days(spark, sf):
    rep = I.reports(spark, sf)
    polls = rep.select(timecols.floor_hour(F.col("seen_at")).alias("timestamp")).distinct()
    return models.data_gate(archive.coverage_days(polls, rep))


@query
def i8_geojson_features(spark, sf):
    latest = archive.latest_top(I.scored(spark, sf))
    shaped = spatial.zone_polygons(latest)
    feats = archive.geojson_features(
        shaped, "ring", ["zone_id", "score", "risk_rank", "district", "region", "zone_event_count_24h", "target_time"]
    )
    path = I.folder(spark, "geojson")
    archive.write_geojson_features(feats, path)
    shape = (
        "geometry struct<type: string, coordinates: array<array<array<double>>>>, "
        "properties struct<zone_id: string, score: double, risk_rank: bigint, district: string>"
    )
    f = spark.read.text(path).select(F.from_json("value", shape).alias("f"))
    return r6(
        f.select(
            "f.properties.*", F.col("f.geometry.type").alias("kind"),
            F.size(F.col("f.geometry.coordinates")[0]).cast("bigint").alias("points"),
        )
    )


@query
def i9_csv_mart(spark, sf):
    path = I.folder(spark, "mart")
    archive.write_csv_mart(marts.sparsity_profile(I.grid(spark, sf), I.events(spark, sf)), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("zone_id", "district", "region", F.col("event_count").cast("bigint").alias("event_count"))


@query
def i10_explode_lines(spark, sf):
    return r6(archive.explode_lines(I.line_features(spark, sf)))


@query
def i10_read_polygons(spark, sf):
    """A collection with holes, several parts and unnamed features, written and read again."""
    k, ring = F.col("poly_id"), F.get("rings", F.lit(0))
    moved = lambda dx: F.transform(ring, lambda p: F.array(p[0] + F.lit(dx), p[1]))
    inner = F.transform(ring, lambda p: F.array((p[0] + ring[0][0]) / 2, (p[1] + ring[0][1]) / 2))
    shape = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.to_json(c).alias("coordinates"))
    geometry = (
        F.when(k % 5 == 0, shape("MultiPolygon", F.array(F.array(ring), F.array(moved(1.0)))))
        .when(k % 5 == 1, shape("Polygon", F.array(ring, inner)))
        .otherwise(shape("Polygon", F.array(ring)))
    )
    props = F.struct(F.when(k % 5 != 2, F.col("district")).alias("name"), "region")
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))
    # to_json quotes the coordinates, which are JSON already
    text = F.regexp_replace(F.to_json(feature), r'"coordinates":"([^"]*)"', r'"coordinates":$1')
    whole = I.polygons(spark, sf).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(text), ","), F.lit("]}")).alias("value"))
    path = I.folder(spark, "polygons")
    whole.write.text(path)
    got = archive.explode_polygons(archive.read_features(spark, path))
    points = F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r))
    return got.select(
        F.col("name").alias("district"), F.col("properties")["region"].alias("region"),
        F.size("rings").cast("bigint").alias("rings"), points.cast("bigint").alias("points"),
    )


# --- filters, dedupe, clustering ----------------------------------------------------


@query
def f1_valid_reports(spark, sf):
    return r6(clean.valid_reports(I.reports(spark, sf))).select(
        "report_id", "lat", "lng", "create_dt", "upvote", "downvote"
    )


@query
def f2_in_bbox(spark, sf):
    rep = I.reports(spark, sf)
    inside = clean.in_bbox(rep, (22.3, 22.4, 114.0, 114.2)).select("report_id", F.lit("inclusive").alias("kind"))
    strict = clean.in_bbox(rep, (22.3, 22.4, 114.0, 114.2), inclusive=False)
    return inside.unionByName(strict.select("report_id", F.lit("strict").alias("kind")))


@query
def d1_dedupe_keep_first(spark, sf):
    return clean.dedupe_keep_first(I.copies(spark, sf)).select(
        "report_id", "address", "upvote", "downvote", "seen_at"
    )


@query
def d2_dedupe_refresh(spark, sf):
    return clean.dedupe_refresh(I.copies(spark, sf)).select(
        "report_id", "address", "upvote", "downvote", "first_seen", "last_seen"
    )


@query
def d2_new_per_batch(spark, sf):
    hourly = I.copies(spark, sf).withColumn("batch", timecols.floor_hour(F.col("seen_at")))
    return clean.new_per_batch(hourly, batch="batch")


@query
def c1_consolidate_events(spark, sf):
    return r6(clean.consolidate_events(I.reports(spark, sf)))


@query
def c1_kept_up_to_date(spark, sf):
    """Clusters from three batches, the oldest last: their totals, and the reports that a full run puts elsewhere."""
    rep, path = I.reports(spark, sf), I.folder(spark, "clusters")
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    for since, until in (("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01"), ("1970-01-01", "2024-01-10")):
        upkeep.update_clusters(rep.filter((F.col("create_dt") >= at(since)) & (F.col("create_dt") < at(until))), path)
    mine = upkeep.read_members(spark, path).select("report_id", F.col("cluster_id").alias("mine")).hint("merge")
    elsewhere = clean.assign_clusters(rep).join(mine, "report_id", "left").filter(~F.col("mine").eqNullSafe(F.col("cluster_id")))
    return _event_totals(upkeep.read_events(spark, path)).withColumn("elsewhere", elsewhere.agg(F.count(F.lit(1)).alias("n")).scalar())


@query
def c1_event_totals(spark, sf):
    """What any right clustering keeps: every report is in one event, votes and times add up."""
    return _event_totals(clean.consolidate_events(I.reports(spark, sf)))


def _event_totals(e: DataFrame) -> DataFrame:
    span = F.timestamp_diff("MICROSECOND", F.col("create_dt"), F.col("end_dt")) / F.lit(6e7)
    return e.agg(
        F.sum("report_count").alias("reports"),
        F.sum("total_upvotes").alias("upvotes"),
        F.sum("total_downvotes").alias("downvotes"),
        F.min("create_dt").alias("first_dt"),
        F.max("end_dt").alias("last_dt"),
        (F.count(F.lit(1)) - F.count_distinct("event_id")).alias("repeated_ids"),
        F.count_if((F.col("report_count") < 1) | (F.abs(F.col("duration_min") - span) > 1e-6) | (span < 0)).alias("wrong_rows"),
    )


@query
def c2_link_runs(spark, sf):
    presence = materialize(clean.spot_presence(I.reports(spark, sf)))
    return clean.link_runs(presence)


@query
def c2_spot_presence(spark, sf):
    return clean.spot_presence(I.reports(spark, sf)).select("i", "j", "b", "t0", "t1", "n", "run")


@query
def c3_session_events(spark, sf):
    placed = adapter.with_places(I.reports(spark, sf))
    return clean.session_events(placed, "grid_cell", 240).drop("session")


# --- time ------------------------------------------------------------------------


def _time_texts(spark, sf) -> DataFrame:
    e = I.table(spark, sf, "events")
    k, ts = F.col("event_id") % 4, F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.concat(iso, F.lit("Z")))
        .when(k == 2, F.concat(iso, F.lit("+00:00")))
        .otherwise(iso)
    )
    return e.select("event_id", text.alias("text"))


@query
def t1_local_time(spark, sf):
    return _time_texts(spark, sf).select("event_id", timecols.local_time(F.col("text"), ZONE).alias("local_dt"))


@query
def t2_parse_any_time(spark, sf):
    e = I.table(spark, sf, "events")
    k, ts = F.col("event_id") % 5, F.col("ts")
    text = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(k == 3, F.lit("not a time"))
        .otherwise(F.lit(""))
    )
    return e.select("event_id", timecols.parse_any_time(text, ZONE).alias("parsed"))


@query
def t3_calendar_parts(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", "ts")
    return timecols.with_calendar(
        e, "ts", "hour", "day_of_week", "is_weekend", "month", "hour_start", "day_name"
    ).drop("ts")


@query
def t4_hour_bucket(spark, sf):
    e = I.table(spark, sf, "events")
    return e.groupBy(timecols.hour_bucket(F.hour("ts")).alias("hour_bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def t5_cyclical(spark, sf):
    e = timecols.with_calendar(I.table(spark, sf, "events"), "ts", "hour", "day_of_week")
    return r6(timecols.with_cycles(e).select("event_id", "hour_sin", "hour_cos", "dow_sin", "dow_cos"))


@query
def t6_hourly_axis(spark, sf):
    return city.hourly_axis(I.events(spark, sf), 168)


@query
def t7_effective_lookback(spark, sf):
    return r6(city.effective_lookback(I.events(spark, sf), 168)).unionByName(
        r6(city.effective_lookback(I.events(spark, sf), 2000))
    )


# --- space ------------------------------------------------------------------------


@query
def g1_grid_cell(spark, sf):
    return I.reports(spark, sf).select("report_id", geo.grid_cell(F.col("lat"), F.col("lng")).alias("grid_cell"))


@query
def g2_hex_zone(spark, sf):
    return r6(I.events(spark, sf).select("event_id", "zone_id", "zone_lat", "zone_lng"))


@query
def g3_haversine(spark, sf):
    lat, lng = F.col("lat"), F.col("lng")
    at = F.lit(22.3193), F.lit(114.1694)
    return I.reports(spark, sf).select(
        "report_id",
        F.round(geo.haversine_m(lat, lng, *at), 3).alias("metres"),
        F.round(geo.haversine_km(lat, lng, *at), 6).alias("km"),
    )


@query
def g4_nearest_station(spark, sf):
    return spatial.nearest_station(I.reports(spark, sf)).select("report_id", "district", "region")


@query
def g4_nearest_reference(spark, sf):
    refs = I.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("seq"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")).alias("region"),
        (F.lit(22.2) + (F.col("s_suppkey") * 17 % 300).cast("double") / F.lit(1000.0)).alias("lat"),
        (F.lit(113.9) + (F.col("s_suppkey") * 29 % 400).cast("double") / F.lit(1000.0)).alias("lng"),
    )
    return spatial.nearest_reference(I.reports(spark, sf), "report_id", refs).select("report_id", "district", "region")


@query
def g5_point_in_polygon(spark, sf):
    return spatial.point_in_polygon_join(I.reports(spark, sf), "report_id", I.edges(spark, sf)).select(
        "report_id", "district", "region"
    )


@query
def g6_enrich_zones(spark, sf):
    rep = I.reports(spark, sf).withColumn("create_dt", F.date_format("create_dt", "yyyy-MM-dd HH:mm:ss"))
    return r6(spatial.enrich_zones(rep, ZONE)).select(
        "report_id", "dt", "grid_cell", "zone_id", "zone_resolution", "zone_lat", "zone_lng", "district", "region"
    )


@query
def g7_neighbors(spark, sf):
    z = I.events(spark, sf).select("zone_id").distinct()
    one = spatial.neighbors(z, 1).withColumn("ring", F.lit(1))
    return one.unionByName(spatial.neighbors(z, 2).withColumn("ring", F.lit(2)))


@query
def g8_hex_polygon(spark, sf):
    z = I.events(spark, sf).select("zone_id").distinct()
    corners = spatial.zone_polygons(z).select("zone_id", F.posexplode("ring").alias("corner", "at"))
    return r6(corners.select("zone_id", "corner", F.col("at")[0].alias("lng"), F.col("at")[1].alias("lat")))


@query
def g9_polygon_fill(spark, sf):
    return spatial.polygon_fill(I.edges(spark, sf), 8)


@query
def g10_observed_zones(spark, sf):
    return spatial.observed_zones(I.reports(spark, sf))


@query
def g11_coverage_grid(spark, sf):
    return r6(I.grid(spark, sf))


@query
def g12_segment_distance(spark, sf):
    rep = I.reports(spark, sf)
    d = geo.segment_distance_m(
        F.col("lat"), F.col("lng"), F.lit(22.25), F.lit(113.95), F.lit(22.45), F.lit(114.25)
    )
    return rep.select("report_id", F.round(d, 3).alias("metres"))


@query
def g13_line_bins(spark, sf):
    return spatial.line_bins(I.segments(spark, sf)).select("segment_id", "by", "bx")


@query
def g14_nearest_line(spark, sf):
    return spatial.nearest_line_join(I.grid(spark, sf), I.segments(spark, sf)).select(
        "zone_id", "nearest_line_m", "nearest_line_name", "line_count", "line_classes", "has_line"
    )


@query
def g15_line_coverage(spark, sf):
    return spatial.line_coverage(I.grid(spark, sf), I.segments(spark, sf)).select(
        "zone_id", "has_observed_history", "is_zero_history", "has_line", "line_source_mismatch", "coverage_source"
    )


# --- cell, zone and city features -----------------------------------------------------


def _cells(spark, sf) -> DataFrame:
    return I.kept(spark, sf, "cells", lambda: cells.cell_features(I.events(spark, sf)))


CELL_GROUPS = {
    "x1_cell_counts": ("cell_historical_freq", "cell_7d_count", "cell_24h_count"),
    "x2_cell_last_seen": ("cell_last_seen_hours_ago",),
    "x3_cell_votes": ("upvote_ratio", "avg_report_count"),
    "x4_cell_streak": ("streak_active",),
    "x5_district_recent": ("district_24h_count", "district_active_cells"),
    "x6_district_rates": ("district_historical_rate", "district_hour_rate"),
    "x7_hour_rates": ("hour_historical_rate", "dow_hour_rate"),
    "x8_cell_neighbors": ("neighbor_24h_count",),
    "x10_cell_label": ("has_event",),
}


def _cell_query(columns: tuple[str, ...]) -> Query:
    return lambda spark, sf: r6(_cells(spark, sf).select("target_time", "grid_cell", *columns))


QUERIES.update({name: _cell_query(columns) for name, columns in CELL_GROUPS.items()})


@query
def x9_cell_universe(spark, sf):
    return cells.cell_universe(cells.cell_hours(I.events(spark, sf)))


@query
def x_cell_features_at(spark, sf):
    at = F.lit("2024-01-21 10:20:30")
    return r6(cells.cell_features_at(I.events(spark, sf), at))


ZONE_GROUPS = {
    "z1_label": ("event_count_next_horizon", I.TARGET),
    "z2_zone_counts": ("zone_event_count_1h", "zone_event_count_3h", "zone_event_count_24h", "zone_event_count_7d"),
    "z3_district_counts": ("district_event_count_3h", "district_event_count_24h"),
    "z4_last_event": ("district", "region", "zone_lat", "zone_lng"),
    "z5_recency": ("zone_hours_since_last_event",),
    "z6_active_zones": ("district_active_zones_24h",),
    "z7_same_hour_rates": ("zone_same_hour_rate", "district_same_hour_rate"),
    "z8_calendar": ("hour", "day_of_week", "is_weekend", "hour_bucket", "is_urban_core"),
}
ENGINEERED_GROUPS = {
    "z9_ratios": ("zone_3h_to_24h_ratio", "zone_24h_to_7d_ratio", "district_3h_to_24h_ratio"),
    "z10_ring1": (
        "neighbor_event_count_3h", "neighbor_event_count_24h", "neighbor_event_count_7d", "neighbor_active_zones_24h",
    ),
    "z11_ring2": (
        "ring2_event_count_24h", "ring2_event_count_7d", "ring2_active_zones_24h", "ring2_to_ring1_24h_ratio",
    ),
    "z12_district_share": ("zone_24h_share_of_district",),
    "z13_district_rank": ("zone_7d_rank_in_district",),
    "z14_district_percentile": ("zone_same_hour_percentile_in_district",),
    "z15_nearest_active": ("distance_to_nearest_event_3h_m", "distance_to_nearest_event_24h_m"),
    "z16_recent_centroid": ("distance_to_district_recent_centroid_24h_m",),
}


def _zone_query(table, columns: tuple[str, ...]) -> Query:
    return lambda spark, sf: r6(table(spark, sf).select("target_time", "zone_id", *columns))


QUERIES.update({n: _zone_query(I.zone_base, c) for n, c in ZONE_GROUPS.items()})
QUERIES.update({n: _zone_query(I.zone_full, c) for n, c in ENGINEERED_GROUPS.items()})


@query
def z1_label_30m(spark, sf):
    base = zones.zone_base_features(I.events(spark, sf), I.LOOKBACK_DAYS, 30)
    return base.select("target_time", "zone_id", "event_count_next_horizon", "alert_next_30m")


@query
def z17_line_context(spark, sf):
    lines = spatial.line_coverage(I.grid(spark, sf), I.segments(spark, sf)).select(
        "zone_id",
        F.col("nearest_line_m").alias("nearest_road_m"),
        F.col("line_count").alias("road_segment_count"),
        F.col("line_source_mismatch").alias("road_source_mismatch"),
        F.col("has_line").alias("has_drivable_road"),
    )
    seen = I.events(spark, sf).select("zone_id").distinct()
    wider = spatial.neighbors(seen, 2).select(F.col("neighbor_id").alias("zone_id")).union(seen).distinct()
    return r6(zones.add_line_context(wider, lines))


@query
def z18_add_engineered(spark, sf):
    """All that the step adds to a bare zone-time frame: ratios, cycles, rings, ranks, distances, line columns."""
    bare = I.zone_base(spark, sf).select(
        "target_time", "zone_id", "district", "hour", "day_of_week", "zone_event_count_3h", "zone_event_count_24h",
        "zone_event_count_7d", "district_event_count_3h", "district_event_count_24h", "zone_same_hour_rate",
    )
    full = zones.add_engineered(bare)
    return r6(full.select("target_time", "zone_id", *[c for c in full.columns if c not in bare.columns]))


CITY_GROUPS = {
    "a1_activity_label": ("event_count_next_horizon", "activity_next_1h"),
    "a2_city_counts": ("city_event_count_1h", "city_event_count_3h", "city_event_count_24h", "city_event_count_7d"),
    "a3_active_places": ("active_districts_24h", "active_regions_24h"),
    "a4_city_ratios": (
        "city_3h_to_24h_ratio", "city_24h_to_7d_ratio", "hour_bucket", "is_weekend",
        "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    ),
}
QUERIES.update(
    {
        n: (lambda c: lambda spark, sf: r6(I.activity(spark, sf).select("target_time", *c)))(c)
        for n, c in CITY_GROUPS.items()
    }
)


# --- marts -------------------------------------------------------------------------


@query
def m1_sparsity_profile(spark, sf):
    return marts.sparsity_profile(I.grid(spark, sf), I.events(spark, sf))


@query
def m2_hour_profile(spark, sf):
    return marts.hour_profile(I.grid(spark, sf), I.events(spark, sf))


@query
def m3_daily_profile(spark, sf):
    return marts.daily_profile(I.grid(spark, sf), I.events(spark, sf))


@query
def m4_recency_profile(spark, sf):
    return marts.recency_profile(I.grid(spark, sf), I.events(spark, sf))


@query
def m5_neighbor_context(spark, sf):
    return marts.neighbor_context(I.grid(spark, sf), I.events(spark, sf))


@query
def m6_zone_summary(spark, sf):
    return r6(marts.zone_summary(I.events(spark, sf)))


@query
def m7_district_summary(spark, sf):
    valid = clean.valid_reports(I.reports(spark, sf)).withColumnsRenamed(
        {"create_dt": "ts", "upvote": "total_upvotes"}
    )
    return marts.district_summary(adapter.with_places(valid))


@query
def m7_region_share(spark, sf):
    return marts.region_share(I.events(spark, sf))


@query
def m8_group_count_stats(spark, sf):
    return r6(marts.group_count_stats(I.events(spark, sf)))


@query
def m8_empty_groups(spark, sf):
    # Regions have no polygon of their own, so their names stay empty.
    refs = I.polygons(spark, sf).select("district").union(I.table(spark, sf, "region").select("r_name"))
    found = spatial.point_in_polygon_join(I.reports(spark, sf), "report_id", I.edges(spark, sf))
    return marts.empty_groups(refs, found)


@query
def m9_report_totals(spark, sf):
    return marts.report_totals(I.events(spark, sf))


@query
def m9_hourly_counts(spark, sf):
    return marts.hourly_counts(I.events(spark, sf))


@query
def m9_weekday_counts(spark, sf):
    return marts.weekday_counts(I.events(spark, sf))


@query
def m9_heatmap(spark, sf):
    return marts.heatmap(I.events(spark, sf))


@query
def m9_top_addresses(spark, sf):
    return marts.top_addresses(I.events(spark, sf))


@query
def m9_latest_reports(spark, sf):
    return marts.latest_reports(I.events(spark, sf)).select("event_id", "ts", "address")


@query
def m10_dataset_stats(spark, sf):
    rep = I.reports(spark, sf)
    polls = rep.select(timecols.floor_hour(F.col("seen_at")).alias("timestamp")).distinct()
    tables = {"reports": rep, "events": I.events(spark, sf), "polls": polls}
    return marts.dataset_stats(tables, archive.coverage_days(polls, rep))


@query
def m11_top_positive_zones(spark, sf):
    return marts.top_positive_zones(I.zone_base(spark, sf), I.TARGET)


def _resolution_rows(spark, sf) -> DataFrame:
    out = None
    for res in (8, 9, 10):
        def build(res=res):
            return zones.zone_base_features(I.resolution_events(spark, sf, res), I.LOOKBACK_DAYS, I.HORIZON, res)

        frame = I.zone_base(spark, sf) if res == 9 else I.kept(spark, sf, f"zone_base_{res}", build)
        score = ((F.col("zone_event_count_7d") * 7 + F.col("hour")) % 101) / F.lit(100.0)
        scored = frame.select(
            "target_time", "zone_id", score.alias("score"), F.col(I.TARGET).alias("actual")
        )
        one = marts.resolution_profile(frame, I.TARGET, res).withColumns(
            {
                "precision_at_20": metrics.precision_at_k(scored, 20).scalar(),
                "top_decile_lift": metrics.top_decile_lift(scored).scalar(),
            }
        )
        out = one if out is None else out.unionByName(one)
    return out


@query
def m12_resolution_compare(spark, sf):
    return r6(_resolution_rows(spark, sf))


@query
def m12_choose_resolution(spark, sf):
    return r6(marts.choose_resolution(_resolution_rows(spark, sf)))


# --- splits --------------------------------------------------------------------------


@query
def p1_purged_rolling_splits(spark, sf):
    return splits.purged_rolling_splits(I.zone_base(spark, sf), I.HORIZON)


@query
def p1_split_metadata(spark, sf):
    return splits.split_metadata(materialize(splits.purged_rolling_splits(I.zone_base(spark, sf), I.HORIZON)), I.HORIZON)


@query
def p2_positive_count_holdout(spark, sf):
    tags = splits.positive_count_holdout(I.zone_base(spark, sf), I.TARGET, 500)
    return r6(splits.holdout_metadata(tags, 500))


@query
def p3_walk_forward_splits(spark, sf):
    return splits.walk_forward_splits(I.zone_base(spark, sf))


def _roles(df: DataFrame) -> DataFrame:
    return df.groupBy("role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("target_time").alias("first_time"), F.max("target_time").alias("last_time")
    )


@query
def p4_time_quantile_split(spark, sf):
    return _roles(splits.time_quantile_split(I.zone_base(spark, sf)))


@query
def p4_time_index_split(spark, sf):
    return _roles(splits.time_index_split(I.zone_base(spark, sf)))


@query
def p5_positional_split(spark, sf):
    return splits.positional_split(I.events(spark, sf), ["ts", "event_id"]).select("event_id", "position", "role")


@query
def p5_latest_rows(spark, sf):
    return splits.latest_rows(I.events(spark, sf), 500).select("event_id", "ts")


@query
def p6_sample_training_rows(spark, sf):
    return splits.sample_training_rows(I.zone_base(spark, sf), I.TARGET, 2, 0.02, 42).select("target_time", "zone_id", I.TARGET)


@query
def p7_active_windows(spark, sf):
    return splits.active_windows(I.zone_base(spark, sf), I.TARGET).select("target_time", "zone_id", I.TARGET)


@query
def p8_ranker_groups(spark, sf):
    return splits.ranker_groups(I.zone_base(spark, sf), I.TARGET)


# --- metrics ----------------------------------------------------------------------------


def _named(parts: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) rows from one-value tables."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("metric"), F.round(df.columns[-1], 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def e1_precision_recall_at_k(spark, sf):
    s = I.scored(spark, sf)
    return _named(
        {f"p{k}": metrics.precision_at_k(s, k) for k in (20, 50, 100)}
        | {f"r{k}": metrics.recall_at_k(s, k) for k in (20, 50, 100)}
    )


@query
def e2_top_decile_lift(spark, sf):
    return r6(metrics.top_decile_lift(I.scored(spark, sf)))


@query
def e3_brier_score(spark, sf):
    return r6(metrics.brier_score(I.scored(spark, sf)))


@query
def e4_calibration_error(spark, sf):
    return r6(metrics.expected_calibration_error(I.scored(spark, sf)))


@query
def e5_group_hit_rate(spark, sf):
    s = I.scored(spark, sf)
    return _named({f"{g}{k}": metrics.group_hit_rate_at_k(s, g, k) for g in ("district", "region") for k in (5, 20, 50)})


@query
def e6_group_precision(spark, sf):
    s = I.scored(spark, sf)
    return _named({f"gp{k}": metrics.group_precision_at_k(s, k) for k in (5, 20, 50)})


@query
def e7_group_recall(spark, sf):
    s = I.scored(spark, sf)
    return _named({f"gr{k}": metrics.group_recall_at_k(s, k) for k in (5, 20, 50)})


@query
def e8_near_miss_hit_rate(spark, sf):
    s = I.scored(spark, sf)
    return _named({f"nm{k}": metrics.near_miss_hit_rate_at_k(s, k) for k in (1, 3, 20)})


@query
def e9_average_precision(spark, sf):
    return r6(metrics.average_precision(I.model_scores(spark, sf), ["model", "fold"]))


@query
def e10_roc_auc(spark, sf):
    return r6(metrics.roc_auc(I.model_scores(spark, sf), ["model", "fold"]))


@query
def e11_threshold_metrics(spark, sf):
    return r6(metrics.threshold_metrics(I.model_scores(spark, sf), 0.5, ["model"]))


def _fold_summary(spark, sf) -> DataFrame:
    return I.kept(
        spark, sf, "fold_summary", lambda: metrics.score_summary(I.model_scores(spark, sf), ["model", "fold"])
    )


@query
def e12_score_summary(spark, sf):
    return r6(_fold_summary(spark, sf))


@query
def e13_fold_medians(spark, sf):
    names = ["precision_at_20", "precision_at_50", "average_precision", "top_decile_lift", "brier_score"]
    return r6(metrics.fold_medians(_fold_summary(spark, sf), names, spread=("precision_at_20", "average_precision")))


@query
def e14_select_model(spark, sf):
    names = ["precision_at_50", "precision_at_100", "average_precision", "top_decile_lift", "brier_score", "roc_auc"]
    medians = metrics.fold_medians(_fold_summary(spark, sf), names, spread=("precision_at_20",))
    pick = lambda rule: metrics.select_model(medians, rule).select(F.lit(rule).alias("rule"), "model")
    return pick("activity").unionByName(pick("spatial")).unionByName(pick("iteration"))


@query
def e15_historical_baseline(spark, sf):
    split = materialize(splits.time_index_split(I.zone_base(spark, sf)))
    part = lambda r: split.filter(F.col("role") == r)
    return r6(
        metrics.historical_baseline(part("train"), part("test"), I.TARGET).select("target_time", "zone_id", "score")
    )


@query
def e16_dispatch_topk(spark, sf):
    p = I.scored(spark, sf).withColumn("probability", F.col("score"))
    return r6(metrics.dispatch_topk_metrics(scoring.dispatch_rank(p, 1), 50))


@query
def e17_horizon_summary(spark, sf):
    ms = I.model_scores(spark, sf)
    minutes = lambda d: d.withColumn("horizon_minutes", F.when(F.col("fold") == 1, 30).when(F.col("fold") == 2, 60).when(F.col("fold") == 3, 120).otherwise(240))
    tag = lambda m: minutes(ms.filter(F.col("model") == m))
    a = metrics.brier_score(tag("a"), ["horizon_minutes"])
    z = metrics.curve_metrics(tag("b"), ["horizon_minutes"]).select("horizon_minutes", "average_precision")
    return r6(metrics.horizon_summary(a, z))


# --- scoring ----------------------------------------------------------------------------


def _stages(spark, sf, hours: str = "true") -> DataFrame:
    act = I.activity(spark, sf).filter(hours).select(
        "target_time", (F.col("city_event_count_3h") % 10 / F.lit(10.0)).alias("activity_probability")
    )
    spatial_scores = I.scored(spark, sf).withColumnRenamed("score", "spatial_probability")
    return scoring.activity_lookup(spatial_scores, act)


@query
def k1_combine_scores(spark, sf):
    return r6(scoring.combine_scores(_stages(spark, sf))).select(
        "target_time", "zone_id", "probability", "rank", "risk_band"
    )


@query
def k2_activity_lookup(spark, sf):
    return r6(_stages(spark, sf).select("target_time", "zone_id", "activity_probability"))


@query
def k2_activity_lookup_gaps(spark, sf):
    """With an hour of each day missing from the activity table."""
    return r6(_stages(spark, sf, "hour <> 3").select("target_time", "zone_id", "activity_probability"))


def _blended(spark, sf) -> DataFrame:
    f = I.zone_full(spark, sf)
    s = f.withColumn("score", ((F.col("zone_event_count_7d") * 7 + F.col("hour")) % 101) / F.lit(100.0))
    return scoring.blend_recent_prior(s, scoring.blend_alpha(I.TARGET))


@query
def k3_blend_recent_prior(spark, sf):
    return r6(_blended(spark, sf).select("target_time", "zone_id", "score"))


@query
def k4_dispatch_rank(spark, sf):
    p = I.scored(spark, sf).withColumn("probability", F.col("score"))
    return scoring.dispatch_rank(p, 20).select(
        "target_time", "zone_id", "dispatch_rank", F.round("dispatch_score", 9).alias("dispatch_score")
    )


@query
def k5_format_predictions(spark, sf):
    return r6(scoring.format_predictions(I.scored(spark, sf))).select(
        "target_time", "zone_id", "probability", "actual", "rank", "risk_band"
    )


@query
def k6_risk_band(spark, sf):
    s = I.scored(spark, sf)
    band = geo.risk_band(F.col("score")).alias("risk_band")
    forecast = geo.risk_band(F.col("score"), **geo.FORECAST_BANDS).alias("forecast_band")
    return s.groupBy(band, forecast).agg(F.count(F.lit(1)).alias("n"))


@query
def k7_cell_forecast(spark, sf):
    at = F.lit("2024-01-21 10:20:30")
    ev = I.events(spark, sf)
    now = cells.cell_features_at(ev, at)
    prob = F.least(F.lit(1.0), F.col("cell_7d_count") / F.lit(25.0)).alias("probability")
    forecast = scoring.cell_forecast(now.select("grid_cell", "district", "region", prob), ev, at)
    return forecast.select(
        "grid_cell", "lat", "lng", "district", "region", "probability", "risk",
        F.coalesce(F.size("recent_events"), F.lit(0)).alias("recent_count"),
        F.get("recent_events", F.lit(0))["ts"].alias("oldest_recent"),
    )


@query
def k7_recent_events(spark, sf):
    """The events that the forecast lists for each high-risk cell, in order."""
    at, ev = F.lit("2024-01-21 10:20:30"), I.events(spark, sf)
    prob = F.least(F.lit(1.0), F.col("cell_7d_count") / F.lit(25.0)).alias("probability")
    forecast = scoring.cell_forecast(cells.cell_features_at(ev, at).select("grid_cell", "district", "region", prob), ev, at)
    return r6(forecast.select("grid_cell", F.posexplode("recent_events").alias("place", "e")).select("grid_cell", "place", "e.*"))


@query
def k8_hot_zones(spark, sf):
    """All hot zones that a location is shown, with their places."""
    got = scoring.score_locations(I.points(spark, sf), I.scored(spark, sf))
    return r6(got.select("point_id", F.posexplode("hot_zones").alias("place", "z")).select("point_id", "place", "z.*"))


@query
def k8_score_locations(spark, sf):
    got = scoring.score_locations(I.points(spark, sf), I.scored(spark, sf))
    return r6(
        got.select(
            "point_id", "matched_time", "own_zone", "matched_zone", "district", "region", "score", "rank",
            "total_zones", "rank_percentile", "risk_band",
            F.round("distance_km", 6).alias("distance_km"),
            F.get("hot_zones", F.lit(0))["zone_id"].alias("top_zone"),
            F.get("hot_zones", F.lit(0))["distance_km"].alias("top_zone_km"),
        )
    )


@query
def k9_score_multi_horizon(spark, sf):
    s = I.scored(spark, sf)
    other = s.withColumn("score", ((F.col("zone_event_count_24h") * 5 + F.col("hour")) % 97) / F.lit(96.0))
    return r6(scoring.score_locations_multi_horizon(I.points(spark, sf), {"1h": s, "2h": other}))


# --- diagnostics ----------------------------------------------------------------------


@query
def n1_rank_scopes(spark, sf):
    s = I.scored(spark, sf)
    a = diagnose.rank_scopes(s).select("target_time", "zone_id", F.col("rank").alias("artifact_rank"))
    b = diagnose.rank_scopes(s, "per_target_time").select("target_time", "zone_id", F.col("rank").alias("time_rank"))
    return a.join(b, ["target_time", "zone_id"])


@query
def n2_error_summary(spark, sf):
    s = I.scored(spark, sf)
    return r6(
        diagnose.error_summary(s, "2h", 50, "artifact").unionByName(
            diagnose.error_summary(s, "2h", 50, "per_target_time")
        )
    )


@query
def n3_error_by_group(spark, sf):
    return r6(diagnose.error_by_group(I.scored(spark, sf), "district", "2h", 50, "per_target_time"))


@query
def n4_error_by_time(spark, sf):
    return r6(diagnose.error_by_time(I.scored(spark, sf), "2h", 50, "artifact"))


@query
def n5_error_report(spark, sf):
    s = I.scored(spark, sf)
    other = s.withColumn("score", ((F.col("zone_event_count_24h") * 5 + F.col("hour")) % 97) / F.lit(96.0))
    got = diagnose.error_report({"1h": s, "2h": other})
    return r6(got.select("horizon", "rank_scope", "grouping", "level", "rows", "positives", "topk_rows", "topk_tp",
                         "topk_fp", "missed_positives", "mean_score"))


@query
def n6_near_miss_summary(spark, sf):
    return r6(diagnose.near_miss_summary(I.scored(spark, sf), 20))


NUMERIC = ("zone_event_count_3h", "zone_event_count_24h", "zone_event_count_7d", "zone_same_hour_rate",
           "district_event_count_24h", "neighbor_event_count_24h")


@query
def n7_target_correlation(spark, sf):
    return r6(diagnose.target_correlation(I.zone_base(spark, sf), NUMERIC, I.TARGET))


@query
def n8_mutual_info(spark, sf):
    return r6(diagnose.binned_mutual_info(I.zone_base(spark, sf), NUMERIC, I.TARGET))


@query
def n8_nearest_info(spark, sf):
    """The same information without bins, from the third nearest neighbours."""
    return r6(mutual_info.nearest_mutual_info(I.zone_base(spark, sf), NUMERIC, I.TARGET))


@query
def n9_categorical_signal(spark, sf):
    return r6(diagnose.categorical_signal(I.zone_base(spark, sf), ("district", "region", "hour_bucket"), I.TARGET))


@query
def n10_feature_pairs(spark, sf):
    return r6(diagnose.feature_pairs(I.zone_base(spark, sf), NUMERIC, 0.3))


@query
def n11_high_half_rate(spark, sf):
    return r6(diagnose.high_half_positive_rate(I.zone_base(spark, sf), NUMERIC, I.TARGET))


# --- models ----------------------------------------------------------------------------


def _busy(spark, sf):
    """Label with both classes at every size: more events than the average hour."""
    mean = I.activity(spark, sf).agg(F.avg("event_count_next_horizon").alias("m")).scalar()
    return (F.col("event_count_next_horizon") > mean).cast("int")


@query
def l1_preprocess(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    a = models._doubles(I.activity(spark, sf), models.ACTIVITY_NUMERIC)
    fitted = Pipeline(stages=models.preprocess(models.ACTIVITY_NUMERIC, models.ACTIVITY_CATEGORICAL)).fit(a)
    return fitted.transform(a).select("target_time", F.size(vector_to_array("features")).alias("width"))


@query
def l2_train_candidates(spark, sf):
    a, y = I.activity(spark, sf), "activity_next_1h"
    busy = a.withColumn(y, _busy(spark, sf))
    out = None
    for name in models.CANDIDATES:
        if name in models.RANKERS:
            continue  # they need zones, see l2_ranker
        m, rate = models.fit(name, busy, y, models.ACTIVITY_NUMERIC, models.ACTIVITY_CATEGORICAL)
        one = models.predict(m, busy, models.ACTIVITY_NUMERIC, rate).select(
            F.lit(name).alias("model"), "target_time", "score", F.col(y).alias("actual")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query
def l2_early_stopping(spark, sf):
    """Boosted trees of the cell model: rows of the three parts, rounds in use, metrics of the last tenth."""
    return r6(runs.cell_model_report(I.events(spark, sf))[0])


@query
def l2_ranker_pairs(spark, sf):
    """What the ranker learns from, ranked by a score that needs no model: pairs and weights per target time."""
    pairs = ranker.ranked_pairs(I.scored(spark, sf), "actual", [-F.col("score")], 5)
    return r6(
        pairs.groupBy("target_time").agg(
            F.count(F.lit(1)).alias("pairs"), F.countDistinct("positive").alias("positives"), F.countDistinct("negative").alias("negatives"),
            F.max("negative").alias("last_negative"), F.sum("weight").alias("weight"),
        )
    )


@query
def l2_ranker(spark, sf):
    """NDCG of the ranker and of the balanced logistic on the zone holdout, on the same training sample."""
    z = I.zone_full(spark, sf)
    tags = materialize(splits.positive_count_holdout(z, I.TARGET, 50))
    part = lambda role: z.join(tags.filter(F.col("role") == role).select("target_time"), "target_time", "left_semi")
    train = materialize(splits.sample_training_rows(part("train"), I.TARGET))
    out = None
    for name in ("logistic_balanced", "pairwise_ranker"):
        model, rate = models.fit(name, train, I.TARGET, models.ZONE_NUMERIC, models.ZONE_CATEGORICAL)
        one = models.predict(model, part("holdout"), models.ZONE_NUMERIC, rate).withColumn("actual", F.col(I.TARGET).cast("int"))
        row = ranker.ndcg(one).select(F.lit(name).alias("model"), "groups", "ndcg")
        out = row if out is None else out.unionByName(row)
    return r6(out)


@query
def e18_ndcg(spark, sf):
    s = I.model_scores(spark, sf)
    whole = ranker.ndcg(s, None, by=["model", "fold"])
    return r6(whole.join(ranker.ndcg(s, 20, by=["model", "fold"]).select("model", "fold", F.col("ndcg").alias("ndcg_at_20")), ["model", "fold"]))


@query
def l3_evaluate_candidates(spark, sf):
    y = "activity_next_1h"
    busy = I.activity(spark, sf).withColumn(y, _busy(spark, sf))
    return models.evaluate_candidates(
        busy, y, models.ACTIVITY_NUMERIC, models.ACTIVITY_CATEGORICAL, 60,
        tuple(models.CANDIDATES), 4, "activity",
    )


@query
def l4_holdout_fit(spark, sf):
    act = models.holdout_activity(
        I.activity(spark, sf).withColumn("activity_next_1h", _busy(spark, sf)),
        "activity_next_1h", "logistic_balanced",
    )
    return models.holdout_spatial(I.zone_full(spark, sf), I.TARGET, "logistic_balanced", materialize(act))


@query
def l5_two_stage_run(spark, sf):
    busy = I.events(spark, sf)
    return runs.two_stage(busy, 60, ("logistic_balanced",), 2)["holdout_metrics"]


@query
def l6_feature_importance(spark, sf):
    y = "activity_next_1h"
    busy = I.activity(spark, sf).withColumn(y, _busy(spark, sf))
    m, _ = models.fit("random_forest_balanced", busy, y, models.ACTIVITY_NUMERIC, models.ACTIVITY_CATEGORICAL)
    return models.feature_importance(m, models._doubles(busy, models.ACTIVITY_NUMERIC))


@query
def l7_model_io(spark, sf):
    y = "activity_next_1h"
    busy = I.activity(spark, sf).withColumn(y, _busy(spark, sf))
    m, rate = models.fit("logistic_balanced", busy, y, models.ACTIVITY_NUMERIC, models.ACTIVITY_CATEGORICAL)
    path = I.folder(spark, "model")
    models.save_model(m, path)
    score = lambda model: models.predict(model, busy, models.ACTIVITY_NUMERIC, rate).select("target_time", "score")
    loaded = score(models.load_model(path)).withColumnRenamed("score", "again")
    same = F.count_if(F.abs(F.col("score") - F.col("again")) < 1e-12)
    return score(m).join(loaded, "target_time").agg(F.count(F.lit(1)).alias("scored"), same.alias("same"))


@query
def plan_train_and_forecast(spark, sf):
    """The cell model trained on all history, its forecast one row per listed cell."""
    return r6(runs.train_and_forecast(I.events(spark, sf), F.lit("2024-01-21 10:20:30").cast("timestamp_ntz")))


@query
def plan_clean_events(spark, sf):
    return r6(runs.clean_events(I.reports(spark, sf))).select(
        "event_id", "ts", "report_count", "grid_cell", "zone_id", "district", "region"
    )


# --- serving ---------------------------------------------------------------------------


def _merged(spark, sf) -> DataFrame:
    grid = I.grid(spark, sf)
    texts = grid.select(*[F.col(c).cast("string").alias(c) for c in grid.columns])
    return serving.merged_zones(texts, marts.sparsity_profile(grid, I.events(spark, sf)))


@query
def y1_merged_zones(spark, sf):
    return r6(_merged(spark, sf))


@query
def y2_coverage_summary(spark, sf):
    return serving.coverage_summary(_merged(spark, sf))


@query
def y3_coverage_page(spark, sf):
    page = serving.coverage_page(_merged(spark, sf), 25, 5, region="New Territories North", min_events=1)
    return page.select("zone_id", "district", "region", "event_count", "total")


@query
def y4_time_profile(spark, sf):
    grid, ev = I.grid(spark, sf), I.events(spark, sf)
    h = serving.time_profile(marts.hour_profile(grid, ev), "hour").withColumnRenamed("hour", "bucket")
    d = serving.time_profile(marts.daily_profile(grid, ev), "day").withColumnRenamed("day_of_week", "bucket")
    return h.withColumn("grain", F.lit("hour")).unionByName(d.withColumn("grain", F.lit("day")))


def _published(spark, sf, preferred: str = "score IS NULL") -> DataFrame:
    s = I.scored(spark, sf)
    pos = F.col("zone_event_count_7d") % 3
    single = s.select(
        F.date_format("target_time", "yyyy-MM-dd HH:mm:ss").alias("target_time"),
        "zone_id", "district", "region", F.col("score").cast("string").alias("score"),
        F.when(pos == 0, F.lit("")).otherwise((F.col("score") / 2).cast("string")).alias("probability"),
        F.when(pos == 1, F.lit("")).otherwise(F.col("zone_event_count_24h").cast("string")).alias("rank"),
    )
    return serving.prediction_rows(single.filter(preferred), single)


@query
def y5_prediction_rows(spark, sf):
    return r6(_published(spark, sf)).select("target_time", "zone_id", "score", "probability", "rank")


@query
def y5_prediction_rows_preferred(spark, sf):
    """With rows on the preferred side, which then stand alone."""
    return r6(_published(spark, sf, "rank <> ''")).select("target_time", "zone_id", "score", "probability", "rank")


@query
def y6_latest_per_zone(spark, sf):
    return r6(serving.latest_per_zone(_published(spark, sf))).select(
        "zone_id", "target_time", "score", "probability", "rank"
    )


@query
def y7_zone_overlay(spark, sf):
    got = serving.zone_overlay(
        _merged(spark, sf), I.geometry(spark, sf), _published(spark, sf), region="Kowloon West", min_events=1
    )
    feats = archive.geojson_features(got, "ring", ["zone_id", "district", "event_count", "score", "probability"])
    shape = (
        "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, "
        "properties struct<zone_id: string, district: string, event_count: bigint, score: double, probability: double>"
    )
    ring = F.col("f.geometry.coordinates")[0]
    f = feats.select(F.from_json("value", shape).alias("f"))
    return r6(
        f.select(
            "f.properties.*",
            F.col("f.type").alias("type"),
            F.col("f.geometry.type").alias("kind"),
            F.size(ring).cast("bigint").alias("points"),
            (ring[0] == ring[6]).alias("closed"),
        )
    )


def _model_rows(spark, sf) -> DataFrame:
    return _fold_summary(spark, sf).select(
        (F.col("fold") * 30).cast("string").alias("horizon_minutes"), F.col("model").alias("chosen_model"),
        F.col("precision_at_20").alias("median_precision_at_20"),
    )


@query
def y8_model_metrics(spark, sf):
    m = _model_rows(spark, sf)
    return r6(serving.model_metrics(m.filter("chosen_model = 'none'"), m.filter("chosen_model = 'a'")))


@query
def y8_model_metrics_preferred(spark, sf):
    m = _model_rows(spark, sf)
    return r6(serving.model_metrics(m.filter("chosen_model = 'a'"), m.filter("chosen_model = 'b'")))


# --- streaming --------------------------------------------------------------------------


# The table lands in three slices by time, and the stream runs after each landing.
SLICES = ("2024-01-10", "2024-01-20", "2100-01-01")


def _land(spark: SparkSession, df: DataFrame, run: Callable[[DataFrame], None], order: Sequence[int] = (0, 1, 2), last: DataFrame | None = None) -> None:
    path = I.folder(spark, "landed")
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    for k in order:
        since, until = ("1970-01-01", *SLICES)[k : k + 2]
        part = df.filter((F.col("seen_at") >= at(since)) & (F.col("seen_at") < at(until)))
        part.write.mode("append").parquet(path)
        run(spark.readStream.schema(df.schema).parquet(path))
    if last is not None:
        last.write.mode("append").parquet(path)
        run(spark.readStream.schema(df.schema).parquet(path))


@query
def w1_stream_dedupe(spark, sf):
    out, ck = I.folder(spark, "dedupe"), I.folder(spark, "ck")
    _land(
        spark, I.copies(spark, sf),
        lambda s: ingest.run_available(ingest.stream_dedupe(s), ck, "append", path=out),
        order=(1, 2, 0),  # the oldest copies come last, days after their time
    )
    return spark.read.parquet(out).select("report_id")


def _refresh(spark, sf) -> tuple[str, str]:
    state, log, ck = (I.folder(spark, n) for n in ("state", "log", "ck"))
    sink = keyed.states_sink(state, log)
    _land(spark, I.copies(spark, sf), lambda s: ingest.run_available(keyed.refresh_states(s), ck, "update", each=sink))
    return state, log


@query
def w2_stream_refresh(spark, sf):
    return keyed.read_current(spark, _refresh(spark, sf)[0]).select(
        "report_id", "address", "upvote", "downvote", "first_seen", "last_seen"
    )


@query
def w3_stream_batch_log(spark, sf):
    log = keyed.read_log(spark, _refresh(spark, sf)[1])
    return log.agg(
        F.sum("total_reports").alias("total_reports"), F.sum("new_reports").alias("new_reports"),
        F.max("timestamp").alias("last_poll"),
    )


def _landing(spark, sf) -> DataFrame:
    return I.events(spark, sf).select("event_id", "ts", F.col("ts").alias("seen_at"), "zone_id", "grid_cell")


@query
def w4_stream_zone_counts(spark, sf):
    out, ck = I.folder(spark, "counts"), I.folder(spark, "ck")
    sink = ingest.latest_sink(out)
    _land(
        spark, _landing(spark, sf),
        lambda s: ingest.run_available(ingest.zone_counts(s), ck, "update", each=sink),
    )
    return ingest.read_latest(spark, out, ["window_start", "window_end", "zone_id"])


@query
def w4_stream_sliding_counts(spark, sf):
    out, ck = I.folder(spark, "counts"), I.folder(spark, "ck")
    sink = ingest.latest_sink(out)
    _land(
        spark, _landing(spark, sf),
        lambda s: ingest.run_available(ingest.zone_counts(s, "24 hours", "6 hours"), ck, "update", each=sink),
    )
    return ingest.read_latest(spark, out, ["window_start", "window_end", "zone_id"])


def _with_closing(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Events, and a row of no place, far ahead, that moves the watermark past the last sessions."""
    df = _landing(spark, sf)
    later = F.lit("2100-06-01").cast("timestamp_ntz")
    values = {"ts": later, "seen_at": later, "zone_id": F.lit(""), "grid_cell": F.lit("")}
    closing = spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
    return df, closing


@query
def w5_stream_sessions(spark, sf):
    """The middle slice lands last, days behind the watermark."""
    out, ck = I.folder(spark, "sessions"), I.folder(spark, "ck")
    df, closing = _with_closing(spark, sf)
    sink = sessions.sessions_sink(out, gap_minutes=240)
    _land(spark, df, lambda s: ingest.run_available(s, ck, "append", each=sink), order=(0, 2, 1), last=closing)
    return sessions.read_sessions(spark, out, gap_minutes=240).filter("grid_cell <> ''").drop("state")


@query
def w5_stream_sessions_in_order(spark, sf):
    """Sessions of Spark's own state, which drops what comes late: the slices land in time order."""
    out, ck = I.folder(spark, "sessions"), I.folder(spark, "ck")
    df, closing = _with_closing(spark, sf)
    _land(
        spark, df,
        lambda s: ingest.run_available(ingest.stream_sessions(s, gap="240 minutes"), ck, "append", path=out),
        last=closing,
    )
    return spark.read.parquet(out).filter("grid_cell <> ''")
