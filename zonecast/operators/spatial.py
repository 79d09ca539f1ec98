"""Spatial joins and grids: districts, polygons, neighbours, coverage and lines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions import geo
from zonecast.functions.stations import with_nearest_station
from zonecast.functions.timecols import local_time
from zonecast.operators.clean import COVERAGE_BOX, MODEL_BOX, in_bbox
from zonecast.operators.cover import covering_polygon
from zonecast.operators.nearest import PLANE, as_side, nearest_join, possible_meetings
from zonecast.session import materialize


def nearest_station(df: DataFrame) -> DataFrame:
    """District and region of the nearest fixed reference point."""
    return with_nearest_station(df)


def nearest_reference(df: DataFrame, key: str, stations: DataFrame) -> DataFrame:
    """Same for a reference table of any size: (seq, name, region, lat, lng)."""
    found = nearest_join(df, stations, [], [key], ["seq", "name", "region"])
    return df.join(
        found.select(key, F.col("name").alias("district"), "region"), key, "left"
    )


# --- polygons -------------------------------------------------------------------


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """(poly_id, district, region, rings of [lng, lat]) to one row per ring edge."""
    ring = F.col("ring")
    return (
        polygons.select(
            "poly_id", "district", "region", F.posexplode("rings").alias("ring_id", "ring")
        )
        .select(
            "poly_id",
            "district",
            "region",
            "ring_id",
            F.explode(
                F.arrays_zip(
                    F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"),
                    F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"),
                )
            ).alias("e"),
        )
        .select(
            "poly_id",
            "district",
            "region",
            "ring_id",
            F.get("e.a", F.lit(0)).alias("x1"),
            F.get("e.a", F.lit(1)).alias("y1"),
            F.get("e.b", F.lit(0)).alias("x2"),
            F.get("e.b", F.lit(1)).alias("y2"),
        )
    )


def _bin(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def nearest_polygon(df: DataFrame, key: str, edges: DataFrame, leaf: float = 0.02) -> DataFrame:
    """(key, poly_id, district, region) of the polygon at the smallest degree distance.

    Edges are cut into pieces no longer than a leaf cell, each bounded by its own box, so few pieces are left per point.
    A point without a position is absent, as are edges with a null coordinate.
    """
    n = F.greatest(
        F.lit(1),
        F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / F.lit(leaf)),
    )
    known = edges.dropna(subset=["x1", "y1", "x2", "y2"])
    pieces = known.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    run = lambda a, share: F.col(f"{a}1") + (F.col(f"{a}2") - F.col(f"{a}1")) * share / F.col("_n")
    # Ends of a piece, and its middle as the place that decides its cell.
    ends = {a: (run(a, F.col("_k") - 1), run(a, F.col("_k"))) for a in "yx"}
    c = materialize(
        pieces.select(
            *("poly_id", "district", "region", "x1", "y1", "x2", "y2"),
            *as_side("c", [run(a, F.col("_k") - 0.5) for a in "yx"]),
            *[F.least(*ends[a]).alias(f"c{k}_low") for k, a in enumerate("yx")],
            *[F.greatest(*ends[a]).alias(f"c{k}_high") for k, a in enumerate("yx")],
        )
    )
    q = materialize(df.dropna(subset=["lat", "lng"]).select(key, *as_side("q", [F.col("lat"), F.col("lng")])))
    away = geo.segment_distance_deg(
        F.col("q1"), F.col("q0"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")
    )
    return (
        possible_meetings(q, c, [], PLANE, leaf)
        .select(key, F.struct(F.round(away, 12).alias("d"), "poly_id", "district", "region").alias("_p"))
        .repartition(key)  # else the few tasks that make meetings sort all of theirs for a partial minimum
        .groupBy(key)
        .agg(F.min("_p").alias("_p"))
        .select(key, "_p.poly_id", "_p.district", "_p.region")
    )


def point_in_polygon_join(df: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """District of the covering polygon, else of the nearest one."""
    inside = materialize(covering_polygon(df, key, edges))
    # As many keys as there are points inside, whatever their files take: sorted, not sent to every task.
    outside = df.join(inside.select(key).hint("merge"), key, "left_anti")
    placed = inside.unionByName(nearest_polygon(outside, key, edges))
    return df.join(placed.select(key, "district", "region"), key, "left")


# --- zones ----------------------------------------------------------------------


def enrich_zones(df: DataFrame, zone: str, resolution: int = geo.DEFAULT_RESOLUTION) -> DataFrame:
    """Keep the model box and add local time, cell, hex zone, centre, district, region."""
    from zonecast.sources.adapter import with_places

    boxed = in_bbox(df, MODEL_BOX)
    placed = with_places(boxed.withColumn("dt", local_time(F.col("create_dt"), zone)), resolution)
    return placed.withColumn("zone_resolution", F.lit(resolution)).orderBy("dt", "report_id")


def neighbors(zones: DataFrame, ring: int = 1, zone_col: str = "zone_id") -> DataFrame:
    """(zone, neighbor_id): the lattice ring around every zone, present or not."""
    offsets = geo.RING1 if ring == 1 else geo.RING2
    q, r = geo.hex_qr(F.col(zone_col))
    steps = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in offsets])
    prefix = F.split_part(F.col(zone_col), F.lit(":"), F.lit(1))
    return zones.select(
        "*", q.alias("_q"), r.alias("_r"), F.explode(steps).alias("_s")
    ).select(
        *zones.columns,
        F.concat_ws(
            ":", prefix, F.col("_q") + F.col("_s.dq"), F.col("_r") + F.col("_s.dr")
        ).alias("neighbor_id"),
    )


def zone_polygons(zones: DataFrame, resolution: int = geo.DEFAULT_RESOLUTION) -> DataFrame:
    q, r = geo.hex_qr(F.col("zone_id"))
    return zones.withColumn("ring", geo.hex_polygon(q, r, resolution))


def lattice_in_box(boxes: DataFrame, resolution: int = geo.DEFAULT_RESOLUTION) -> DataFrame:
    """Zones whose centre lies in each row's box (lat_min, lat_max, lng_min, lng_max)."""
    edge = geo.hex_edge_m(resolution)
    per_row = 1.5 * edge / geo.M_PER_LAT
    per_col = math.sqrt(3.0) * edge / geo._lng_scale()
    row = lambda lat: (lat - F.lit(geo.HEX_ORIGIN[0])) / F.lit(per_row)
    col = lambda lng: (lng - F.lit(geo.HEX_ORIGIN[1])) / F.lit(per_col) - F.col("r") / F.lit(2.0)
    rows = boxes.withColumn(
        "r",
        F.explode(
            F.sequence(F.floor(row(F.col("lat_min"))).cast("bigint"), F.ceil(row(F.col("lat_max"))).cast("bigint"))
        ),
    )
    cells = rows.withColumn(
        "q",
        F.explode(
            F.sequence(F.floor(col(F.col("lng_min"))).cast("bigint"), F.ceil(col(F.col("lng_max"))).cast("bigint"))
        ),
    )
    lat, lng = geo.hex_center(F.col("q"), F.col("r"), resolution)
    return (
        cells.select(
            geo.hex_id(F.col("q"), F.col("r"), resolution).alias("zone_id"),
            lat.alias("lat"),
            lng.alias("lng"),
            "lat_min",
            "lat_max",
            "lng_min",
            "lng_max",
        )
        .filter("lat BETWEEN lat_min AND lat_max AND lng BETWEEN lng_min AND lng_max")
        .select("zone_id", F.col("lat"), F.col("lng"))
        .distinct()
    )


def polygon_fill(edges: DataFrame, resolution: int = geo.DEFAULT_RESOLUTION) -> DataFrame:
    """Zones whose centre is inside any polygon."""
    boxes = edges.groupBy("poly_id").agg(
        F.min(F.least("y1", "y2")).alias("lat_min"),
        F.max(F.greatest("y1", "y2")).alias("lat_max"),
        F.min(F.least("x1", "x2")).alias("lng_min"),
        F.max(F.greatest("x1", "x2")).alias("lng_max"),
    )
    cells = lattice_in_box(boxes, resolution)
    return covering_polygon(cells, "zone_id", edges).select("zone_id")


def observed_zones(
    df: DataFrame, resolution: int = geo.DEFAULT_RESOLUTION, box: Sequence[float] = COVERAGE_BOX
) -> DataFrame:
    kept = in_bbox(df, box)
    return kept.select(geo.hex_zone(F.col("lat"), F.col("lng"), resolution).alias("zone_id")).distinct()


def coverage_grid(
    fill: DataFrame, observed: DataFrame, resolution: int = geo.DEFAULT_RESOLUTION
) -> DataFrame:
    """Union of fill and observed zones with history flags and the district of the centre."""
    seen = observed.select("zone_id", F.lit(1).alias("_seen"))
    zones = fill.select("zone_id").join(seen, "zone_id", "full")
    q, r = geo.hex_qr(F.col("zone_id"))
    lat, lng = geo.hex_center(q, r, resolution)
    flag = F.coalesce("_seen", F.lit(0))
    placed = zones.select(
        "zone_id",
        F.lit(resolution).alias("resolution"),
        lat.alias("lat"),
        lng.alias("lng"),
        flag.alias("has_observed_history"),
        (F.lit(1) - flag).alias("is_zero_history"),
        F.when(flag == 1, "observed_and_grid").otherwise("fixed_grid").alias("coverage_source"),
    )
    return nearest_station(placed).withColumnsRenamed({"lat": "zone_lat", "lng": "zone_lng"})


# --- lines ----------------------------------------------------------------------


def line_bins(segments: DataFrame, width: float = 0.01) -> DataFrame:
    """One row per bin of each segment's bounding box."""
    lat = F.sequence(_bin(F.least("lat_a", "lat_b"), width), _bin(F.greatest("lat_a", "lat_b"), width))
    lng = F.sequence(_bin(F.least("lng_a", "lng_b"), width), _bin(F.greatest("lng_a", "lng_b"), width))
    return segments.withColumn("by", F.explode(lat)).withColumn("bx", F.explode(lng))


def _match(cells: DataFrame, binned: DataFrame, reach: int, width: float, buffer_m: float) -> DataFrame:
    """Best and nearby lines of each cell among segments within ``reach`` bins.

    Cells are lattice points, so a segment meets a bounded number of cells per bin.
    A segment that shares several bins with a cell is counted once.
    """
    around = F.array(
        *[
            F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"))
            for a in range(-reach, reach + 1)
            for b in range(-reach, reach + 1)
        ]
    )
    probes = cells.select("zone_id", "zone_lat", "zone_lng", F.explode(around).alias("_s")).select(
        "zone_id",
        "zone_lat",
        "zone_lng",
        (_bin(F.col("zone_lat"), width) + F.col("_s.dy")).alias("by"),
        (_bin(F.col("zone_lng"), width) + F.col("_s.dx")).alias("bx"),
    )
    # A segment is reported only from its first bin inside the probe window.
    lo_y, lo_x = _bin(F.col("zone_lat"), width) - reach, _bin(F.col("zone_lng"), width) - reach
    first = (F.col("by") == F.greatest(lo_y, _bin(F.least("lat_a", "lat_b"), width))) & (
        F.col("bx") == F.greatest(lo_x, _bin(F.least("lng_a", "lng_b"), width))
    )
    d = geo.segment_distance_m(
        F.col("zone_lat"), F.col("zone_lng"), F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")
    )
    near = F.col("_d") <= buffer_m
    return (
        probes.join(binned, ["by", "bx"])
        .filter(first)
        .withColumn("_d", d)
        .groupBy("zone_id")
        .agg(
            F.min(F.struct("_d", "segment_id", "name")).alias("_n"),
            F.count(F.when(near, 1)).alias("line_count"),
            F.array_join(
                F.sort_array(F.collect_set(F.when(near & (F.col("road_class") != ""), F.col("road_class")))), "|"
            ).alias("line_classes"),
        )
        .select(
            "zone_id",
            F.round("_n._d", 1).alias("nearest_line_m"),
            F.col("_n.name").alias("nearest_line_name"),
            "line_count",
            "line_classes",
        )
    )


def nearest_line_join(
    cells: DataFrame, segments: DataFrame, buffer_m: float = 60.0, width: float = 0.01
) -> DataFrame:
    """Nearest line and the lines within a buffer of every cell centre.

    3x3 bins first; only cells that met no segment there look at 7x7 bins.
    """
    binned = line_bins(segments, width)
    close = materialize(_match(cells, binned, 1, width, buffer_m))
    rest = cells.join(close.select("zone_id"), "zone_id", "left_anti")
    found = close.unionByName(_match(rest, binned, 3, width, buffer_m))
    return cells.join(found, "zone_id", "left").withColumns(
        {
            "line_count": F.coalesce("line_count", F.lit(0)),
            "line_classes": F.coalesce("line_classes", F.lit("")),
            "nearest_line_name": F.coalesce("nearest_line_name", F.lit("")),
            "has_line": (F.coalesce("line_count", F.lit(0)) > 0).cast("int"),
        }
    )


def line_coverage(grid: DataFrame, segments: DataFrame, buffer_m: float = 60.0) -> DataFrame:
    """Cells with a line or with history; flags history that no line explains."""
    joined = nearest_line_join(grid, segments, buffer_m)
    seen = F.col("has_observed_history").cast("int")
    return joined.filter((F.col("has_line") == 1) | (seen == 1)).withColumns(
        {
            "has_observed_history": seen,
            "is_zero_history": F.lit(1) - seen,
            "line_source_mismatch": ((seen == 1) & (F.col("has_line") == 0)).cast("int"),
            "coverage_source": F.when(F.col("has_line") == 1, "road_access").otherwise(
                "observed_without_road_match"
            ),
        }
    )
