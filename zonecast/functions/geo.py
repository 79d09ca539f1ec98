"""Spatial column expressions: distances, square cells and a planar hex lattice."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius and metres per degree of the local projections.
EARTH_RADIUS_M = 6_371_000.0
EARTH_RADIUS_KM = 6371.0
M_PER_LAT = 110_574.0
M_PER_LNG_EQUATOR = 111_320.0
MISSING_DISTANCE_M = 999_999.0

# Hex lattice: edge at resolution 9, each coarser level is sqrt(7) longer.
HEX_EDGE_RES9_M = 201.0
HEX_ORIGIN = (22.35, 114.15)
DEFAULT_RESOLUTION = 9

RING1 = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
RING2 = tuple(
    (q, r)
    for q in range(-2, 3)
    for r in range(-2, 3)
    if max(abs(q), abs(r), abs(q + r)) == 2
)


def hav_term(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The haversine of the central angle; orders points the same way as distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    return F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(half_lng), F.lit(2.0)
    )


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = hav_term(lat1, lng1, lat2, lng2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(hav_term(lat1, lng1, lat2, lng2)))


def cell_index(value: Column, step: float = 0.005) -> Column:
    """Half-even lattice index of a coordinate."""
    return F.rint(value / F.lit(step)).cast("bigint")


def cell_name(i: Column, j: Column, step: float = 0.005) -> Column:
    return F.format_string("%.3f_%.3f", i * F.lit(step), j * F.lit(step))


def grid_cell(lat: Column, lng: Column, step: float = 0.005) -> Column:
    return cell_name(cell_index(lat, step), cell_index(lng, step), step)


def cell_part(cell: Column, part: int, step: float = 0.005) -> Column:
    """Lattice index back from a cell name (part 1 = lat, 2 = lng)."""
    return cell_index(F.split_part(cell, F.lit("_"), F.lit(part)).cast("double"), step)


def hex_edge_m(resolution: int) -> float:
    return HEX_EDGE_RES9_M * math.sqrt(7.0) ** (DEFAULT_RESOLUTION - resolution)


def _lng_scale() -> float:
    return M_PER_LNG_EQUATOR * math.cos(math.radians(HEX_ORIGIN[0]))


def hex_axial(lat: Column, lng: Column, resolution: int = DEFAULT_RESOLUTION) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon that holds a point."""
    edge = hex_edge_m(resolution)
    x = (lng - F.lit(HEX_ORIGIN[1])) * F.lit(_lng_scale() / edge)
    y = (lat - F.lit(HEX_ORIGIN[0])) * F.lit(M_PER_LAT / edge)
    qf = x * F.lit(math.sqrt(3.0) / 3.0) - y / F.lit(3.0)
    rf = y * F.lit(2.0 / 3.0)
    sf = F.lit(0.0) - qf - rf
    q, r, s = F.rint(qf), F.rint(rf), F.rint(sf)
    dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
    q_worst = (dq > dr) & (dq > ds)
    r_worst = ~q_worst & (dr > ds)
    zero = F.lit(0.0)
    return (
        F.when(q_worst, zero - r - s).otherwise(q).cast("bigint"),
        F.when(r_worst, zero - q - s).otherwise(r).cast("bigint"),
    )


def hex_id(q: Column, r: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    return F.format_string(f"h{resolution}:%d:%d", q, r)


def hex_zone(lat: Column, lng: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    return hex_id(*hex_axial(lat, lng, resolution), resolution)


def hex_qr(zone: Column) -> tuple[Column, Column]:
    """Axial coordinates back from a zone id."""
    part = lambda k: F.split_part(zone, F.lit(":"), F.lit(k)).cast("bigint")
    return part(2), part(3)


def hex_center(q: Column, r: Column, resolution: int = DEFAULT_RESOLUTION) -> tuple[Column, Column]:
    """Latitude and longitude of a hexagon's centre."""
    edge = hex_edge_m(resolution)
    lat = F.lit(HEX_ORIGIN[0]) + r.cast("double") * F.lit(1.5 * edge / M_PER_LAT)
    lng = F.lit(HEX_ORIGIN[1]) + (q.cast("double") + r.cast("double") / F.lit(2.0)) * F.lit(
        math.sqrt(3.0) * edge / _lng_scale()
    )
    return lat, lng


def hex_polygon(q: Column, r: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """Closed ring of [lng, lat] pairs."""
    edge = hex_edge_m(resolution)
    lat, lng = hex_center(q, r, resolution)
    corners = []
    for k in (0, 1, 2, 3, 4, 5, 0):
        angle = math.radians(60 * k + 30)
        corners.append(
            F.array(
                lng + F.lit(edge * math.cos(angle) / _lng_scale()),
                lat + F.lit(edge * math.sin(angle) / M_PER_LAT),
            )
        )
    return F.array(*corners)


def segment_distance_m(
    lat: Column, lng: Column, lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column
) -> Column:
    """Point to segment in metres, projected at the point's latitude."""
    kx, ky = F.lit(M_PER_LNG_EQUATOR) * F.cos(F.radians(lat)), F.lit(M_PER_LAT)
    return F.sqrt(_segment_sq(lng * kx, lat * ky, lng_a * kx, lat_a * ky, lng_b * kx, lat_b * ky))


def segment_distance_deg(
    x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column
) -> Column:
    """Point to segment in plain degrees."""
    return F.sqrt(_segment_sq(x, y, x1, y1, x2, y2))


def _segment_sq(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    along = ((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def safe_divide(num: Column, den: Column) -> Column:
    """0 when the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def risk_band(
    score: Column,
    cuts: tuple[float, ...] = (0.10, 0.05, 0.02),
    labels: tuple[str, ...] = ("critical", "high", "elevated", "low"),
) -> Column:
    """Label of the first cut a clipped score reaches."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    band = F.when(value >= cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        band = band.when(value >= cut, label)
    return band.otherwise(labels[-1])


FORECAST_BANDS = {"cuts": (0.7, 0.4), "labels": ("high", "medium", "low")}


def location_band(score: Column, percentile: Column) -> Column:
    """Band by percentile or score, whichever is higher."""
    return (
        F.when((percentile >= 0.9) | (score >= 0.75), "high")
        .when((percentile >= 0.6) | (score >= 0.4), "medium")
        .otherwise("low")
    )
