"""Polygon covers against every edge of every polygon."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonecast.operators import cover, spatial

EDGES = "poly_id int, district string, region string, x1 double, y1 double, x2 double, y2 double"


def outline(n, radius, centre, wave=0.3, turns=7):
    """A closed outline of n edges around a centre given as x and y."""
    a = np.linspace(0, 2 * math.pi, n, endpoint=False)
    r = radius * (1 + wave * np.sin(turns * a) + 0.02 * np.sin(211 * a))
    return np.column_stack([centre[0] + r * np.cos(a), centre[1] + r * np.sin(a)])


def edge_rows(spark, rings):
    parts = []
    for poly, points in rings:
        nxt = np.roll(points, -1, axis=0)
        parts.append(pd.DataFrame({"poly_id": poly, "district": f"D{poly}", "region": "R", "x1": points[:, 0], "y1": points[:, 1], "x2": nxt[:, 0], "y2": nxt[:, 1]}))
    return spark.createDataFrame(pd.concat(parts), EDGES)


def inside(rings, x, y):
    """Smallest polygon whose rings a ray to the right crosses an odd number of times."""
    odd = {}
    for poly, p in rings:
        q = np.roll(p, -1, axis=0)
        spans = (p[:, 1] > y) != (q[:, 1] > y)
        at = (q[spans, 0] - p[spans, 0]) * (y - p[spans, 1]) / (q[spans, 1] - p[spans, 1]) + p[spans, 0]
        odd[poly] = odd.get(poly, 0) + int((x < at).sum())
    return min((k for k, n in odd.items() if n % 2), default=None)


def found(spark, rings, points, **settings):
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(points)), "lat": [p[1] for p in points], "lng": [p[0] for p in points]}))
    got = cover.covering_polygon(df, "id", edge_rows(spark, rings), **settings)
    return {r.id: r.poly_id for r in got.collect()}


@pytest.mark.parametrize("width", [0.02, 0.3])
def test_holes_overlaps_and_dense_outlines(spark, width):
    rnd = random.Random(3)
    rings = [
        (2, outline(600, 0.31, (114.1, 22.3))),
        (2, outline(90, 0.1, (114.1, 22.3))),  # a hole
        (1, outline(40, 0.2, (114.4, 22.4))),
        (3, np.array([[113.5, -0.1], [113.9, -0.1], [113.9, 0.1], [113.5, 0.1]])),  # across the equator, round coordinates
        (4, outline(50, 0.004, (-0.001, 22.0))),  # smaller than a cell, across the meridian
    ]
    points = [(113.6 + rnd.random() * 1.1, 21.9 + rnd.random() * 0.8) for _ in range(1500)]
    points += [(113.4 + rnd.random() * 0.6, rnd.random() * 0.4 - 0.2) for _ in range(300)]
    points += [(rnd.random() * 0.02 - 0.011, 21.99 + rnd.random() * 0.02) for _ in range(300)]
    points += [(round(x, 1), round(y, 1)) for x, y in points[1500:1800] if round(y, 1) not in (-0.1, 0.1) and round(x, 1) not in (113.5, 113.9)]
    got = found(spark, rings, points, width=width)
    assert got == {k: p for k, (x, y) in enumerate(points) if (p := inside(rings, x, y)) is not None}
    assert len(set(got.values())) == 4


def test_long_outline_gives_cells_of_few_edges(spark):
    """100,000 edges, most of them in a few cells of the first grid."""
    rnd = random.Random(4)
    rings = [(1, outline(100_000, 0.03, (114.1, 22.3), turns=40))]
    table = cover.polygon_cover(edge_rows(spark, rings)).withColumn("n", F.size("edges"))
    border = table.filter("edges IS NOT NULL").agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    assert border["most"] <= cover.MOST_EDGES and border["all"] < 200_000
    points = [(114.1 + rnd.uniform(-0.05, 0.05), 22.3 + rnd.uniform(-0.05, 0.05)) for _ in range(400)]
    assert found(spark, rings, points) == {k: 1 for k, (x, y) in enumerate(points) if inside(rings, x, y)}


def test_wide_polygons_are_few_blocks(spark):
    rings = [(1, np.array([[100.013, 20.017], [120.031, 20.017], [120.031, 22.043], [100.013, 22.043]]))]
    table = cover.polygon_cover(edge_rows(spark, rings))
    rows = table.filter("edges IS NULL").groupBy("i").count()
    assert rows.agg(F.max("count")).first()[0] <= 6 * 9  # a thousand cells wide
    assert table.filter("edges IS NOT NULL").agg(F.max(F.size("edges"))).first()[0] <= 2
    points = [(100.02, 20.02), (110.0, 21.0), (120.03, 22.04), (99.9, 21.0), (110.0, 22.05)]
    assert found(spark, rings, points) == {0: 1, 1: 1, 2: 1}


def test_odd_rows(spark):
    edges = edge_rows(spark, [(1, outline(30, 0.1, (114.1, 22.3)))])
    points = spark.createDataFrame([(1, 22.3, 114.1), (1, 22.3, 114.1), (2, None, 114.1), (3, 22.3, None)], "id int, lat double, lng double")
    assert [(r.id, r.poly_id) for r in cover.covering_polygon(points, "id", edges).collect()] == [(1, 1)]
    broken = edges.unionByName(edges.limit(1).withColumn("x1", F.lit(None).cast("double")))
    assert cover.covering_polygon(points, "id", broken).count() == 1
    nothing = cover.covering_polygon(points, "id", edges.limit(0))
    assert nothing.count() == 0 and nothing.columns == ["id", "poly_id", "district", "region"]
    assert cover.covering_polygon(points.limit(0), "id", edges).count() == 0


def test_all_points_get_a_district(spark):
    edges = edge_rows(spark, [(1, outline(200, 0.1, (114.1, 22.3))), (2, outline(200, 0.1, (114.9, 22.3)))])
    points = spark.createDataFrame([(1, 22.3, 114.1), (2, 22.3, 114.45), (3, 22.3, 114.6), (4, 23.3, 118.0)], "id int, lat double, lng double")
    got = {r.id: r.district for r in spatial.point_in_polygon_join(points, "id", edges).collect()}
    assert got == {1: "D1", 2: "D1", 3: "D2", 4: "D2"}


def test_points_are_dealt_by_key_before_a_minimum_sorts_them(spark):
    """A minimum of structs is taken by sorting; before the rows are dealt out, one task would sort all that it reads."""
    points = spark.createDataFrame([("a", 0.5, 0.5), ("b", 3.0, 3.0)], "k string, lat double, lng double")
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    edges = spatial.polygon_edges(spark.createDataFrame([(1, "d", "r", [ring])], "poly_id long, district string, region string, rings array<array<array<double>>>"))
    for found, key in ((cover.covering_polygon(points, "k", edges), "a"), (spatial.nearest_polygon(points.filter("k = 'b'"), "k", edges), "b")):
        lines = found._jdf.queryExecution().sparkPlan().toString().splitlines()
        partial = next(n for n, x in enumerate(lines) if "partial_min" in x)
        assert any("REPARTITION_BY_COL" in x for x in lines[partial:]) or any("RepartitionByExpression" in x for x in lines[partial:])
        assert [r.k for r in found.collect()] == [key]
