import math
import random

from pyspark.sql import functions as F

from zonecast.functions import geo, timecols
from zonecast.functions.stations import with_nearest_station
from zonecast.operators import marts, spatial
from zonecast.operators.nearest import nearest_join
from zonecast.sources import adapter, archive
from tests.helpers import t


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).collect()[0].v


def test_local_time_rules(spark):
    f = lambda s: one(spark, timecols.local_time(F.lit(s), "Asia/Hong_Kong"))
    assert f("2026-06-28 17:24:28") == t("2026-06-28 17:24:28")
    assert f("2026-06-29T06:09:24+00:00") == t("2026-06-29 14:09:24")
    assert f("2026-06-29T06:09:24Z") == t("2026-06-29 14:09:24")
    assert one(spark, timecols.parse_any_time(F.lit("2026/06/29 01:02:03"), "Asia/Hong_Kong")) == t("2026-06-29 01:02:03")
    assert one(spark, timecols.parse_any_time(F.lit("junk"), "Asia/Hong_Kong")) is None


def test_names():
    assert timecols.horizon_slug(30) == "30m" and timecols.zone_target(60) == "alert_next_1h"


def test_grid_cell(spark):
    assert one(spark, geo.grid_cell(F.lit(22.3154), F.lit(114.1698))) == "22.315_114.170"


def test_hex_size_ring_and_centre(spark):
    row = spark.range(1).select(F.lit(22.3154).alias("lat"), F.lit(114.1698).alias("lng"))
    q, r = geo.hex_axial(F.col("lat"), F.col("lng"))
    got = row.select(q.alias("q"), r.alias("r")).select("q", "r", geo.hex_polygon(F.col("q"), F.col("r")).alias("ring"), *[c.alias(n) for c, n in zip(geo.hex_center(F.col("q"), F.col("r")), ("y", "x"))])
    (g,) = got.collect()
    assert len(g.ring) >= 7 and g.ring[0] == g.ring[-1]
    kx = 111_320 * math.cos(math.radians(g.y))
    edges = [math.hypot((a[0] - b[0]) * kx, (a[1] - b[1]) * 110_574) for a, b in zip(g.ring, g.ring[1:])]
    assert all(175 < e < 225 for e in edges)
    assert one(spark, geo.hex_zone(F.lit(g.y), F.lit(g.x))) == f"h9:{g.q}:{g.r}"


def test_nearest_station(spark):
    df = spark.createDataFrame([(1, 22.3182, 114.1685), (2, 22.2855, 114.1580)], "id int, lat double, lng double")
    got = {r.id: (r.district, r.region) for r in spatial.nearest_station(df).collect()}
    assert got[1] == ("Yau Tsim Mong", "Kowloon West") and got[2][0] == "Central & Western"


def test_rings_are_disjoint_and_complete(spark):
    z = spark.createDataFrame([("h9:0:0",)], "zone_id string")
    a = {r.neighbor_id for r in spatial.neighbors(z, 1).collect()}
    b = {r.neighbor_id for r in spatial.neighbors(z, 2).collect()}
    assert len(a) == 6 and len(b) == 12 and not (a & b) and "h9:0:0" not in a | b


def test_nearest_join_equals_brute_force(spark):
    rnd = random.Random(5)
    pts = lambda n, spread: [(g, i, 22.2 + rnd.random() * spread, 113.9 + rnd.random() * spread) for g in (1, 2) for i in range(n)]
    # Group 2's candidates sit in one far corner, so queries must look many cells away.
    qs, cs = pts(120, 0.4), pts(40, 0.4)
    cs = [c if c[0] == 1 else (2, c[1], 22.59 + c[1] * 1e-4, 114.29) for c in cs]
    q = spark.createDataFrame(qs, "g int, qid int, lat double, lng double")
    c = spark.createDataFrame(cs, "g int, cid int, lat double, lng double")
    got = {(r.g, r.qid): r.distance_m for r in nearest_join(q, c, ["g"], ["qid"], ["cid"]).collect()}

    def m(a, b, y, x):
        p, s = math.radians(a), math.radians(y)
        h = math.sin((s - p) / 2) ** 2 + math.cos(p) * math.cos(s) * math.sin(math.radians(x - b) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    for g, i, y, x in qs:
        assert abs(got[(g, i)] - min(m(y, x, c[2], c[3]) for c in cs if c[0] == g)) < 1e-3


def test_polygon_holes_edges_and_fallback(spark):
    outer = [[0.0, 0.0], [0.4, 0.0], [0.4, 0.4], [0.0, 0.4], [0.0, 0.0]]
    hole = [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2], [0.1, 0.2], [0.1, 0.1]]
    other = [[1.0, 0.0], [1.2, 0.0], [1.2, 0.2], [1.0, 0.0]]
    polys = spark.createDataFrame([(1, "A", "R", [outer, hole]), (2, "B", "R", [other])], "poly_id int, district string, region string, rings array<array<array<double>>>")
    pts = spark.createDataFrame([(1, 0.3, 0.3), (2, 0.15, 0.15), (3, 0.0, 0.2), (4, 0.05, 0.9), (5, 0.1, 0.1)], "id int, lat double, lng double")
    edges = spatial.polygon_edges(polys)
    inside = {r.id for r in spatial.covering_polygon(pts, "id", edges).collect()}
    assert inside == {1, 3, 5}  # 2 lies in the hole, 3 and 5 on edges
    got = {r.id: r.district for r in spatial.point_in_polygon_join(pts, "id", edges).collect()}
    assert got == {1: "A", 2: "A", 3: "A", 4: "B", 5: "A"}


def test_explode_lines_keeps_drivable(spark):
    feat = lambda hw: (f'{{"type":"Feature","properties":{{"highway":{hw},"name":"N"}},"geometry":{{"type":"LineString","coordinates":[[114.1,22.3],[114.2,22.4]]}}}}',)
    df = spark.createDataFrame([feat('"residential"'), feat('"footway"'), feat('["service","footway"]')], "value string")
    (s,) = archive.explode_lines(df).collect()
    assert (s.road_class, s.name, s.lat_a, s.lng_b) == ("residential", "N", 22.3, 114.2)


def test_line_coverage_keeps_near_and_observed(spark):
    cells = spark.createDataFrame(
        [("near", 22.3, 114.1, 0), ("far", 22.4, 114.3, 0), ("miss", 22.4, 114.31, 1)],
        "zone_id string, zone_lat double, zone_lng double, has_observed_history int",
    )
    segs = spark.createDataFrame([(1, "residential", "N", 22.3, 114.099, 22.3, 114.101)], "segment_id int, road_class string, name string, lat_a double, lng_a double, lat_b double, lng_b double")
    got = {r.zone_id: r.line_source_mismatch for r in spatial.line_coverage(cells, segs).collect()}
    assert got == {"near": 0, "miss": 1}


def test_marts_keep_silent_cells(spark, sf):
    ev = adapter.events(spark, sf)
    grid = spatial.coverage_grid(spark.createDataFrame([("h9:500:500",)], "zone_id string"), ev.select("zone_id").distinct())
    n = grid.count()
    assert marts.hour_profile(grid, ev).count() == 24 * n and marts.daily_profile(grid, ev).count() == 7 * n
    quiet = marts.sparsity_profile(grid, ev).filter("is_zero_history = 1").collect()
    assert [r.zone_id for r in quiet] == ["h9:500:500"]


def test_salvage_splits_good_and_broken(spark):
    text = '{"meta":{"a":1},"alerts":{"1":{"lat":"22.3","upvote":"2"},"2":{"lat":22.x},"3":{"lat":"22.4","create'
    good, bad = archive.salvage_reports(spark.createDataFrame([("f", text)], "path string, value string"))
    assert [(r.report_id, r.upvote) for r in good.collect()] == [("1", 2)]
    pieces = {r.k: r.raw for r in bad.collect()}
    assert set(pieces) == {"2", None} and '"create' in pieces[None]


def test_a_null_check_of_the_district_compares_no_reference_points(spark):
    at = spark.createDataFrame([(1, 22.2816, 114.1585), (2, None, 114.0), (3, 22.3, None)], "k int, lat double, lng double")
    placed = with_nearest_station(at)
    assert {r["k"]: (r["district"], r["region"]) for r in placed.collect()} == {1: ("Central & Western", "Hong Kong Island"), 2: (None, None), 3: (None, None)}
    known = placed.filter("district IS NOT NULL")
    assert [r["k"] for r in known.collect()] == [1]
    assert known._jdf.queryExecution().optimizedPlan().toString().count("array_min") == 1


def test_sparsity_profile_reads_events_once(spark):
    grid = spark.createDataFrame([("a", "d1", "r1"), ("b", "d1", "r1"), ("c", "d2", "r1"), ("d", None, None)], "zone_id string, district string, region string")
    rows = [("a", "d1", "r1"), ("a", "d1", "r1"), ("a", "d2", "r1"), ("x", "d1", "r2"), ("c", None, "r1"), (None, "d2", None), ("b", "d3", "r3")]
    ev = spark.createDataFrame(rows, "zone_id string, district string, region string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    found = marts.sparsity_profile(grid, ev.mapInArrow(counted, ev.schema)).collect()
    got = {r["zone_id"]: (r["event_count"], r["district_event_count"], r["region_event_count"]) for r in found}
    assert got == {"a": (3, 3, 4), "b": (1, 3, 4), "c": (1, 2, 4), "d": (0, 0, 0)}
    assert reads.value == len(rows)
