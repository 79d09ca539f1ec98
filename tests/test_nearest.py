"""The nearest-neighbour join against all pairs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from zonecast.functions.geo import EARTH_RADIUS_M
from zonecast.operators import nearest
from zonecast.session import materialize


def table(spark, lat, lng, name, group=None):
    df = pd.DataFrame({"g": group if group is not None else 0, name: np.arange(len(lat)), "lat": lat, "lng": lng})
    return spark.createDataFrame(df, f"g int, {name} int, lat double, lng double")


def metres(lat, lng, lats, lngs):
    a, b, c, d = (np.radians(v) for v in (lat, lng, lats, lngs))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(h))


def check(spark, q, c):
    got = nearest.nearest_join(table(spark, *q, "k"), table(spark, *c, "p"), [], ["k"], ["p"]).toPandas().set_index("k")
    assert len(got) == len(q[0])
    for k, (y, x) in enumerate(zip(*q)):
        assert abs(got.distance_m[k] - metres(y, x, *c).min()) < 1e-3


def test_whole_globe_with_poles_and_antimeridian(spark):
    rnd = np.random.default_rng(1)
    everywhere = lambda n: (np.degrees(np.arcsin(rnd.uniform(-1, 1, n))), rnd.uniform(-180, 180, n))
    q, c = everywhere(400), everywhere(150)
    edge = (np.array([0.0, 0.0, 89.9, -89.9]), np.array([179.99, -179.99, 10.0, -170.0]))
    check(spark, tuple(np.concatenate(v) for v in zip(q, edge)), tuple(np.concatenate(v) for v in zip(c, (np.array([0.0, 90.0]), np.array([-180.0, 0.0])))))


def test_dense_leaf_compares_few_pairs(spark):
    """10,000 points and 10,000 candidates within 0.02 degrees."""
    rnd = np.random.default_rng(2)
    q, c = [(22.30 + rnd.random(10_000) * 0.02, 114.16 + rnd.random(10_000) * 0.02) for _ in range(2)]
    sides = [
        materialize(table(spark, *t, n).select("g", n, *nearest.as_side(s, nearest.on_sphere(F.col("lat"), F.col("lng")))))
        for t, n, s in ((q, "k", "q"), (c, "p", "c"))
    ]
    met = nearest.possible_meetings(*sides, ["g"], nearest.SPHERE, 3000.0 / EARTH_RADIUS_M)
    assert met.count() < 10_000 * 200
    check(spark, tuple(v[:300] for v in q), c)


def test_crowds_at_one_place(spark):
    """A third of all rows at one place, on both sides."""
    rnd = np.random.default_rng(3)
    at = lambda n: tuple(np.concatenate([np.full(n, m), m + rnd.random(2 * n) * 0.2]) for m in (22.3, 114.1))
    q, c = at(2000), at(1500)
    got = nearest.nearest_join(table(spark, *q, "k"), table(spark, *c, "p"), [], ["k"], ["p"]).toPandas().set_index("k")
    assert len(got) == 6000 and set(got.p[:2000]) == {0} and (got.distance_m[:2000] == 0).all()
    for k in range(2000, 6000, 40):
        assert abs(got.distance_m[k] - metres(q[0][k], q[1][k], *c).min()) < 1e-3


def test_odd_rows(spark):
    schema = "g int, k int, lat double, lng double"
    q = spark.createDataFrame([(1, 1, 22.0, 114.0), (1, 1, 22.5, 114.0), (1, 2, None, 114.0), (2, 3, 22.0, 114.0), (1, 4, float("nan"), 114.0), (None, 5, 22.0, 114.0)], schema)
    c = spark.createDataFrame([(1, 9, 22.0, 114.1), (1, 7, 22.0, 113.9), (1, 8, 22.0, 114.1), (1, 0, 22.0, None)], schema)
    got = nearest.nearest_join(q, c.withColumnRenamed("k", "p"), ["g"], ["k"], ["p"]).collect()
    assert [(r.g, r.k, r.p) for r in got] == [(1, 1, 7)]  # repeated key: the nearer row; equal distances: smaller payload
    for group in ([], ["g"]):
        empty = nearest.nearest_join(q, c.limit(0).withColumnRenamed("k", "p"), group, ["k"], ["p"])
        assert empty.count() == 0 and empty.columns == [*group, "k", "distance_m", "p"]
        assert nearest.nearest_join(q.limit(0), c, group, ["k"]).count() == 0


def test_close_places_are_whole_up_to_the_last(spark):
    """A dense spot, a loose one and a lone place: what is listed has nothing nearer left out."""
    rnd = np.random.default_rng(5)
    lat = np.concatenate([22.3 + rnd.random(200) * 0.01, 22.5 + rnd.random(60) * 0.5, [40.0]])
    lng = np.concatenate([114.1 + rnd.random(200) * 0.01, 114.3 + rnd.random(60) * 0.5, [-179.9]])
    places = materialize(table(spark, lat, lng, "place").drop("g"))
    got = nearest.close_places(places).toPandas()
    by = {p: g.sort_values("distance_m") for p, g in got.groupby("place")}
    assert len(got) > 1000 and 260 not in by and max(len(g) for g in by.values()) == 12
    for p, g in by.items():
        d = metres(lat[p], lng[p], lat, lng)
        nearer = np.sort(np.delete(d, p))[: len(g)]
        assert np.abs(nearer - g.distance_m.to_numpy()).max() < 1e-3


def test_close_places_sends_no_exploded_table_through_the_driver(spark):
    """Where what is exploded seems small, Spark would broadcast it: 27 rows for each place and level."""
    rnd = np.random.default_rng(6)
    places = materialize(table(spark, 22.3 + rnd.random(50) * 0.1, 114.1 + rnd.random(50) * 0.1, "place").drop("g"))
    found = nearest.close_places(places)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
        summed = None  # depth of an aggregate: what lies below is no longer as many rows
        for x, d in zip(lines[i + 1 :], depth[i + 1 :]):
            if d <= depth[i]:
                break
            if summed is None or d <= summed:
                summed = d if "Aggregate" in x else None
                assert "Generate" not in x, lines[i:]
    assert sum("Generate" in x for x in lines) >= 2 and found.count() > 0
