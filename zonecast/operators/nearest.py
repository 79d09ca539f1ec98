"""Exact nearest-neighbour join inside groups by pruning pairs of grid cells.

Positions become points of the unit sphere, where straight-line distance orders pairs as distance on the ground does, so
that poles and the antimeridian need no care. Cells of queries and of candidates are refined together from a coarse level
to leaves, and on to finer cells where a leaf holds many candidates. A pair is kept while its smallest possible distance
does not exceed the best that is certain for the query cell. All steps are equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonecast.functions.geo import EARTH_RADIUS_M, haversine_m
from zonecast.session import materialize

_FOLD = 2  # a parent cell is 2**_FOLD children wide on every axis
_DEPTH = 12  # levels below the leaves
MOST_CANDIDATES = 24  # a leaf with more is divided if many queries meet it
_MOST_MEETINGS = 512
_ROUNDING = 1e-9  # of a distance, relative; covers the arithmetic of bounds and of the distance itself
SPHERE, PLANE = 3, 2  # number of axes


def on_sphere(lat: Column, lng: Column) -> list[Column]:
    """Coordinates on the unit sphere."""
    y, x = F.radians(lat), F.radians(lng)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def as_side(side: str, position: Sequence[Column]) -> list[Column]:
    """Position columns of queries (side q) or candidates (side c) for ``possible_meetings``."""
    return [p.alias(f"{side}{a}") for a, p in enumerate(position)]


def _index(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def _ids(side: str, axes: int, parent: bool = False) -> list[str]:
    return [f"{'p' if parent else ''}{side}i{a}" for a in range(axes)]


def _place(points: DataFrame, side: str, axes: int, width: float) -> DataFrame:
    return points.withColumns({f"{side}i{a}": _index(F.col(f"{side}{a}"), width) for a in range(axes)})


def _cells(points: DataFrame, group: Sequence[str], side: str, axes: int, width: float) -> DataFrame:
    """Cells of one level: index, index of the parent, box around what they hold, number of rows.

    Candidates may have a size: then ``c{axis}_low`` and ``c{axis}_high`` bound them. Where places come back in many groups,
    the stored points are far smaller on disk than in memory, so cells are not broadcast.
    """
    low = lambda a: f"{side}{a}_low" if f"{side}{a}_low" in points.columns else f"{side}{a}"
    high = lambda a: f"{side}{a}_high" if f"{side}{a}_high" in points.columns else f"{side}{a}"
    return (
        _place(points, side, axes, width)
        .groupBy(*group, *_ids(side, axes))
        .agg(
            *[F.min(low(a)).alias(f"{side}{a}_from") for a in range(axes)],
            *[F.max(high(a)).alias(f"{side}{a}_to") for a in range(axes)],
            F.count(F.lit(1)).alias(f"n{side}"),
        )
        .withColumns({f"p{i}": F.shiftright(i, _FOLD) for i in _ids(side, axes)})
        .hint("merge")
    )


def _bounds(axes: int) -> tuple[Column, Column]:
    """Smallest and largest distance between what two cells hold."""
    near = far = F.lit(0.0)
    for a in range(axes):
        ahead = F.col(f"c{a}_from") - F.col(f"q{a}_to")
        behind = F.col(f"q{a}_from") - F.col(f"c{a}_to")
        gap = F.greatest(F.lit(0.0), ahead, behind)
        reach = F.greatest(F.col(f"c{a}_to") - F.col(f"q{a}_from"), F.col(f"q{a}_to") - F.col(f"c{a}_from"))
        near, far = near + gap * gap, far + reach * reach
    return F.sqrt(near) * (1 - _ROUNDING), F.sqrt(far) * (1 + _ROUNDING) + F.lit(1e-12)


def _keep(met: DataFrame, group: Sequence[str], axes: int) -> DataFrame:
    """Pairs that can hold a nearest candidate; the parent's bound holds for its children, so most go before the window."""
    near, far = _bounds(axes)
    q, c = _ids("q", axes), _ids("c", axes)
    best = F.min("_far").over(W.partitionBy(*group, *q))
    return (
        met.select(*group, *q, *c, "nq", "nc", "_bound", near.alias("_near"), far.alias("_far"))
        .filter("_near <= _bound")
        .withColumn("_best", best)
        .filter("_near <= _best")
        .select(*group, *q, *c, "nq", "nc", "_best")
    )


def _start(queries: DataFrame, candidates: DataFrame, group: Sequence[str], axes: int, leaf: float) -> tuple[int, DataFrame | None]:
    """A level at which candidates have at most three cells on an axis, and all pairs of its cells."""
    bounds = [f(f"c{a}").alias(f"{k}{a}") for a in range(axes) for k, f in (("low", F.min), ("high", F.max))]
    e = candidates.agg(*bounds).first()
    if e["low0"] is None:
        return 0, None
    level = 0
    while max(e[f"high{a}"] - e[f"low{a}"] for a in range(axes)) > 2 * leaf * 2 ** (_FOLD * level):
        level += 1
    width = leaf * 2 ** (_FOLD * level)
    met = _cells(queries, group, "q", axes, width)
    for a, i in enumerate(_ids("c", axes)):
        span = F.sequence(_index(F.lit(e[f"low{a}"]), width), _index(F.lit(e[f"high{a}"]), width))
        met = met.withColumn(i, F.explode(span))
    met = met.join(_cells(candidates, group, "c", axes, width), [*group, *_ids("c", axes)])
    return level, met.withColumn("_bound", F.lit(float("inf")))


def _children(pairs: DataFrame, q: DataFrame, c: DataFrame, group: Sequence[str], axes: int, width: float) -> DataFrame:
    ids = [*_ids("q", axes), *_ids("c", axes)]
    parents = pairs.select(*group, *[F.col(i).alias(f"p{i}") for i in ids], F.col("_best").alias("_bound"))
    return parents.join(_cells(c, group, "c", axes, width), [*group, *_ids("c", axes, True)]).join(
        _cells(q, group, "q", axes, width), [*group, *_ids("q", axes, True)]
    )


def possible_meetings(
    queries: DataFrame, candidates: DataFrame, group: Sequence[str], axes: int, leaf: float
) -> DataFrame:
    """Queries next to the candidates that can be their nearest, all columns of both.

    Both are stored tables with ``group`` and positions named by ``as_side``; no position is null. No leaf with more than
    ``MOST_CANDIDATES`` meets many queries, unless its candidates share one place.
    """
    group = list(group)
    level, met = _start(queries, candidates, group, axes, leaf)
    if met is None:
        return queries.join(candidates.limit(0), group or F.lit(False))
    pairs = _keep(met, group, axes)
    for at in range(level - 1, -1, -1):
        pairs = _keep(_children(pairs, queries, candidates, group, axes, leaf * 2 ** (_FOLD * at)), group, axes)
    crowded = (F.col("nc") > MOST_CANDIDATES) & (F.col("nq") * F.col("nc") > _MOST_MEETINGS)
    q, c, out = queries, candidates, None
    for depth in range(_DEPTH + 1):
        width = leaf / 2 ** (_FOLD * depth)
        pairs = materialize(pairs)
        last = depth == _DEPTH or pairs.filter(crowded).isEmpty()
        ready = pairs if last else pairs.filter(~crowded)
        here = {s: _place(t, s, axes, width) for s, t in (("q", q), ("c", c))}
        rows = (
            ready.select(*group, *_ids("q", axes), *_ids("c", axes))
            .join(here["c"], [*group, *_ids("c", axes)])
            .join(here["q"], [*group, *_ids("q", axes)])
            .drop(*_ids("q", axes), *_ids("c", axes))
        )
        out = rows if out is None else out.unionByName(rows)
        if last:
            return out
        rest = pairs.filter(crowded)
        # Only what lies in crowded pairs goes on.
        q, c = (
            materialize(
                here[s].join(rest.select(*group, *_ids(s, axes)).distinct(), [*group, *_ids(s, axes)], "left_semi").drop(*_ids(s, axes))
            )
            for s in "qc"
        )
        pairs = _keep(_children(rest, q, c, group, axes, width / 2**_FOLD), group, axes)
    return out


def close_places(places: DataFrame, most: int = 12, block: int = 64, start_m: float = 250.0, levels: int = 12) -> DataFrame:
    """(place, near, distance_m): the nearest other places of each one, at most ``most``, complete up to the last one listed.

    ``places`` is a stored table (place, lat, lng) of different positions. Each place looks around in the largest of
    ``levels`` cell sizes whose cell and its neighbours hold at most ``block`` places, and no further than one cell, so its
    list may be short or empty beside a crowd; whoever finds nothing in the list has to search beyond it.
    """
    at = on_sphere(F.col("lat"), F.col("lng"))
    known = places.select("*", *as_side("q", at), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    width = F.lit(start_m / EARTH_RADIUS_M) * F.pow(F.lit(2.0), F.col("level"))
    cell = [f"i{a}" for a in range(SPHERE)]
    placed = materialize(known.withColumns({c: F.floor(F.col(f"q{a}") / width).cast("bigint") for a, c in enumerate(cell)}))
    steps = [F.struct(*[F.lit(d - 1).alias(f"d{a}") for a, d in enumerate(s)]) for s in product(range(3), repeat=SPHERE)]
    # Spark takes a table for no larger once it is exploded, and would send it whole through the driver: hence the hints.
    around = lambda df, *keep: df.withColumn("_s", F.explode(F.array(*steps))).select(
        *keep, "level", *[(F.col(c) + F.col(f"_s.d{a}")).alias(c) for a, c in enumerate(cell)]
    ).hint("merge")
    held = placed.groupBy("level", *cell).agg(F.count(F.lit(1)).alias("held"))
    # All places of a cell look around in the same cells, so these are counted once per cell.
    home = [f"h{a}" for a in range(SPHERE)]
    roomy = (
        around(held.select("level", *cell, *[F.col(c).alias(h) for c, h in zip(cell, home)]), *home)
        .join(held, ["level", *cell])
        .groupBy("level", *home)
        .agg(F.sum("held").alias("held"))
        .filter(F.col("held") <= block)
        .select("level", *[F.col(h).alias(c) for c, h in zip(cell, home)])
    )
    chosen = placed.join(roomy, ["level", *cell]).groupBy("place").agg(F.max("level").alias("level"))
    looking = placed.join(chosen, ["place", "level"])
    others = placed.select("level", *cell, F.col("place").alias("near"), F.col("lat").alias("_y"), F.col("lng").alias("_x"))
    d = haversine_m(F.col("lat"), F.col("lng"), F.col("_y"), F.col("_x"))
    reach = F.lit(start_m * (1 - 1e-6)) * F.pow(F.lit(2.0), F.col("level"))
    order = W.partitionBy("place").orderBy("distance_m", "near")  # at most ``block`` rows
    return (
        around(looking, "place", "lat", "lng")
        .join(others, ["level", *cell])
        .withColumn("distance_m", d)
        .filter((F.col("place") != F.col("near")) & (F.col("distance_m") <= reach))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= most)
        .select("place", "near", "distance_m")
    )


def nearest_join(
    queries: DataFrame,
    candidates: DataFrame,
    group: Sequence[str],
    key: Sequence[str],
    payload: Sequence[str] = (),
    leaf_m: float = 3000.0,
) -> DataFrame:
    """Nearest candidate of every query row that shares its ``group``.

    Both sides carry ``lat`` and ``lng``, anywhere on the globe. Returns group, key, ``distance_m`` and the payload of the
    nearest candidate (smallest payload on ties). A place is searched once, however many rows of one key or of several have
    it. Queries with a null or NaN position, or whose group has no candidate, are absent; so are candidates without a position.
    """
    group, key, payload = list(group), list(key), list(payload)
    placed = lambda df: df.dropna(subset=["lat", "lng"])
    best = F.min(F.struct(*payload)).alias("_p") if payload else F.first(F.lit(1)).alias("_p")
    here, there = (on_sphere(F.col(f"{s}lat"), F.col(f"{s}lng")) for s in "qc")
    named = lambda s: {"lat": f"{s}lat", "lng": f"{s}lng"}
    asked = placed(queries).select(*group, *key, F.col("lat").alias("qlat"), F.col("lng").alias("qlng"))
    q = materialize(asked.select(*group, "qlat", "qlng").distinct().select("*", *as_side("q", here)))
    c = materialize(
        placed(candidates).groupBy(*group, "lat", "lng").agg(best).withColumnsRenamed(named("c")).select("*", *as_side("c", there))
    )
    d = haversine_m(F.col("qlat"), F.col("qlng"), F.col("clat"), F.col("clng"))
    met = possible_meetings(q, c, group, SPHERE, leaf_m / EARTH_RADIUS_M)
    found = met.groupBy(*group, "qlat", "qlng").agg(F.min(F.struct(d.alias("d"), "_p")).alias("_b"))
    return asked.join(found, [*group, "qlat", "qlng"]).groupBy(*group, *key).agg(F.min("_b").alias("_b")).select(
        *group, *key, F.col("_b.d").alias("distance_m"), *[F.col(f"_b._p.{p}").alias(p) for p in payload]
    )
