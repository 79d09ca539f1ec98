"""Polygons as grid cells, for joins with points.

An outline cuts each row of cells into border cells and the runs between them. A border cell holds the edges that touch
it, and whether its reference point is inside; runs that lie wholly inside are stored as aligned blocks of 4**k cells and
hold no edge. A border cell with many edges is divided four by four, again and again where the outline is dense, so an
outline of any length becomes cells of few edges. Edges travel one by one until a cell is known to hold few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonecast.functions import geo
from zonecast.session import materialize

MOST_EDGES = 32  # a border cell with more is divided
_DEPTH = 7  # divisions; cells of the last one are about a micro-degree wide
_BLOCKS = 9  # runs are stored as blocks of 1, 4, ... 4**8 cells
_PAD = 1e-9  # an edge counts for every cell that it passes within this distance
# Grid lines and reference lines are moved off round coordinates, so that no outline runs along them.
_SHIFT, _LINE = 0.0012345678912345, 0.4871236789

_EDGE = ("x1", "y1", "x2", "y2")
_POLYGON = ("poly_id", "district", "region")


def _index(value: Column, width: float) -> Column:
    return F.floor((value - F.lit(_SHIFT)) / F.lit(width)).cast("bigint")


def _border(index: Column, width: float) -> Column:
    return index * F.lit(width) + F.lit(_SHIFT)


def _line(index: Column, width: float) -> Column:
    """Height of a row's reference points, which lie on the left borders of its cells."""
    return (index + F.lit(_LINE)) * F.lit(width) + F.lit(_SHIFT)


def _left(e, x: Column, y: Column) -> Column:
    """Whether a point lies to the left of an edge."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) > 0


def _met_upwards(e, x: Column, y: Column, to: Column) -> Column:
    """Whether a vertical step at ``x`` from ``y`` to ``to`` crosses an edge."""
    return ((e["x1"] > x) != (e["x2"] > x)) & (_left(e, x, y) != _left(e, x, to))


def _met_sideways(e, x: Column, y: Column, to: Column) -> Column:
    return ((e["y1"] > y) != (e["y2"] > y)) & (_left(e, x, y) != _left(e, to, y))


def _columns_of_edge() -> dict[str, Column]:
    return {c: F.col(c) for c in _EDGE}


def _cut(edges: DataFrame, width: float) -> DataFrame:
    """One row per edge and cell that it touches; ``met`` is 1 in the cell where it crosses the row's reference line.

    Edges of a parent cell (``pi``, ``pj``) are cut by its children only.
    """
    inside = lambda low, high, parent: F.sequence(
        F.greatest(low, F.coalesce(parent * 4, low)), F.least(high, F.coalesce(parent * 4 + 3, high))
    )
    low, high = _index(F.least("y1", "y2") - _PAD, width), _index(F.greatest("y1", "y2") + _PAD, width)
    meets = F.col("pi").isNull() | ((low <= F.col("pi") * 4 + 3) & (high >= F.col("pi") * 4))
    rows = edges.filter(meets).withColumn("i", F.explode(inside(low, high, F.col("pi"))))
    run, rise = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def at(y: Column) -> Column:
        x = F.col("x1") + (y - F.col("y1")) / F.nullif(rise, F.lit(0.0)) * run
        return F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), x))

    bottom = at(F.greatest(_border(F.col("i"), width) - _PAD, F.least("y1", "y2")))
    top = at(F.least(_border(F.col("i") + 1, width) + _PAD, F.greatest("y1", "y2")))
    flat = rise == 0
    rows = rows.withColumns(
        {
            "_a": _index(F.when(flat, F.least("x1", "x2")).otherwise(F.least(bottom, top)) - _PAD, width),
            "_b": _index(F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(bottom, top)) + _PAD, width),
            "_m": F.when(
                (F.col("y1") > _line(F.col("i"), width)) != (F.col("y2") > _line(F.col("i"), width)),
                _index(at(_line(F.col("i"), width)), width),
            ),
        }
    )
    meets = F.col("pj").isNull() | ((F.col("_a") <= F.col("pj") * 4 + 3) & (F.col("_b") >= F.col("pj") * 4))
    return (
        rows.filter(meets)
        .withColumn("j", F.explode(inside(F.col("_a"), F.col("_b"), F.col("pj"))))
        .select(*_POLYGON, "pi", "pj", "i", "j", *_EDGE, F.coalesce((F.col("_m") == F.col("j")).cast("int"), F.lit(0)).alias("met"))
    )


def _starts(parents: DataFrame, width: float) -> DataFrame:
    """Crossings on the way from a parent's reference point up or down its left border to those of its rows of children."""
    rows = parents.withColumn("i", F.explode(F.sequence(F.col("pi") * 4, F.col("pi") * 4 + 3)))
    up = _met_upwards(
        _columns_of_edge(), _border(F.col("pj"), width * 4), _line(F.col("pi"), width * 4), _line(F.col("i"), width)
    )
    return rows.groupBy(*_POLYGON, "pi", "pj", "i").agg(
        (F.first("odd") + F.count(F.when(up, 1))).alias("crossed")
    ).select(*_POLYGON, "pi", "pj", "i", (F.col("pj") * 4 - 1).alias("j"), F.lit(0).cast("bigint").alias("n"), "crossed")


def _with_parity(cells: DataFrame) -> DataFrame:
    """``odd``: whether a cell's reference point is inside; ``until``: the next cell in its row that the outline touches."""
    row = W.partitionBy(*_POLYGON, "i", "pj").orderBy("j")
    before = F.coalesce(F.sum("crossed").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumns(
        {"odd": before % 2, "until": F.coalesce(F.lead("j").over(row), F.col("pj") * 4 + 4)}
    )


def _blocks(first: Column, last: Column) -> Column:
    """The fewest aligned blocks of 4**k cells that make up the run."""
    full = lambda k: (F.ceil(first / F.lit(4**k)), F.floor((last + 1) / F.lit(4**k)) - 1)
    out = []
    for k in range(_BLOCKS):
        (a, b), (c, d) = full(k), full(k + 1)
        larger = (c <= d) if k + 1 < _BLOCKS else F.lit(False)
        left = F.filter(F.sequence(a, a + 6), lambda j: (j <= b) & (~larger | (j < c * 4)))  # noqa: B023
        right = F.filter(F.sequence(b - 6, b), lambda j: (j >= a) & larger & (j > d * 4 + 3))  # noqa: B023
        # Without larger blocks around them there are at most six; the last size has no larger one and is listed whole.
        if k + 1 == _BLOCKS:
            left = F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))
        tag = F.lit(k)
        out.append(F.transform(F.concat(left, right), lambda j: F.struct(tag.alias("tag"), j.alias("j"))))  # noqa: B023
    return F.concat(*out)


def polygon_cover(edges: DataFrame, width: float = 0.02) -> DataFrame:
    """Edge rows of polygons to cells (poly_id, district, region, tag, i, j, odd, edges).

    ``tag`` is k for a block of 4**k cells of the row, -d for a cell after d divisions. ``edges`` is null where the cell is
    wholly inside; otherwise it holds the edges that touch the cell, in no order. Edges with a null coordinate are left
    out; repeated edges count each time; no edges give no cells.
    """
    none = F.lit(None).cast("bigint")
    left = edges.dropna(subset=list(_EDGE)).select(*_POLYGON, *_EDGE, none.alias("pi"), none.alias("pj"))
    cover = None
    for depth in range(_DEPTH + 1):
        w = width / 4**depth
        rows = materialize(_cut(left, w))
        cells = rows.groupBy(*_POLYGON, "pi", "pj", "i", "j").agg(
            F.count(F.lit(1)).alias("n"), F.sum("met").alias("crossed")
        )
        if depth:
            cells = cells.unionByName(_starts(left, w))
        cells = materialize(_with_parity(cells))
        full = F.col("n") > (MOST_EDGES if depth < _DEPTH else 2**62)
        few = cells.filter(~full & (F.col("n") > 0)).select(*_POLYGON, "i", "j", "odd")
        border = (
            rows.join(few, [*_POLYGON, "i", "j"])
            .groupBy(*_POLYGON, F.lit(-depth).alias("tag"), "i", "j", "odd")
            .agg(F.collect_list(F.struct(*_EDGE)).alias("edges"))
        )
        inside = cells.filter(((F.col("odd") + F.col("crossed")) % 2 == 1) & (F.col("until") > F.col("j") + 1))
        first, last = F.col("j") + 1, F.col("until") - 1
        pieces = (
            F.transform(F.sequence(first, last), lambda j: F.struct(F.lit(-depth).alias("tag"), j.alias("j")))  # noqa: B023
            if depth
            else _blocks(first, last)
        )
        runs = inside.select(*_POLYGON, "i", F.explode(pieces).alias("_b")).select(*_POLYGON, "_b.tag", "i", "_b.j")
        found = border.unionByName(runs, allowMissingColumns=True)
        cover = found if cover is None else cover.unionByName(found)
        crowded = cells.filter(full).select(*_POLYGON, "i", "j", "odd")
        if crowded.isEmpty():
            break
        left = rows.drop("pi", "pj", "met").join(crowded, [*_POLYGON, "i", "j"]).withColumnsRenamed({"i": "pi", "j": "pj"})
    return materialize(cover)


def _covers(x: Column, y: Column, width: Column) -> Column:
    """Parity on the way from the cell's reference point up its left border and across; a point on an edge is inside."""
    left, line = _border(F.col("j"), width), (F.col("i") + F.lit(_LINE)) * width + F.lit(_SHIFT)
    crossed = F.size(F.filter("edges", lambda e: _met_upwards(e, left, line, y))) + F.size(
        F.filter("edges", lambda e: _met_sideways(e, left, y, x))
    )
    touches = F.exists(
        "edges", lambda e: geo.segment_distance_deg(x, y, e["x1"], e["y1"], e["x2"], e["y2"]) <= 1e-12
    )
    return F.col("edges").isNull() | touches | ((F.col("odd") + crossed) % 2 == 1)


def covering_polygon(df: DataFrame, key: str, edges: DataFrame, width: float = 0.02) -> DataFrame:
    """(key, poly_id, district, region) of the first polygon that covers each point; points outside all are absent.

    A point asks once for each size of cell that the cover has, at most 17 times.
    """
    cover = polygon_cover(edges, width)
    tags = sorted(r.tag for r in cover.select("tag").distinct().collect())  # at most one per size of cell
    y, x = F.col("lat"), F.col("lng")
    asks = [
        F.struct(
            F.lit(t).alias("tag"),
            _index(y, width / 4 ** max(0, -t)).alias("i"),
            F.shiftright(_index(x, width / 4 ** max(0, -t)), 2 * max(0, t)).alias("j"),
        )
        for t in tags
    ]
    if not asks:
        return df.select(key, *[F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in _POLYGON]).limit(0)
    points = df.dropna(subset=["lat", "lng"]).select(key, "lat", "lng", F.explode(F.array(*asks)).alias("_a")).select(key, "lat", "lng", "_a.*")
    size = F.lit(width) / F.pow(F.lit(4.0), F.greatest(F.lit(0), -F.col("tag")))
    return (
        points.join(cover, ["tag", "i", "j"])
        .filter(_covers(x, y, size))
        .repartition(key)  # else each task that reads points sorts all its rows for a partial minimum
        .groupBy(key)
        .agg(F.min(F.struct(*_POLYGON)).alias("_p"))
        .select(key, "_p.*")
    )
