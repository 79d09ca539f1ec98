"""Filters, dedupe and clustering of reports into events."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.functions.geo import grid_cell
from zonecast.scale import component_labels
from zonecast.session import materialize

# lat_min, lat_max, lng_min, lng_max.
REPORT_BOX = (22.15, 22.56, 113.83, 114.41)
MODEL_BOX = (22.0, 22.7, 113.7, 114.6)
DASHBOARD_BOX = (22.1, 22.6, 113.8, 114.5)
COVERAGE_BOX = (22.15, 22.58, 113.82, 114.45)

JOIN_RADIUS_M = 20.0
JOIN_MINUTES = 15


def in_bbox(df: DataFrame, box: Sequence[float] = MODEL_BOX, inclusive: bool = True) -> DataFrame:
    lat, lng = F.col("lat"), F.col("lng")
    if inclusive:
        return df.filter(lat.between(box[0], box[1]) & lng.between(box[2], box[3]))
    return df.filter((lat > box[0]) & (lat < box[1]) & (lng > box[2]) & (lng < box[3]))


def valid_reports(df: DataFrame, box: Sequence[float] = REPORT_BOX) -> DataFrame:
    """Non-zero coordinates inside the box, without reports that were only voted down."""
    kept = in_bbox(df.filter("lat <> 0 AND lng <> 0"), box)
    return kept.filter("NOT (upvote = 0 AND downvote >= 3)").orderBy("create_dt", "report_id")


def dedupe_keep_first(df: DataFrame, key: str = "report_id", tie: Sequence[str] = ()) -> DataFrame:
    """First row per id by ``seen_at`` (then ``tie``).

    A partial ``min_by`` folds copies before the shuffle, so an id repeated across
    a large part of the table sends one row per task.
    """
    others = [c for c in df.columns if c != key]
    order = F.struct("seen_at", *tie)
    return df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")

# The fields of a report that later copies refresh, as far as a table has them.
REFRESHED = ("upvote", "downvote", "lastupdate_dt", "user_up", "user_down")


def refresh_aggregates(
    df: DataFrame, key: str = "report_id", mutable: Sequence[str] = REFRESHED, tie: Sequence[str] = ()
) -> list[Column]:
    """Mergeable state of an id's copies: first record, last value of each mutable field, span.

    A copy without a value leaves the field as it was: null, an empty text, and for
    numbers 0. The text "0" is a value, so cast votes that come as text afterwards.
    """
    mutable = [c for c in mutable if c in df.columns]
    fixed = [c for c in df.columns if c not in (key, *mutable)]
    order = F.struct("seen_at", *tie)
    nothing = {c: F.lit("" if t == "string" else 0) for c, t in df.dtypes if t == "string" or t in NUMBERS}
    truthy = lambda c: F.col(c).isNotNull() & (F.col(c) != nothing[c] if c in nothing else F.lit(True))
    start = lambda c: F.struct(
        order.alias("o"), (F.coalesce(F.col(c), nothing[c]) if c in nothing else F.col(c)).alias("v")
    )
    return [
        F.min(F.struct(order.alias("o"), F.struct(*fixed).alias("v"))).alias("first_row"),
        *[F.max(F.when(truthy(c), F.struct(order.alias("o"), F.col(c).alias("v")))).alias(f"last_{c}") for c in mutable],
        *[F.min(start(c)).alias(f"start_{c}") for c in mutable],
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    ]


def refresh_partials(
    df: DataFrame, key: str = "report_id", mutable: Sequence[str] = REFRESHED, tie: Sequence[str] = ()
) -> DataFrame:
    """The states of :func:`refresh_aggregates` for every id of a table."""
    return df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(*refresh_aggregates(df, key, mutable, tie))


def combine_partials(
    partials: DataFrame, key: str = "report_id", mutable: Sequence[str] = REFRESHED
) -> DataFrame:
    """Fold any number of partial states into one per id."""
    mutable = [c for c in mutable if f"last_{c}" in partials.columns]
    return partials.groupBy(key).agg(
        F.min("first_row").alias("first_row"),
        *[F.max(f"last_{c}").alias(f"last_{c}") for c in mutable],
        *[F.min(f"start_{c}").alias(f"start_{c}") for c in mutable],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def merge_partials(
    partials: DataFrame, key: str = "report_id", mutable: Sequence[str] = REFRESHED
) -> DataFrame:
    """Fold any number of partial states into one row per id."""
    mutable = [c for c in mutable if f"last_{c}" in partials.columns]
    return (
        combine_partials(partials, key, mutable)
        .select(
            key,
            F.col("first_row.v.*"),
            *[F.coalesce(f"last_{c}.v", f"start_{c}.v").alias(c) for c in mutable],
            "first_seen",
            "last_seen",
        )
        .drop("seen_at")
    )


def dedupe_refresh(
    df: DataFrame, key: str = "report_id", mutable: Sequence[str] = REFRESHED, tie: Sequence[str] = ()
) -> DataFrame:
    """Fixed fields of the first copy, last values of the others, first and last sighting."""
    return merge_partials(refresh_partials(df, key, mutable, tie), key, mutable)


def new_per_batch(df: DataFrame, key: str = "report_id", batch: str = "seen_at") -> DataFrame:
    """How many ids appear for the first time in each ingest batch."""
    firsts = (
        df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(batch).alias(batch))
    )
    return firsts.groupBy(batch).agg(F.count(F.lit(1)).alias("new_reports"))


# --- clustering -----------------------------------------------------------------

_STEP_DEG = 0.00025  # side of a micro cell; two points in one cell are under 41 m apart
_REACH_M = 41.0
_CELL_DEG = 0.0002  # side of a cell of cluster centres; over 20 m from north to south
_BUCKET_US = JOIN_MINUTES * 60_000_000


def _micro(lat: Column, lng: Column) -> tuple[Column, Column]:
    return F.floor(lat / F.lit(_STEP_DEG)), F.floor(lng / F.lit(_STEP_DEG))


def _microseconds() -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("create_dt"))


def spot_rows(reports: DataFrame, also: Sequence[Column] = ()) -> DataFrame:
    """One row per (micro cell, 15-minute bucket) and ``also`` with its time span and its box."""
    i, j = _micro(F.col("lat"), F.col("lng"))
    return (
        reports.select(i.alias("i"), j.alias("j"), "lat", "lng", _microseconds().alias("us"), *also)
        .withColumn("b", F.floor(F.col("us") / F.lit(_BUCKET_US)))
        .groupBy("i", "j", "b", *also)
        .agg(
            F.min("us").alias("t0"),
            F.max("us").alias("t1"),
            F.count(F.lit(1)).alias("n"),
            F.min("lat").alias("y0"),
            F.max("lat").alias("y1"),
            F.min("lng").alias("x0"),
            F.max("lng").alias("x1"),
        )
    )


def spot_presence(reports: DataFrame) -> DataFrame:
    """The rows of :func:`spot_rows`, each with its run id.

    A run is an unbroken stretch of activity in one micro cell. Sessions are cut
    on the bucketed table, so a busy spot costs its number of buckets.
    """
    spots = spot_rows(reports)
    w = W.partitionBy("i", "j").orderBy("b")
    fresh = F.when(F.col("t0") - F.lag("t1").over(w) <= _BUCKET_US, None).otherwise(F.col("b"))
    marked = spots.withColumn("_start", fresh)
    return marked.withColumn(
        "run", F.concat_ws(":", "i", "j", F.last("_start", ignorenulls=True).over(w))
    ).drop("_start")


def link_runs(presence: DataFrame) -> DataFrame:
    """Pairs of runs that may hold two reports within 41 m and 15 minutes.

    Works on (cell, bucket) rows; each meets the cells in reach, which are more
    east and west the nearer it is to a pole, and is linked where the boxes of
    the reports come close enough. It never lists pairs of reports.
    """
    side = F.lit(_STEP_DEG * 111_000)
    north = F.least((F.abs("i") + 3) * F.lit(_STEP_DEG), F.lit(89.999))
    lng_reach = 1 + F.ceil(F.lit(_REACH_M) / (side * F.cos(F.radians(north)))).cast("int")
    steps = F.array(
        *[F.struct(F.lit(di).alias("di"), F.lit(db).alias("db")) for di in range(-2, 3) for db in (0, 1)]
    )
    moved = presence.withColumn("s", F.explode(steps)).withColumn("dj", F.explode(F.sequence(-lng_reach, lng_reach)))
    left = moved.filter("s.db = 1 OR s.di > 0 OR (s.di = 0 AND dj > 0)").select(
        F.col("run").alias("a"),
        *[F.col(c).alias(f"a_{c}") for c in ("t0", "t1", "y0", "y1", "x0", "x1")],
        (F.col("i") + F.col("s.di")).alias("i"),
        (F.col("j") + F.col("dj")).alias("j"),
        (F.col("b") + F.col("s.db")).alias("b"),
    ).hint("merge")  # Spark takes a table for no larger once it is exploded, and would send it whole through the driver
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(f"a_{c}1"), F.col(f"a_{c}0") - F.col(f"{c}1"))
    highest = F.least(F.greatest(F.abs("y0"), F.abs("y1"), F.abs("a_y0"), F.abs("a_y1")), F.lit(90.0))
    apart = F.hypot(gap("y") * 111_000, gap("x") * 111_000 * F.cos(F.radians(highest)))
    close = (F.col("t0") - F.col("a_t1") <= _BUCKET_US) & (F.col("a_t0") - F.col("t1") <= _BUCKET_US)
    return (
        left.join(presence, ["i", "j", "b"])
        .filter(close & (apart <= _REACH_M) & (F.col("a") != F.col("run")))
        .select(F.least("a", "run").alias("a"), F.greatest("a", "run").alias("b"))
        .distinct()
    )


def _place_reports(reports: DataFrame) -> DataFrame:
    """Attach the connected component of runs every report belongs to.

    A report can only join a cluster whose last member is under 40 m and 15
    minutes away, so clusters never cross components and greedy clustering inside
    each component equals greedy clustering of the whole table.
    """
    presence = materialize(spot_presence(reports))
    labels = component_labels(presence.select(F.col("run").alias("node")), link_runs(presence))
    # Stored tables are far smaller on disk than in memory, where all of these grow with the reports: none is to be broadcast.
    spots = presence.join(labels.hint("merge"), presence["run"] == labels["node"]).select("i", "j", "b", "label").hint("merge")
    i, j = _micro(F.col("lat"), F.col("lng"))
    return (
        reports.select("report_id", "lat", "lng", _microseconds().alias("us"), i.alias("i"), j.alias("j"))
        .withColumn("b", F.floor(F.col("us") / F.lit(_BUCKET_US)))
        .join(spots, ["i", "j", "b"])
        .select("label", "report_id", "lat", "lng", "us")
    )


def _metres(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = (
        math.sin(math.radians(lat2 - lat1) / 2) ** 2
        + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    )
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


class _OpenClusters:
    """First-fit state of one component: open clusters by last member, and by the cell of their centre."""

    def __init__(self) -> None:
        self.open: OrderedDict[int, list] = OrderedDict()
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.made = 0

    @staticmethod
    def _cell(c: list) -> tuple[int, int]:
        return math.floor(c[1] / c[3] / _CELL_DEG), math.floor(c[2] / c[3] / _CELL_DEG)

    def _move(self, number: int, old: tuple[int, int] | None, new: tuple[int, int] | None) -> None:
        if old == new:
            return
        if old is not None:
            self.cells[old].discard(number)
            if not self.cells[old]:
                del self.cells[old]
        if new is not None:
            self.cells.setdefault(new, set()).add(number)

    def _near(self, lat: float, lng: float) -> list[int]:
        """Open clusters whose centre may lie within the radius, oldest first."""
        i = math.floor(lat / _CELL_DEG)
        reach = 1.01 * JOIN_RADIUS_M / (111_000 * max(math.cos(math.radians(min(abs(lat) + 0.001, 90))), 1e-9))
        j0, j1 = math.floor((lng - reach) / _CELL_DEG), math.floor((lng + reach) / _CELL_DEG)
        if 3 * (j1 - j0 + 1) > len(self.open):
            return sorted(self.open)
        cells = (self.cells.get((i + di, j), ()) for di in (-1, 0, 1) for j in range(j0, j1 + 1))
        return sorted(n for members in cells for n in members)

    def owner(self, rid: str, lat: float, lng: float, now: int) -> str:
        """Cluster of the next report in time; reports come in order."""
        while self.open:
            number, c = next(iter(self.open.items()))
            if now - c[4] <= _BUCKET_US:
                break
            self._move(number, self._cell(c), None)
            del self.open[number]
        for number in self._near(lat, lng):
            c = self.open[number]
            if _metres(lat, lng, c[1] / c[3], c[2] / c[3]) <= JOIN_RADIUS_M:
                before = self._cell(c)
                c[1], c[2], c[3], c[4] = c[1] + lat, c[2] + lng, c[3] + 1, now
                self.open.move_to_end(number)
                self._move(number, before, self._cell(c))
                return c[0]
        c = [rid, lat, lng, 1, now]
        self.open[self.made] = c
        self._move(self.made, None, self._cell(c))
        self.made += 1
        return rid


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cluster id of every report of a partition sorted by (label, time, id); holds open clusters only."""
    label, state = None, _OpenClusters()
    for rows in batches:
        owners = []
        for part, rid, lat, lng, us in zip(rows["label"], rows["report_id"], rows["lat"], rows["lng"], rows["us"]):
            if part != label:
                label, state = part, _OpenClusters()
            owners.append(state.owner(rid, float(lat), float(lng), int(us)))
        yield pd.DataFrame({"report_id": rows["report_id"].to_numpy(), "cluster_id": owners, "label": rows["label"].to_numpy()})


def label_clusters(reports: DataFrame) -> DataFrame:
    """(report_id, cluster_id, label): clusters as in :func:`assign_clusters`, with the component that each belongs to."""
    placed = _place_reports(reports).repartition("label").sortWithinPartitions("label", "us", "report_id")
    return placed.mapInPandas(_fold, "report_id string, cluster_id string, label string")


def assign_clusters(reports: DataFrame) -> DataFrame:
    """(report_id, cluster_id): greedy first-fit clusters, named by their first report.

    Components are independent and read once each, in time order, in a stream. A
    component that never falls silent stays one stream by the rule itself.
    """
    return label_clusters(reports).select("report_id", "cluster_id")


def consolidate_events(reports: DataFrame) -> DataFrame:
    """Merge reports within 20 m and 15 minutes into events."""
    return merge_clusters(reports.join(assign_clusters(reports).hint("merge"), "report_id"))


def merge_clusters(members: DataFrame) -> DataFrame:
    """One event per ``cluster_id`` of its reports."""
    member = F.struct("create_dt", "report_id")
    merged = (
        members.groupBy("cluster_id")
        .agg(
            F.avg("lat").alias("lat"),
            F.avg("lng").alias("lng"),
            F.min_by("address", F.struct(-F.coalesce("upvote", F.lit(0)), member)).alias("address"),
            F.min("create_dt").alias("create_dt"),
            F.max("create_dt").alias("end_dt"),
            F.count(F.lit(1)).alias("report_count"),
            F.sum("upvote").alias("total_upvotes"),
            F.sum("downvote").alias("total_downvotes"),
        )
    )
    return merged.select(
        F.col("cluster_id").alias("event_id"),
        "lat",
        "lng",
        "address",
        "create_dt",
        "end_dt",
        (F.timestamp_diff("MICROSECOND", F.col("create_dt"), F.col("end_dt")) / F.lit(6e7)).alias(
            "duration_min"
        ),
        "report_count",
        "total_upvotes",
        "total_downvotes",
        grid_cell(F.col("lat"), F.col("lng")).alias("grid_cell"),
    )


def session_events(df: DataFrame, key: str = "grid_cell", gap_minutes: int = JOIN_MINUTES) -> DataFrame:
    """Sessions of one key: a new one starts after a silence longer than the gap.

    Reports are first folded into minute buckets, so the window over a busy key is
    bounded by minutes, not rows.
    """
    minute = F.date_trunc("minute", "create_dt").cast("timestamp_ntz")
    folded = df.groupBy(key, minute.alias("_m")).agg(
        F.min("create_dt").alias("_t0"),
        F.max("create_dt").alias("_t1"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("upvote").alias("_up"),
    )
    w = W.partitionBy(key).orderBy("_m")
    silent = F.timestamp_diff("MICROSECOND", F.lag("_t1").over(w), F.col("_t0"))
    marked = folded.withColumn(
        "_new", F.when(silent <= gap_minutes * 60_000_000, 0).otherwise(1)
    ).withColumn("session", F.sum("_new").over(w))
    return marked.groupBy(key, "session").agg(
        F.min("_t0").alias("start_dt"),
        F.max("_t1").alias("end_dt"),
        F.sum("_n").alias("report_count"),
        F.sum("_up").alias("total_upvotes"),
    )
