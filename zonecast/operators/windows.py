"""Trailing counts over hour buckets.

Events are first reduced to one row per (key, hour). Densifying expands each of
those rows up to the key's next active hour, after the shuffle on the key, so the
dense table is never moved; trailing sums are differences of running totals, so
their cost does not depend on the window length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.functions.timecols import floor_hour, hours
from zonecast.session import materialize


def partitions(df: DataFrame) -> int:
    """Session shuffle width, used where a small input is about to be expanded.

    Adaptive execution would size such a shuffle by its small input.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hour_table(events: DataFrame, keys: Sequence[str], horizon_minutes: int = 60, *extra: Column) -> DataFrame:
    """One row per (keys, hour): ``cnt``, ``early`` and any further aggregates.

    This is the only pass over raw events; it is stored, and every trailing count,
    label and distinct count derives from it. ``early`` counts the events in the
    part of the hour a horizon that is not a whole number of hours reaches.
    """
    part = F.timestamp_diff("MICROSECOND", floor_hour(F.col("ts")), F.col("ts")) < F.lit(
        horizon_minutes % 60 * 60_000_000
    )
    return materialize(
        events.groupBy(*keys, floor_hour(F.col("ts")).alias("hour")).agg(
            F.count(F.lit(1)).alias("cnt"), F.count(F.when(part, 1)).alias("early"), *extra
        )
    )


def axis_bounds(hourly: DataFrame) -> tuple[Column, Column]:
    """First and last hour of an hour table, as scalar subqueries."""
    one = hourly.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    return one.select("lo").scalar(), one.select("hi").scalar()


def hour_gap(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("HOUR", earlier, later)


def densify(
    sparse: DataFrame,
    key: Sequence[str],
    lo: Column,
    hi: Column,
    here: Sequence[str] = (),
    totals: dict[str, str] | None = None,
    levels: dict[str, str] | None = None,
    latest: dict[str, str] | None = None,
) -> DataFrame:
    """Every hour from ``lo`` to ``hi`` for every key of a sparse hour table.

    ``here`` columns keep the hour's own value and are 0 in gaps. ``totals`` are
    running sums of the hours before, ``levels`` running sums up to and including
    the hour, ``latest`` the largest value of the hours before. Running values are
    computed on the sparse rows and carried across the gaps they span, so the
    dense rows only ever need ``lag``.
    """
    w = W.partitionBy(*key).orderBy("hour")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0)
    spans = sparse.select(
        *key,
        "hour",
        *here,
        F.when(F.row_number().over(w) == 1, lo).otherwise(F.col("hour")).alias("_from"),
        (F.coalesce(F.lead("hour").over(w), hi + hours(1)) - hours(1)).alias("_to"),
        *[F.coalesce(F.sum(src).over(past), zero).alias(f"_b_{out}") for out, src in (totals or {}).items()],
        *[F.sum(src).over(upto).alias(f"_a_{out}") for out, src in (totals or {}).items()],
        *[F.sum(src).over(upto).alias(f"_a_{out}") for out, src in (levels or {}).items()],
        *[F.max(src).over(past).alias(f"_b_{out}") for out, src in (latest or {}).items()],
        *[F.max(src).over(upto).alias(f"_a_{out}") for out, src in (latest or {}).items()],
    )
    filled = spans.withColumn("_t", F.explode(F.sequence("_from", "_to", hours(1))))
    t, hour = F.col("_t"), F.col("hour")
    return filled.select(
        *key,
        *[F.when(t == hour, F.col(c)).otherwise(zero).cast("bigint").alias(c) for c in here],
        *[
            F.when(t > hour, F.col(f"_a_{out}")).when(t == hour, F.col(f"_b_{out}")).otherwise(zero).alias(out)
            for out in (totals or {})
        ],
        *[F.when(t >= hour, F.col(f"_a_{out}")).otherwise(zero).alias(out) for out in (levels or {})],
        *[
            F.when(t > hour, F.col(f"_a_{out}")).when(t == hour, F.col(f"_b_{out}")).alias(out)
            for out in (latest or {})
        ],
        t.alias("hour"),
    )


def before(key: Sequence[str], order: str = "hour"):
    """All earlier rows of the key, the current hour excluded."""
    return W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def trailing(total: str, n_hours: int, key: Sequence[str], order: str = "hour") -> Column:
    """Sum over the ``n_hours`` before the row, from an exclusive running sum."""
    w = W.partitionBy(*key).orderBy(order)
    return F.col(total) - F.coalesce(F.lag(total, n_hours).over(w), F.lit(0))


def same_hour_sum(count: str, days: int, key: Sequence[str], order: str = "hour") -> Column:
    """Sum of ``count`` at this hour of day over the ``days`` days before the row."""
    w = W.partitionBy(*key).orderBy(order)
    total = F.lit(0)
    for d in range(1, days + 1):
        total = total + F.coalesce(F.lag(count, 24 * d).over(w), F.lit(0))
    return total


def label_rows(hourly: DataFrame, key: Sequence[str], horizon_minutes: int) -> DataFrame:
    """(key, hour, fut): how many events fall in ``[hour, hour + horizon)``.

    Each active hour is sent to the few hourly targets it labels.
    """
    whole, rest = divmod(horizon_minutes, 60)
    steps = [F.struct((F.col("hour") - hours(k)).alias("hour"), F.col("cnt").alias("fut")) for k in range(whole)]
    if rest:
        steps.append(F.struct((F.col("hour") - hours(whole)).alias("hour"), F.col("early").alias("fut")))
    return (
        hourly.select(*key, F.explode(F.array(*steps)).alias("_l"))
        .groupBy(*key, "_l.hour")
        .agg(F.sum("_l.fut").alias("fut"))
    )


def coverage_deltas(active: DataFrame, member: Sequence[str], span: int = 24) -> DataFrame:
    """Start/stop steps of "member was active in the last ``span`` hours".

    ``active`` has unique (member, hour) rows. Summing the steps along the hours
    of a group counts its distinct active members without repeating any row per
    target hour.
    """
    w = W.partitionBy(*member).orderBy("hour")
    edges = active.select(
        *member,
        "hour",
        hour_gap(F.col("hour"), F.lag("hour").over(w)).alias("_back"),
        hour_gap(F.lead("hour").over(w), F.col("hour")).alias("_ahead"),
    )
    starts = F.when(
        F.col("_back").isNull() | (F.col("_back") > span),
        F.struct((F.col("hour") + hours(1)).alias("hour"), F.lit(1).alias("step")),
    )
    stops = F.when(
        F.col("_ahead").isNull() | (F.col("_ahead") > span),
        F.struct((F.col("hour") + hours(span + 1)).alias("hour"), F.lit(-1).alias("step")),
    )
    return edges.select(
        *member, F.explode(F.array_compact(F.array(starts, stops))).alias("_e")
    ).select(*member, "_e.hour", "_e.step")


def distinct_active(
    hourly: DataFrame, group: Sequence[str], member: Sequence[str], span: int = 24
) -> DataFrame:
    """(group, hour, step): steps of the number of distinct members active per group."""
    active = hourly.select(*group, *member, "hour").distinct()
    return (
        coverage_deltas(active, [*group, *member], span)
        .groupBy(*group, "hour")
        .agg(F.sum("step").alias("step"))
    )


def merge_sparse(
    parts: Sequence[DataFrame], key: Sequence[str], sums: Sequence[str], lo: Column, hi: Column,
    latest: str | None = None,
) -> DataFrame:
    """Stack sparse hour tables and add up their columns per (key, hour) within the axis.

    Placed by key alone, so densifying and all windows per key follow without
    another shuffle.
    """
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    aggs = [F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums]
    if latest:
        aggs.append(F.max(latest).alias(latest))
    return (
        merged.filter((F.col("hour") >= lo) & (F.col("hour") <= hi))
        .repartition(partitions(merged), *key)
        .groupBy(*key, "hour")
        .agg(*aggs)
    )
