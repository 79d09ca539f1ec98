"""Order-dependent primitives that never put a whole table or group in one task.

Global ranks, running totals and exact quantiles are built from range partitions
plus a small table of per-partition offsets; ranks inside groups are built from
value histograms, so a group holding most of the rows only costs its number of
distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from zonecast.session import materialize

#: Links that one task connects by itself.
LINKS = 200_000
_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def _place(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Range-partition and sort, then record each row's (partition, position)."""
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    # The placement is read twice below, and range bounds come from a sample:
    # both reads must see the same partitions.
    return materialize(placed).withColumn("_block", F.shiftright("_slot", _SLOT_BITS))


def _block_offsets(blocks: DataFrame, group: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Turn per-(block, group) totals into the totals of all earlier blocks.

    ``blocks`` has one row per range partition and group it touches.
    """
    earlier = (
        W.partitionBy(*(group or [F.lit(0)]))
        .orderBy("_block")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return blocks.select(
        "_block",
        *group,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[c for c in blocks.columns if c.startswith("_first")],
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def _with_offsets(placed: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Attach the offsets of a row's block.

    Without groups there is one offset row per partition: they travel as one value and
    no row moves. With groups there may be many, so they are joined.
    """
    if group:
        return _join_null_safe(placed, offsets, ["_block", *group])
    names = [c for c in offsets.columns if c != "_block"]
    entries = F.collect_list(F.struct(F.col("_block").alias("k"), F.struct(*names).alias("v")))
    mine = F.element_at(offsets.agg(F.map_from_entries(entries).alias("m")).scalar(), F.col("_block"))
    return placed.withColumns({c: mine[c] for c in names})


def ordered_rank(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """``row_number`` over the whole table, or per group, for data of any size.

    ``order`` should end in a unique key so the result is deterministic.
    """
    group = list(group)
    placed = _place(df, [*[F.col(g) for g in group], *order])
    blocks = placed.groupBy("_block", *group).agg(
        F.count(F.lit(1)).alias("n"), F.min("_slot").alias("_first")
    )
    offsets = _block_offsets(blocks, group, {"n": "n"})
    return (
        _with_offsets(placed, offsets, group)
        .withColumn(name, (F.col("_before_n") + F.col("_slot") - F.col("_first") + 1).cast("bigint"))
        .drop("_slot", "_block", "_before_n", "_first")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, str],
    group: Sequence[str] = (),
) -> DataFrame:
    """Exclusive running sums (``out -> source column``) along ``order``.

    A row gets the totals of the rows strictly before it in its group.
    """
    group = list(group)
    placed = _place(df, [*[F.col(g) for g in group], *order])
    blocks = placed.groupBy("_block", *group).agg(
        *[F.sum(src).alias(out) for out, src in sums.items()]
    )
    offsets = _block_offsets(blocks, group, sums)
    inside = (
        W.partitionBy("_block", *group).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    )
    summed = placed.select(
        "*",
        *[
            F.coalesce(F.sum(src).over(inside), F.lit(0)).alias(f"_in_{out}")
            for out, src in sums.items()
        ],
    )
    joined = _with_offsets(summed, offsets, group)
    for out in sums:
        joined = joined.withColumn(out, F.col(f"_in_{out}") + F.col(f"_before_{out}"))
    drop = [f"_in_{o}" for o in sums] + [f"_before_{o}" for o in sums]
    return joined.drop("_slot", "_block", *drop)


def value_histogram(
    df: DataFrame, value: str, group: Sequence[str] = (), wide: bool = False
) -> DataFrame:
    """One row per (group, value): ``n`` equal, ``n_below`` and ``n_total`` rows.

    ``wide`` is for values with data-sized cardinality (float scores): the totals
    then come from range partitions instead of a window per group.
    """
    group = list(group)
    hist = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    if not wide and group:
        w = W.partitionBy(*group)
        below = w.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return hist.select(
            *group,
            value,
            "n",
            F.coalesce(F.sum("n").over(below), F.lit(0)).alias("n_below"),
            F.sum("n").over(w).alias("n_total"),
        )
    totals = running_totals(hist, [F.col(value)], {"n_below": "n"}, group)
    if not group:
        rows = totals.agg(F.sum("n").alias("n_total"))
        return totals.withColumn("n_total", rows.scalar())
    sizes = totals.groupBy(*group).agg(F.sum("n").alias("n_total"))
    return _join_null_safe(totals, sizes, group)


def group_ranks(
    df: DataFrame,
    value: str,
    group: Sequence[str],
    outputs: dict[str, str],
    wide: bool = False,
    among: DataFrame | None = None,
) -> DataFrame:
    """Attach tie-aware ranks of ``value`` inside ``group``.

    ``outputs`` maps a new column to one of ``min_desc`` (rank, ties take the
    best, largest first), ``max_pct`` (share of rows at or below) or ``avg_pct``
    (average rank over the group size) or ``avg`` (average rank). ``among`` holds the same
    rows where ``df`` is their join with more, so that the histogram need not repeat that join.
    """
    rows = df if among is None else among
    hist = value_histogram(rows.select(*group, F.col(value).alias("_q")), "_q", group, wide)
    average = F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)
    kinds = {
        "min_desc": (F.col("n_total") - F.col("n_below") - F.col("n") + 1).cast("double"),
        "max_pct": (F.col("n_below") + F.col("n")) / F.col("n_total"),
        "avg_pct": average / F.col("n_total"),
        "avg": average,
    }
    ranked = hist.select(
        *group, F.col("_q").alias(value), *[kinds[k].alias(out) for out, k in outputs.items()]
    )
    if not wide and group:
        # As many values as rows, at worst, and by its file a stored table seems far smaller than it is: no broadcast.
        ranked = ranked.hint("merge")
    return _join_null_safe(df, ranked, [*group, value])


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: dict[str, float],
    group: Sequence[str] = (),
    wide: bool = True,
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group, nulls ignored."""
    known = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("_q"))
    return histogram_quantiles(value_histogram(known, "_q", group, wide), "_q", quantiles, group)


def histogram_quantiles(
    hist: DataFrame, value: str, quantiles: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Interpolated quantiles from rows of (value, n, n_below, n_total) per group."""
    first, last = F.col("n_below"), F.col("n_below") + F.col("n") - 1
    outs = []
    for name, q in quantiles.items():
        pos = (F.col("n_total") - 1) * F.lit(float(q))
        low, high = F.floor(pos), F.ceil(pos)
        at = lambda p: F.max(F.when((first <= p) & (p <= last), F.col(value)))
        frac = F.max(pos - low)
        outs.append((at(low) + (at(high) - at(low)) * frac).cast("double").alias(name))
    return hist.groupBy(*group).agg(*outs)


def _connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node of at most ``LINKS`` links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (above := up.setdefault(x, x)) != x:
                up[x] = up[above]
                x = up[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        if up:
            olds = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(olds, kind), pa.array([top(x) for x in olds], kind)], ["node", "label"])

    kind = dict(links.dtypes)["a"]
    return links.coalesce(1).mapInArrow(run, f"node {kind}, label {kind}")


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: ``(node, label)`` with label = smallest node reached.

    Ends of ``edges`` are among ``nodes``; neither is broadcast. Up to ``LINKS`` edges are connected by one task. Beyond that, each round takes
    the smallest neighbouring label and then follows it one hop (pointer jumping), so long chains close in a
    logarithmic number of rounds.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b"))
    if edges.count() <= LINKS:
        named = nodes.select("node").distinct().join(_connected(edges).hint("merge"), "node", "left")
        return materialize(named.select("node", F.coalesce("label", "node").alias("label")))
    both = materialize(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .union(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .distinct()
    )
    labels = materialize(nodes.select("node", F.col("node").alias("label")).distinct())
    while True:
        offered = (
            both.join(labels.withColumnRenamed("node", "dst").hint("merge"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lowered = labels.join(offered.hint("merge"), "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("low")
        )
        hop = lowered.select(F.col("node").alias("low"), F.col("low").alias("far"))
        jumped = materialize(
            lowered.join(hop.hint("merge"), "low", "left").select(
                "node", F.least("low", "far").alias("label"), "old"
            )
        )
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
