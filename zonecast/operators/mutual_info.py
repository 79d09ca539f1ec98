"""Mutual information of single features with a discrete label by nearest neighbours, without binning.

For each row, the distance to its k-th neighbour of the same label is a radius; the more rows of any label lie within it, the
less the feature tells of the label (Ross, 2014). Along one feature neighbours are found in sorted order: rows are dealt
to blocks of the order, each block sees the k nearest rows of every label beyond its borders, and what reaches beyond a
block is counted by ranks in the block it falls into.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.operators.diagnose import feature_medians
from zonecast.session import materialize

#: The neighbour itself lies just outside of the radius.
WITHIN = 1 - 2.0**-40
#: Groups that the bounds falling into one block are dealt to.
SALTS = 64


def digamma(m: Column) -> Column:
    """Of a positive number, to about 1e-11: eight steps up, then the asymptotic series."""
    z = m + F.lit(8.0)
    steps = sum((F.lit(1.0) / (m + F.lit(float(j))) for j in range(8)), F.lit(0.0))
    s = F.lit(1.0) / (z * z)
    return F.ln(z) - F.lit(0.5) / z - s * (F.lit(1 / 12) - s * (F.lit(1 / 120) - s * F.lit(1 / 252))) - steps


def _digamma(m: np.ndarray) -> np.ndarray:
    z = m + 8.0
    s = 1 / (z * z)
    return np.log(z) - 0.5 / z - s * (1 / 12 - s * (1 / 120 - s / 252)) - sum(1 / (m + float(j)) for j in range(8))


def spread_ties(x: Column, feature: Column, mean_size: Column, keys: Sequence[str]) -> Column:
    """Values moved by less than one part in 2**32 of the feature's size, by a checksum of the row's keys.

    Equal values get an order that is random but the same in every run; without one, counts would have no radius.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", feature, *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("double")
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), mean_size))) - F.lit(33.0))
    return x + (draw / F.lit(2.0**31) - F.lit(1.0)) * size


def _long(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """(feature, x, y): nulls take the median, ties are spread. The median and size of each feature travel as one value."""
    known = df.filter(F.col(target).isNotNull())
    medians = feature_medians(known, features, target)
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))).alias(c) for c in features]
    rows = known.select(*[k for k in keys if k not in features], *filled, F.col(target).cast("int").alias("_y"))
    sizes = rows.agg(*[F.avg(F.abs(c)).alias(c) for c in features]).first()
    value = lambda c: F.struct(
        F.lit(c).alias("feature"), spread_ties(F.col(c), F.lit(c), F.lit(sizes[c] or 0.0), keys).alias("x")
    )
    return rows.select(F.explode(F.array(*map(value, features))).alias("v"), F.col("_y").alias("y")).select("v.feature", "v.x", "y").filter("x IS NOT NULL")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows with ``x`` and ``y`` as arrays."""
    for i in range(batch.num_rows):
        yield {
            c: batch.column(c)[i].values.to_numpy() if c in ("x", "y") else batch.column(c)[i].as_py() for c in batch.schema.names
        }


def _radii(v: np.ndarray, k: int) -> np.ndarray:
    """Distance of each of the sorted values to the k-th nearest other one."""
    n, wide = len(v), np.concatenate([np.full(k, -np.inf), v, np.full(k, np.inf)])
    best = np.full(n, np.inf)
    for a in range(k + 1):
        left, right = wide[k - a : k - a + n], wide[2 * k - a : 2 * k - a + n]
        best = np.minimum(best, np.maximum(v - left, right - v))
    return best


def nearest_mutual_info(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ("target_time", "zone_id"), k: int = 3, block_rows: int = 1 << 16
) -> DataFrame:
    """(feature, mutual_info) in nats, not below 0, with the ``k``-th nearest neighbour.

    Rows without a label are left out, as are labels with a single row; smaller labels use what neighbours they have. Null
    features take the median. ``keys`` identify a row. Features that are null throughout give no row. The cut points of
    blocks, some ``rows / block_rows`` numbers a feature, are the only thing that passes the driver.
    """
    long = materialize(_long(df, features, target, keys))
    counts = materialize(long.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    placed = long.join(counts.select("feature", "y"), ["feature", "y"], "left_semi").select("feature", "x", "y")
    most = counts.groupBy("feature").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = -(-most // block_rows)
    cuts = {f: np.empty(0) for f in features}
    if blocks > 1:
        shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
        at = F.percentile_approx("x", shares, max(10_000, 20 * blocks))
        # Cut points are values of rows, so that only the first block can be empty.
        cuts |= {r["feature"]: np.unique(r["c"]) for r in placed.groupBy("feature").agg(at.alias("c")).collect()}
    sent = df.sparkSession.sparkContext.broadcast(cuts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, x = batch.column("feature").dictionary_encode(), batch.column("x").to_numpy()
            codes, block = named.indices.to_numpy(), np.zeros(len(x), np.int64)
            for code, f in enumerate(named.dictionary.to_pylist()):
                block[codes == code] = np.searchsorted(sent.value[f], x[codes == code], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "block"])

    packed = materialize(
        placed.mapInArrow(dealt, "feature string, x double, y int, block long")
        .groupBy("feature", "block")
        .agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("rows"))
        .select("feature", "block", F.col("rows.x").alias("x"), F.col("rows.y").alias("y"))
    )
    borders = materialize(_borders(packed, counts, k))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield pa.RecordBatch.from_pylist([_measure(row, sent.value[row["feature"]], k)], schema=_MEASURED_ARROW)

    found = materialize(packed.join(borders, ["feature", "block"]).mapInArrow(measured, _MEASURED))
    inside = found.select("feature", "done", "total")
    total = inside.unionByName(_outside(found, packed, borders.select("feature", "block", "offset")))
    per_label = counts.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (digamma(F.least(F.lit(k), F.col("n") - 1)) - digamma(F.col("n")))).alias("s")
    )
    each = total.groupBy("feature").agg(F.sum("total").alias("t"))
    info = digamma(F.col("n")) + (F.col("s") - F.col("t")) / F.col("n")
    return per_label.join(each, "feature").select("feature", F.greatest(F.lit(0.0), info).alias("mutual_info"))


def _borders(packed: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(feature, block, offset, labels): rows before each block, and of each label its rows and the k values next to the block."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in _rows(batch):
                x, y = row["x"], row["y"]
                for label in np.unique(y).tolist():
                    v = x[y == label]
                    out.append({"feature": row["feature"], "block": row["block"], "y": label, "m": len(v), "first": v[:k].tolist(), "last": v[-k:].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=ends_schema)

    ends_schema = pa.schema(
        [("feature", pa.string()), ("block", pa.int64()), ("y", pa.int32()), ("m", pa.int64()), ("first", pa.list_(pa.float64())), ("last", pa.list_(pa.float64()))]
    )
    edges = materialize(packed.mapInArrow(ends, "feature string, block long, y int, m long, first array<double>, last array<double>"))
    # As many rows as blocks: k blocks with rows of a label hold k values of it.
    near = W.partitionBy("feature", "y").orderBy("block")
    labels = edges.select(
        "feature", "block", "y",
        F.flatten(F.collect_list("last").over(near.rowsBetween(-k, -1))).alias("before"),
        F.flatten(F.collect_list("first").over(near.rowsBetween(1, k))).alias("after"),
    ).join(counts, ["feature", "y"])
    nearest = F.struct("y", "n", F.slice(F.reverse("before"), 1, k).alias("before"), F.slice("after", 1, k).alias("after"))
    by_block = labels.groupBy("feature", "block").agg(F.collect_list(nearest).alias("labels"))
    sizes = edges.groupBy("feature", "block").agg(F.sum("m").alias("m"))
    earlier = W.partitionBy("feature").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return by_block.join(sizes.select("feature", "block", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("offset")), ["feature", "block"])


_MEASURED = (
    "feature string, done long, total double, id array<long>, known array<long>, "
    "bounds array<struct<block:long,id:long,value:double,sign:int>>"
)
_MEASURED_ARROW = pa.schema(
    [
        ("feature", pa.string()), ("done", pa.int64()), ("total", pa.float64()), ("id", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())),
        ("bounds", pa.list_(pa.struct([("block", pa.int64()), ("id", pa.int64()), ("value", pa.float64()), ("sign", pa.int32())]))),
    ]
)


def _measure(row: dict, cuts: np.ndarray, k: int) -> dict:
    """Counts of the rows whose radius stays in the block; bounds to be ranked elsewhere for the others."""
    x, y, block = row["x"], row["y"], row["block"]
    radius = np.zeros(len(x))
    for label in row["labels"]:
        mine = y == label["y"]
        before = np.array(label["before"][::-1])
        v = np.concatenate([before, x[mine], label["after"]])
        radius[mine] = _radii(v, min(k, label["n"] - 1))[len(before) : len(before) + mine.sum()]
    low, high = x - radius * WITHIN, x + radius * WITHIN
    low_block, high_block = np.searchsorted(cuts, low, "right"), np.searchsorted(cuts, high, "right")
    rank_low, rank_high = row["offset"] + np.searchsorted(x, low, "left"), row["offset"] + np.searchsorted(x, high, "right")
    inside = (low_block == block) & (high_block == block)
    out = np.flatnonzero(~inside)
    ids = block << 32 | np.arange(len(x))
    known = np.where(high_block == block, rank_high, 0) - np.where(low_block == block, rank_low, 0)
    bounds = [
        {"block": int(blocks[i]), "id": int(ids[i]), "value": float(values[i]), "sign": sign}
        for blocks, values, sign in ((low_block, low, -1), (high_block, high, 1))
        for i in out[blocks[out] != block].tolist()
    ]
    return {
        "feature": row["feature"], "done": int(inside.sum()), "total": float(_digamma((rank_high - rank_low)[inside].astype(float)).sum()),
        "id": ids[out].tolist(), "known": known[out].tolist(), "bounds": bounds,
    }


def _outside(found: DataFrame, packed: DataFrame, offsets: DataFrame) -> DataFrame:
    """(feature, done, total) of the rows whose radius leaves their block."""
    bounds = found.select("feature", F.explode("bounds").alias("b")).select("feature", "b.*")
    salted = bounds.groupBy("feature", "block", F.pmod(F.col("id"), F.lit(SALTS)).alias("_s")).agg(
        F.collect_list(F.struct("id", "value", "sign")).alias("bounds")
    )
    spans = packed.join(offsets, ["feature", "block"]).select("feature", "block", "offset", "x")
    # A bound in an empty first block has no row before it and adds nothing.
    joined = salted.join(spans, ["feature", "block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                x = row["x"]
                value, sign = np.array([b["value"] for b in row["bounds"]]), np.array([b["sign"] for b in row["bounds"]])
                rank = row["offset"] + np.where(sign > 0, np.searchsorted(x, value, "right"), np.searchsorted(x, value, "left"))
                ids = pa.array([b["id"] for b in row["bounds"]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([row["feature"]] * len(ids)), ids, pa.array(rank * sign)], ["feature", "id", "m"])

    far = joined.mapInArrow(count, "feature string, id long, m long")
    near = found.select("feature", F.explode(F.arrays_zip("id", "known")).alias("z")).select("feature", "z.id", F.col("z.known").alias("m"))
    each = near.unionByName(far).groupBy("feature", "id").agg(F.sum("m").alias("m"))
    return each.groupBy("feature").agg(F.count(F.lit(1)).alias("done"), F.sum(digamma(F.col("m").cast("double"))).alias("total"))
