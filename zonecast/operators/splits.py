"""Time-ordered folds, holdouts and training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.functions.timecols import epoch_micros
from zonecast.scale import exact_quantiles, ordered_rank, running_totals


def _numbered_times(df: DataFrame, time: str) -> DataFrame:
    """Distinct target times numbered from 1, with row counts; ranks are range-partitioned."""
    times = df.filter(F.col(time).isNotNull()).groupBy(time).agg(F.count(F.lit(1)).alias("rows"))
    return ordered_rank(times, [F.col(time)], name="pos")


def _fold_bounds(times: DataFrame, n_splits: int, need: int) -> DataFrame:
    """(fold, first, last): positions of each validation block, counted from the end."""
    one = times.agg(F.count(F.lit(1)).alias("t"))
    size = F.greatest(F.lit(1), F.floor(F.col("t") / F.lit(float(n_splits + 2)))).cast("bigint")
    folds = one.select("t", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("k"))
    start = F.col("t") - F.col("size") * (F.lit(n_splits) - F.col("k"))
    enough = F.when(F.col("t") >= need, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"need at least {need} distinct target times")).cast("boolean")
    )
    return (
        folds.filter(enough)
        .select(start.alias("start"), F.least(F.col("t"), start + F.col("size")).alias("end"), "k")
        .filter("start > 0 AND end > start")
        .select((F.col("k") + 1).alias("fold"), (F.col("start") + 1).alias("first"), F.col("end").alias("last"))
    )


def _tag_times(times: DataFrame, folds: DataFrame, cut: DataFrame, time: str) -> DataFrame:
    """(time, fold, role) for validation blocks and everything up to each cut.

    The fold table has ``n_splits`` rows, so it is attached as an array instead of
    a range join.
    """
    packed = folds.join(cut, "fold").agg(
        F.collect_list(F.struct("fold", "first", "last", "cutoff")).alias("f")
    ).scalar()
    each = times.select(time, "pos", "rows", F.explode(packed).alias("f"))
    role = F.when(F.col("pos").between(F.col("f.first"), F.col("f.last")), "validation").when(
        F.col(time) <= F.col("f.cutoff"), "train"
    )
    return each.select(time, "rows", F.col("f.fold").alias("fold"), role.alias("role")).filter(
        "role IS NOT NULL"
    )


def purged_rolling_splits(
    df: DataFrame, horizon_minutes: int, n_splits: int = 4, time: str = "target_time"
) -> DataFrame:
    """(time, fold, role): validation blocks from the end, training purged by the horizon."""
    times = _numbered_times(df, time)
    folds = _fold_bounds(times, n_splits, n_splits + 3)
    starts = folds.join(times, folds["first"] == times["pos"]).select(
        "fold", (F.col(time) - F.make_dt_interval(mins=F.lit(horizon_minutes))).alias("cutoff")
    )
    return _tag_times(times, folds, starts, time)


def walk_forward_splits(df: DataFrame, n_splits: int = 4, time: str = "target_time") -> DataFrame:
    """(time, fold, role): consecutive blocks, training is everything before, no purge."""
    times = _numbered_times(df, time)
    folds = _fold_bounds(times, n_splits, 4)
    starts = folds.join(times, folds["first"] - 1 == times["pos"]).select(
        "fold", F.col(time).alias("cutoff")
    )
    return _tag_times(times, folds, starts, time)


def split_metadata(tags: DataFrame, horizon_minutes: int, time: str = "target_time") -> DataFrame:
    """One row per fold that has both roles, renumbered from 1."""
    pick = lambda r, c: F.when(F.col("role") == r, c)
    stats = tags.groupBy("fold").agg(
        F.min(pick("train", F.col(time))).alias("train_start"),
        F.max(pick("train", F.col(time))).alias("train_end"),
        F.min(pick("validation", F.col(time))).alias("validation_start"),
        F.max(pick("validation", F.col(time))).alias("validation_end"),
        F.coalesce(F.sum(pick("train", F.col("rows"))), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(pick("validation", F.col("rows"))), F.lit(0)).alias("validation_rows"),
    )
    kept = stats.filter("train_rows > 0 AND validation_rows > 0")
    # n_splits rows.
    return kept.withColumn(
        "fold", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("fold"))
    ).withColumn("purge_minutes", F.lit(horizon_minutes))


def positive_count_holdout(
    df: DataFrame, target: str, min_positives: int = 50, time: str = "target_time"
) -> DataFrame:
    """(time, role): the latest times until they hold enough positives; the rest trains."""
    per_time = df.groupBy(time).agg(
        F.sum(F.col(target).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("rows")
    )
    # A time is held out while the times after it hold too few positives.
    return running_totals(per_time, [F.col(time).desc()], {"_later": "pos"}).select(
        time, "pos", "rows", F.when(F.col("_later") < min_positives, "holdout").otherwise("train").alias("role")
    )


def holdout_metadata(tags: DataFrame, min_positives: int = 50, time: str = "target_time") -> DataFrame:
    held = F.col("role") == "holdout"
    rows = F.coalesce(F.sum(F.when(held, F.col("rows"))), F.lit(0))
    positives = F.coalesce(F.sum(F.when(held, F.col("pos"))), F.lit(0))
    return tags.agg(
        (positives >= min_positives).cast("int").alias("met_min_positives"),
        F.min(F.when(held, F.col(time))).alias("holdout_start"),
        F.max(F.when(held, F.col(time))).alias("holdout_end"),
        rows.alias("holdout_rows"),
        positives.alias("holdout_positives"),
        F.when(rows > 0, positives / rows).otherwise(F.lit(0.0)).alias("holdout_base_rate"),
        F.coalesce(F.sum(F.when(~held, F.col("rows"))), F.lit(0)).alias("train_rows"),
    )


def time_quantile_split(df: DataFrame, q: float = 0.8, time: str = "target_time") -> DataFrame:
    """Tag rows before the interpolated time quantile as train."""
    us = df.withColumn("_us", epoch_micros(F.col(time)))
    cut = exact_quantiles(us, "_us", {"cut": q}).scalar()
    return us.withColumn(
        "role", F.when(F.col("_us") < cut, "train").otherwise("test")
    ).drop("_us")


def time_index_split(df: DataFrame, q: float = 0.8, time: str = "target_time") -> DataFrame:
    """Tag rows up to the distinct time at index ``int(n * q)`` as train."""
    times = _numbered_times(df, time)
    n = times.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = times.filter(F.col("pos") == F.floor(n * F.lit(q)) + 1).agg(F.max(time)).scalar()
    return df.withColumn("role", F.when(F.col(time) <= cut, "train").otherwise("test"))


def positional_split(
    df: DataFrame, keys: list[str], cuts: tuple[float, ...] = (0.8, 0.9),
    labels: tuple[str, ...] = ("train", "validation", "test"),
) -> DataFrame:
    """Split by position in time order, using a distributed row number."""
    ranked = ordered_rank(df, [F.col(k) for k in keys], name="position")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    role = F.when(F.col("position") <= F.floor(n * F.lit(cuts[0])), labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        role = role.when(F.col("position") <= F.floor(n * F.lit(cut)), label)
    return ranked.withColumn("role", role.otherwise(labels[-1]))


def latest_rows(df: DataFrame, n: int = 500, keys: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n)


def active_windows(df: DataFrame, target: str, time: str = "target_time") -> DataFrame:
    """Rows of the times that have at least one positive."""
    hot = df.filter(F.col(target).cast("int") == 1).select(time).distinct()
    return df.join(hot, time, "left_semi")


HARDNESS = ("zone_event_count_24h", "district_event_count_24h", "zone_event_count_7d")


def sample_training_rows(
    df: DataFrame, target: str, negative_ratio: int = 5, inactive_fraction: float = 0.02, seed: int = 42
) -> DataFrame:
    """All positives, the hardest negatives of active times, and a seeded few of the others.

    Limits depend on the number of positives, so they may be data-sized: rows are
    picked by a distributed rank, not by collecting a top list.
    """
    ratio = max(0, int(negative_ratio))
    positives = df.filter(F.col(target).cast("int") == 1)
    limit = positives.agg((F.count(F.lit(1)) * ratio).alias("n")).scalar()
    others = df.filter(F.col(target).cast("int") == 0)
    hot = positives.select("target_time").distinct()
    key = [F.col("target_time"), F.col("zone_id")]
    hard = [F.col(c).desc() for c in HARDNESS if c in df.columns]
    active = ordered_rank(others.join(hot, "target_time", "left_semi"), [*hard, *key], name="_r").filter(
        F.col("_r") <= limit
    )
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("zone_id"), F.col("target_time").cast("string")))
    quiet_limit = F.ceil(limit * F.lit(max(0.0, inactive_fraction)))
    quiet = ordered_rank(
        others.join(hot, "target_time", "left_anti").withColumn("_h", draw), [F.col("_h"), *key], name="_r"
    ).filter((F.col("_r") <= quiet_limit) & (limit > 0))
    return positives.unionByName(active.drop("_r")).unionByName(quiet.drop("_r", "_h"))


def ranker_groups(df: DataFrame, target: str, time: str = "target_time") -> DataFrame:
    """Sizes of the query groups that hold a positive, in time order."""
    return (
        active_windows(df, target, time)
        .groupBy(time)
        .agg(F.count(F.lit(1)).alias("group_size"), F.sum(F.col(target).cast("bigint")).alias("positives"))
        .orderBy(time)
    )


def rows_for(df: DataFrame, tags: DataFrame, fold: int, role: str, time: str = "target_time") -> DataFrame:
    """Rows of one fold's role."""
    picked = tags.filter((F.col("fold") == fold) & (F.col("role") == role)).select(time)
    return df.join(picked, time, "left_semi")
