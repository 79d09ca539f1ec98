"""Ranking and probability metrics over a scored table, optionally per model or fold.

Inputs carry ``target_time``, ``zone_id``, ``score`` and ``actual``. ``by`` names
grouping columns; ties in score are broken by zone, then time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.functions.geo import safe_divide
from zonecast.operators.spatial import neighbors
from zonecast.scale import exact_quantiles, ordered_rank, running_totals
from zonecast.session import materialize

TIE = ("zone_id", "target_time")


def _need_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _order(df: DataFrame, score: str = "score") -> list[Column]:
    return [F.col(score).desc(), *[F.col(c) for c in TIE if c in df.columns]]


def with_rank(df: DataFrame, by: Sequence[str] = (), score: str = "score", name: str = "rank") -> DataFrame:
    """Row numbers by descending score, computed without a single-task sort."""
    return ordered_rank(df, _order(df, score), by, name)


def _top(df: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k best rows, of the table or of each group; k is a small report size."""
    if not by:
        return df.orderBy(*_order(df)).limit(k)
    w = W.partitionBy(*by).orderBy(*_order(df))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def precision_at_k(df: DataFrame, k: int) -> DataFrame:
    _need_k(k)
    return _top(df, k).agg(_zero(F.avg("actual")).alias("precision"))


def recall_at_k(df: DataFrame, k: int) -> DataFrame:
    _need_k(k)
    total = df.agg(F.sum("actual").alias("p")).scalar()
    return _top(df, k).agg(_zero(F.sum("actual")).alias("hits")).select(
        F.when(total > 0, F.col("hits") / total).otherwise(F.lit(0.0)).alias("recall")
    )


def top_decile_lift(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positive rate of the best tenth of the rows over the base rate."""
    return _decile(with_rank(df, by), by)


def _decile(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    by = list(by)
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("p"))
    # ceil(n / 10) as the reference computes it: on the floating product n * 0.1.
    cut = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.1)))
    # A row per model and fold: packed into one value, so that the ranked rows do not move to meet it.
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    packed = sizes.agg(
        F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.struct("n", "p").alias("v")))).alias("m")
    ).scalar()
    mine = F.element_at(packed, key)
    joined = ranked.withColumns({"n": mine["n"], "p": mine["p"]})
    top = joined.filter(F.col("rank") <= cut).groupBy(*by).agg(
        F.avg("actual").alias("top"), F.max(F.col("p") / F.col("n")).alias("base")
    )
    return top.select(*by, safe_divide(F.col("top"), F.col("base")).alias("top_decile_lift"))


def _clip(c: str = "score") -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))


def brier_score(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    err = _clip() - F.col("actual")
    return df.groupBy(*by).agg(_zero(F.avg(err * err)).alias("brier_score"))


def expected_calibration_error(df: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Weighted gap between mean score and hit rate over equal-width bins."""
    if bins <= 0:
        raise ValueError("n_bins must be positive")
    by = list(by)
    slot = F.least(F.floor(_clip() * F.lit(bins)), F.lit(bins - 1))
    per_bin = df.groupBy(*by, slot.alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_clip()).alias("conf"), F.avg("actual").alias("acc")
    )
    gap = F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")
    return per_bin.groupBy(*by).agg(_zero(gap).alias("expected_calibration_error"))


def group_hit_rate_at_k(df: DataFrame, group: str, k: int) -> DataFrame:
    """Share of the groups with a positive that appear in the global top k."""
    _need_k(k)
    positive = df.filter((F.col("actual") == 1) & (F.col(group) != "")).select(group).distinct()
    top = _top(df, k).select(group).distinct().withColumn("_in", F.lit(1))
    return positive.join(top, group, "left").agg(
        _zero(F.avg(F.coalesce("_in", F.lit(0)))).alias("group_hit_rate")
    )


def group_precision_at_k(df: DataFrame, k: int, group: str = "target_time", by: Sequence[str] = ()) -> DataFrame:
    """Mean precision of the top k over all groups."""
    _need_k(k)
    by = list(by)
    per = _top(df, k, [*by, group]).groupBy(*by, group).agg(F.avg("actual").alias("p"))
    return per.groupBy(*by).agg(_zero(F.avg("p")).alias("group_precision"))


def group_recall_at_k(df: DataFrame, k: int, group: str = "target_time", by: Sequence[str] = ()) -> DataFrame:
    """Mean recall of the top k over the groups that have a positive."""
    _need_k(k)
    by = list(by)
    totals = df.groupBy(*by, group).agg(F.sum("actual").alias("t")).filter("t > 0")
    hits = _top(df, k, [*by, group]).groupBy(*by, group).agg(F.sum("actual").alias("h"))
    per = totals.join(hits, [*by, group])
    return per.groupBy(*by).agg(_zero(F.avg(F.col("h") / F.col("t"))).alias("group_recall"))


def near_miss_hit_rate_at_k(
    df: DataFrame, k: int, group: str = "target_time", by: Sequence[str] = (), lookup: DataFrame | None = None
) -> DataFrame:
    """Share of groups whose top k holds a positive zone or a neighbour of one.

    Groups without positives count as 0. ``lookup`` (zone_id, neighbor_id) replaces
    the hex lattice.
    """
    _need_k(k)
    by = list(by)
    top = _top(df, k, [*by, group]).select(*by, group, "zone_id")
    near = (
        neighbors(top, 1).drop("zone_id").withColumnRenamed("neighbor_id", "zone_id")
        if lookup is None
        else top.join(lookup, "zone_id").select(*by, group, F.col("neighbor_id").alias("zone_id"))
    )
    positives = df.filter("actual = 1").select(*by, group, "zone_id")
    hit = (
        top.unionByName(near)
        .join(positives, [*by, group, "zone_id"], "left_semi")
        .select(*by, group)
        .distinct()
        .withColumn("_hit", F.lit(1))
    )
    groups = df.select(*by, group).distinct()
    return (
        groups.join(hit, [*by, group], "left")
        .groupBy(*by)
        .agg(_zero(F.avg(F.coalesce("_hit", F.lit(0)))).alias("near_miss_hit_rate"))
    )


def _score_curve(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score: positives and rows, and how many score higher."""
    steps = df.groupBy(*by, "score").agg(
        F.sum("actual").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n")
    )
    return materialize(
        running_totals(steps, [F.col("score").desc()], {"pos_above": "pos", "n_above": "n"}, by)
    )


def curve_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision (tied scores grouped) and ROC AUC (ties count half)."""
    by = list(by)
    c = _score_curve(df, by)
    tp = F.col("pos_above") + F.col("pos")
    neg = F.col("n") - F.col("pos")
    return c.groupBy(*by).agg(
        F.when(
            F.sum("pos") > 0,
            F.sum(F.col("pos") * tp / (F.col("n_above") + F.col("n"))) / F.sum("pos"),
        )
        .otherwise(F.lit(0.0))
        .alias("average_precision"),
        F.when(
            (F.sum("pos") > 0) & (F.sum(neg) > 0),
            F.sum(neg * (F.col("pos_above") + F.col("pos") / 2)) / (F.sum("pos") * F.sum(neg)),
        )
        .otherwise(F.lit(0.0))
        .alias("roc_auc"),
    )


def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_metrics(df, by).select(*by, "average_precision")


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_metrics(df, by).select(*by, "roc_auc")


def threshold_metrics(df: DataFrame, cut: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    said, true = F.col("score") >= cut, F.col("actual") == 1
    n = lambda c: F.count(F.when(c, 1))
    counts = df.groupBy(*by).agg(
        n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(~said & ~true).alias("tn"), n(~said & true).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "*",
        safe_divide(tp, tp + fp).alias("precision"),
        safe_divide(tp, tp + fn).alias("recall"),
        safe_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
    )


def _at_threshold(threshold: float) -> list[Column]:
    over, name = _clip() >= threshold, f"{threshold:g}".replace(".", "_")
    hit = F.sum(F.when(over, F.col("actual")))
    return [
        _zero(F.try_divide(hit, F.count_if(over))).alias(f"precision_at_threshold_{name}"),
        _zero(F.try_divide(hit, F.sum("actual"))).alias(f"recall_at_threshold_{name}"),
    ]


def score_summary(
    df: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = (20, 50, 100),
    groups: Sequence[str] = ("district", "region"), hits: bool = False, threshold: float | None = None,
) -> DataFrame:
    """All metrics in one row per ``by`` group, from a single distributed ranking.

    ``hits`` adds the per-target-time metrics at 50 and neighbour hits, ``threshold``
    precision and recall of the rows that score as much or more.
    """
    by = list(by)
    marked = df if by else df.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    ranked = materialize(with_rank(marked, keys))
    n, p = F.count(F.lit(1)), F.sum("actual")
    err = _clip() - F.col("actual")
    top = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("actual")))
    out = ranked.groupBy(*keys).agg(
        n.cast("double").alias("rows"),
        p.cast("double").alias("positives"),
        F.avg("actual").alias("base_rate"),
        *[_zero(top(k) / F.least(n, F.lit(k))).alias(f"precision_at_{k}") for k in ks],
        *[F.when(p > 0, top(k) / p).otherwise(F.lit(0.0)).alias(f"recall_at_{k}") for k in ks],
        F.avg(err * err).alias("brier_score"),
        *([] if threshold is None else _at_threshold(threshold)),
    )
    parts = [_decile(ranked, keys), curve_metrics(ranked, keys), expected_calibration_error(ranked, 10, keys)]
    for g in groups:
        per = ranked.groupBy(*keys, g).agg(F.max("actual").alias("any"), F.min("rank").alias("best"))
        parts.append(
            per.filter((F.col("any") == 1) & (F.col(g) != ""))
            .groupBy(*keys)
            .agg(*[F.avg((F.col("best") <= k).cast("double")).alias(f"{g}_hit_rate_at_{k}") for k in ks])
        )
    if hits:
        rename = lambda d, a, b: d.withColumnRenamed(a, b)
        parts.append(rename(group_precision_at_k(ranked, 50, by=keys), "group_precision", "group_precision_at_50"))
        parts.append(rename(group_recall_at_k(ranked, 50, by=keys), "group_recall", "group_recall_at_50"))
        for k in ks:
            parts.append(
                rename(near_miss_hit_rate_at_k(ranked, k, by=keys), "near_miss_hit_rate", f"neighbor_hit_rate_at_{k}")
            )
    for part in parts:
        out = out.join(part, keys, "left")
    filled = out.na.fill(0.0)
    return filled if by else filled.drop("_all")


def fold_medians(
    folds: DataFrame, metrics: Sequence[str], by: str = "model", spread: Sequence[str] = ()
) -> DataFrame:
    """Median of each metric over a model's folds and population deviations (few rows)."""
    return folds.groupBy(by).agg(
        F.count(F.lit(1)).alias("folds"),
        *[F.percentile(m, F.lit(0.5)).alias(f"median_{m}") for m in metrics],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in spread],
    )


# Sort order of each selection rule.
SELECT_ACTIVITY = (("median_average_precision", -1), ("median_roc_auc", -1), ("median_brier_score", 1))
SELECT_ITERATION = (
    ("median_top_decile_lift", -1),
    ("median_average_precision", -1),
    ("median_precision_at_100", -1),
    ("median_precision_at_50", -1),
    ("median_brier_score", 1),
    ("precision_at_20_std", 1),
)
SELECT_SPATIAL = (
    ("median_group_precision_at_50", -1),
    ("median_precision_at_50", -1),
    ("median_precision_at_100", -1),
    ("median_average_precision", -1),
    ("median_group_recall_at_50", -1),
    ("median_top_decile_lift", -1),
    ("median_neighbor_hit_rate_at_50", -1),
)


def select_model(summary: DataFrame, rule: str = "spatial", tolerance: float = 0.02) -> DataFrame:
    """Best model by a lexicographic rule; the spatial rule first keeps models whose
    neighbour hits are within ``tolerance`` of the best."""
    order = {"activity": SELECT_ACTIVITY, "iteration": SELECT_ITERATION, "spatial": SELECT_SPATIAL}[rule]
    gate = "median_neighbor_hit_rate_at_50"
    if rule == "spatial" and gate in summary.columns:
        best = summary.agg(F.max(gate)).scalar()
        summary = summary.filter(F.col(gate) >= best - F.lit(tolerance))
    keys = [F.col(c).desc() if s < 0 else F.col(c).asc() for c, s in order if c in summary.columns]
    return summary.orderBy(*keys, "model").limit(1)


def historical_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Score test rows by their district's training rate, else the global rate."""
    rates = train.groupBy("district").agg(F.avg(target).alias("_rate"))
    overall = train.agg(F.avg(target)).scalar()
    return test.join(rates, "district", "left").withColumn("score", F.coalesce("_rate", overall)).drop("_rate")


def dispatch_topk_metrics(df: DataFrame, k: int = 50) -> DataFrame:
    return df.filter(F.col("dispatch_rank") <= k).agg(
        _zero(F.avg("actual")).alias(f"dispatch_precision_at_{k}"),
        _zero(F.sum("actual")).alias(f"dispatch_hits_at_{k}"),
        F.countDistinct("target_time").cast("double").alias(f"dispatch_target_times_at_{k}"),
    )


def horizon_summary(activity: DataFrame, spatial: DataFrame) -> DataFrame:
    """One row per horizon with both stages' metrics side by side."""
    prefix = lambda df, p: df.select(
        "horizon_minutes", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "horizon_minutes"]
    )
    m = F.col("horizon_minutes")
    slug = F.when(m % 60 == 0, F.concat((m / 60).cast("int").cast("string"), F.lit("h"))).otherwise(
        F.concat(m.cast("string"), F.lit("m"))
    )
    return (
        prefix(activity, "activity")
        .join(prefix(spatial, "spatial"), "horizon_minutes", "full")
        .withColumns({"horizon": slug, "model_family": F.lit("two_stage")})
        .orderBy("horizon_minutes")
    )


def score_quantiles(df: DataFrame, qs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(df, "score", qs, by)
