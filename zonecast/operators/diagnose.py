"""Error analysis, near-miss diagnostics and feature association."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions.geo import safe_divide
from zonecast.operators.metrics import _top
from zonecast.operators.spatial import neighbors
from zonecast.scale import exact_quantiles, group_ranks, histogram_quantiles, ordered_rank, running_totals
from zonecast.session import materialize

SCORE_COLUMNS = ("score", "probability", "spatial_probability")


def score_column(df: DataFrame) -> str:
    for c in SCORE_COLUMNS:
        if c in df.columns:
            return c
    raise ValueError("predictions need one of: " + ", ".join(SCORE_COLUMNS))


def rank_scopes(df: DataFrame, scope: str = "artifact") -> DataFrame:
    """Rank over the whole artifact, or inside each target time."""
    score = score_column(df)
    order = [F.col(score).desc(), F.col("zone_id"), F.col("target_time")]
    if scope == "artifact":
        return df if "rank" in df.columns else ordered_rank(df, order, name="rank")
    return ordered_rank(df.drop("rank"), order, ["target_time"], "rank")


def _flags(df: DataFrame, scope: str, k: int) -> DataFrame:
    ranked = rank_scopes(df, scope)
    top, pos = F.col("rank") <= k, F.col("actual") == 1
    return ranked.withColumns(
        {
            "_score": F.col(score_column(df)),
            "_top": top.cast("int"),
            "_tp": (top & pos).cast("int"),
            "_fp": (top & ~pos).cast("int"),
            "_missed": (~top & pos).cast("int"),
        }
    )


def error_summary(df: DataFrame, horizon: str, k: int = 50, scope: str = "artifact") -> DataFrame:
    """One row: volumes, score and positive-rank quantiles, top-k outcome."""
    flagged = materialize(_flags(df, scope, k))
    scores = exact_quantiles(flagged, "_score", {"score_p50": 0.5, "score_p95": 0.95})
    ranks = exact_quantiles(
        flagged.filter("actual = 1"),
        "rank",
        {"positive_rank_p50": 0.5, "positive_rank_p90": 0.9, "positive_rank_p95": 0.95},
    )
    one = flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("target_time").alias("target_times"),
        F.sum("actual").alias("positives"),
        F.avg("actual").alias("base_rate"),
        F.min("_score").alias("score_min"),
        F.max("_score").alias("score_max"),
        F.sum("_tp").alias(f"top{k}_true_positives"),
        F.sum("_fp").alias(f"top{k}_false_positives"),
        F.sum("_missed").alias(f"top{k}_missed_positives"),
        safe_divide(F.sum("_tp"), F.sum("_top")).alias(f"top{k}_precision"),
        safe_divide(F.sum("_tp"), F.sum("actual")).alias(f"top{k}_recall"),
    )
    pick = lambda d, c: F.coalesce(d.select(c).scalar(), F.lit(0.0)).alias(c)
    return one.select(
        F.lit(horizon).alias("horizon"),
        F.lit(scope).alias("rank_scope"),
        *one.columns,
        *[pick(scores, c) for c in scores.columns],
        *[pick(ranks, c) for c in ranks.columns],
    )


def error_by_group(df: DataFrame, group: str, horizon: str, k: int = 50, scope: str = "artifact") -> DataFrame:
    """Top-k outcome per group with the group's share of all false positives."""
    flagged = materialize(_flags(df, scope, k))
    all_fp = flagged.agg(F.sum("_fp")).scalar()
    rows, pos = F.count(F.lit(1)), F.sum("actual")
    return flagged.groupBy(group).agg(
        rows.alias("rows"),
        pos.alias("positives"),
        F.sum("_top").alias("topk_rows"),
        F.sum("_tp").alias("topk_tp"),
        F.sum("_fp").alias("topk_fp"),
        F.sum("_missed").alias("missed_positives"),
        F.avg("_score").alias("mean_score"),
        F.max("_score").alias("max_score"),
        F.min(F.when(F.col("actual") == 1, F.col("rank"))).cast("double").alias("best_positive_rank"),
        (pos / rows).alias("base_rate"),
        safe_divide(F.sum("_tp"), F.sum("_top")).alias(f"top{k}_precision"),
        safe_divide(F.sum("_tp"), pos).alias(f"top{k}_recall"),
    ).withColumns(
        {
            f"top{k}_fp_share": F.coalesce(safe_divide(F.col("topk_fp"), all_fp), F.lit(0.0)),
            "horizon": F.lit(horizon),
            "rank_scope": F.lit(scope),
        }
    )


def error_by_time(df: DataFrame, horizon: str, k: int = 50, scope: str = "artifact") -> DataFrame:
    """Top-k outcome per target time; precision always divides by k."""
    flagged = materialize(_flags(df, scope, k))
    per = flagged.groupBy("target_time").agg(
        F.hour(F.first("target_time")).alias("hour"),
        F.weekday(F.first("target_time")).alias("dayofweek"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("actual").alias("positives"),
        F.sum("_tp").alias("topk_tp"),
        F.sum("_fp").alias("topk_fp"),
        F.sum("_missed").alias("missed_positives"),
        F.max("_score").alias("top_score"),
    )
    medians = exact_quantiles(flagged, "_score", {"median_score": 0.5}, ["target_time"], wide=True)
    return per.join(medians, "target_time").withColumns(
        {
            "horizon": F.lit(horizon),
            "rank_scope": F.lit(scope),
            f"top{k}_precision": F.col("topk_tp") / F.lit(float(k)),
            f"top{k}_recall": safe_divide(F.col("topk_tp"), F.col("positives")),
        }
    )


def error_report(by_horizon: dict[str, DataFrame], k: int = 50) -> DataFrame:
    """Group errors by district and region for every horizon and rank scope, stacked."""
    out = None
    for horizon, df in by_horizon.items():
        for scope in ("artifact", "per_target_time"):
            for group in ("district", "region"):
                one = error_by_group(df, group, horizon, k, scope).withColumnRenamed(group, "level")
                one = one.withColumn("grouping", F.lit(group))
                out = one if out is None else out.unionByName(one)
    return out


def near_miss_summary(df: DataFrame, k: int = 50, lookups: dict[int, DataFrame] | None = None) -> DataFrame:
    """Per time: how many top-k rows are exact, ring, district or region hits.

    ``lookups`` maps a ring number to (zone_id, neighbor_id) in place of the lattice.
    """
    scored = df.withColumn("score", F.col(score_column(df)))
    top = materialize(_top(scored, k, ["target_time"]).select("target_time", "zone_id", "district", "region"))
    pos = materialize(
        scored.filter("actual = 1").select("target_time", "zone_id", "district", "region")
    )

    def reached(ring: int) -> DataFrame:
        zones = top.select("target_time", "zone_id")
        if lookups is not None:
            near = zones.join(lookups[ring], "zone_id")
        else:
            near = neighbors(zones, ring)
        hits = pos.select("target_time", F.col("zone_id").alias("neighbor_id"))
        return near.join(hits, ["target_time", "neighbor_id"], "left_semi").select("target_time", "zone_id").distinct()

    flagged = top
    for name, cols, table in (
        ("exact", ["target_time", "zone_id"], pos),
        ("r1", ["target_time", "zone_id"], reached(1)),
        ("r2", ["target_time", "zone_id"], reached(2)),
        ("district", ["target_time", "district"], pos),
        ("region", ["target_time", "region"], pos),
    ):
        mark = table.select(*cols).distinct().withColumn(f"_{name}", F.lit(1))
        flagged = flagged.join(mark, cols, "left")
    f = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
    counts = pos.groupBy("target_time").agg(F.count(F.lit(1)).alias("positives"))
    per = flagged.groupBy("target_time").agg(
        F.sum(f("exact")).alias("exact_hits"),
        F.sum(F.greatest(f("exact"), f("r1"))).alias("ring1_hits"),
        F.sum(F.greatest(f("exact"), f("r1"), f("r2"))).alias("ring2_hits"),
        F.sum(f("district")).alias("district_hits"),
        F.sum(f("region")).alias("region_hits"),
    )
    return per.join(counts, "target_time", "left").select(
        "target_time",
        F.lit(k).alias("k"),
        F.coalesce("positives", F.lit(0)).alias("positives"),
        "exact_hits",
        "ring1_hits",
        "ring2_hits",
        "district_hits",
        "region_hits",
        *[(F.col(f"{c}_hits") / F.lit(float(k))).alias(f"{c}_precision") for c in ("exact", "ring1", "ring2")],
    )


# --- feature association ------------------------------------------------------------


def _long(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, x, y): one row per value, so all features go through each step together."""
    return df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
            )
        ).alias("_f"),
        F.col(target).cast("double").alias("y"),
    ).select("_f.feature", "_f.x", "y")


def _corr(a: str, b: str) -> Column:
    """Pearson correlation, null when a side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def _histogram(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, x, n, p): rows and positives of each value, one row for a feature's nulls.

    Everything about one feature and a 0/1 label follows from this; rows are counted
    before the shuffle and not read again.
    """
    long = _long(df, features, target).filter("y IS NOT NULL")
    return long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))


def _by_feature(small: DataFrame) -> Column:
    """A table with one row per feature, thus per column, as literals to look a row's feature up in."""
    rest = [f for f in small.schema if f.name != "feature"]
    pairs = [
        part
        for row in small.collect()
        for part in (F.lit(row["feature"]), F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in rest]))
    ]
    return F.element_at(F.create_map(*pairs), F.col("feature")) if pairs else F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])


def _placed(hist: DataFrame) -> DataFrame:
    """Values that are not null, with the number of rows below each."""
    known = hist.filter("x IS NOT NULL")
    return materialize(running_totals(known, [F.col("x")], {"n_below": "n"}, ["feature"]))


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson and Spearman of each feature with a 0/1 label; 0 for constant or short ones."""
    # A binary label's average ranks are a linear map of it, so ranking x is enough.
    placed = _placed(_histogram(df, features, target)).withColumn("r", F.col("n_below") + (F.col("n") + 1) / F.lit(2.0))
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m{c}")
    means = placed.groupBy("feature").agg(mean("x"), mean("r"), (F.sum("p") / F.sum("n")).alias("my"))
    known = _by_feature(means)
    dx, dr, my = F.col("x") - known["mx"], F.col("r") - known["mr"], known["my"]
    cross = lambda d: F.sum(d * (F.col("p") - F.col("n") * my))
    spread = lambda d: F.sum(F.col("n") * d * d)
    label = F.sum(F.col("p") * (1 - my) * (1 - my) + (F.col("n") - F.col("p")) * my * my)
    one = placed.groupBy("feature").agg(
        F.try_divide(cross(dx), F.sqrt(spread(dx) * label)).alias("p"),
        F.try_divide(cross(dr), F.sqrt(spread(dr) * label)).alias("s"),
        F.sum("n").alias("n"),
        (F.min("x") == F.max("x")).alias("flat"),
    )
    usable = (F.col("n") >= 3) & ~F.col("flat")
    value = lambda c: F.when(usable, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0))
    return one.select(
        "feature",
        value("p").alias("pearson"),
        F.abs(value("p")).alias("abs_pearson"),
        value("s").alias("spearman"),
        F.abs(value("s")).alias("abs_spearman"),
    )


def _cuts(placed: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    total = _by_feature(placed.groupBy("feature").agg(F.sum("n").alias("n_total")))["n_total"]
    return histogram_quantiles(placed.withColumn("n_total", total), "x", quantiles, ["feature"])


def feature_medians(df: DataFrame, features: Sequence[str], target: str) -> dict[str, float]:
    """Exact median of each feature that has a value, over the labelled rows: one number per column."""
    placed = _placed(materialize(_histogram(df, features, target)))
    return {r["feature"]: r["median"] for r in _cuts(placed, {"median": 0.5}).select("feature", "median").collect()}


def binned_mutual_info(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of quantile-binned features with a 0/1 label; nulls take the median."""
    hist = materialize(_histogram(df, features, target))
    cuts = _cuts(_placed(hist), {"median": 0.5, **{f"q{i}": i / bins for i in range(1, bins)}})
    mine = _by_feature(cuts)
    x = F.coalesce("x", mine["median"])
    slot = sum((F.coalesce((x > mine[f"q{i}"]).cast("int"), F.lit(0)) for i in range(1, bins)), F.lit(0))
    cells = hist.groupBy("feature", slot.alias("b")).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    total = _by_feature(cells.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("p").alias("p")))

    def term(part: Column, of_label: Column) -> Column:
        part, of_label = part.cast("double"), of_label.cast("double")
        inside = part / total["n"] * F.ln(part * total["n"] / (F.col("n") * of_label))
        return F.when(part > 0, inside).otherwise(F.lit(0.0))

    both = term(F.col("p"), total["p"]) + term(F.col("n") - F.col("p"), total["n"] - total["p"])
    return cells.groupBy("feature").agg(F.greatest(F.sum(both), F.lit(0.0)).alias("mutual_info"))


def categorical_signal(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Level with the highest label rate per categorical feature, and its lift."""
    overall = df.agg(F.avg(target)).scalar()
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features])
        ).alias("_f"),
        F.col(target).cast("double").alias("y"),
    )
    levels = long.groupBy("_f.feature", "_f.level").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    best = F.min(F.struct((-F.col("rate")).alias("a"), (-F.col("n")).alias("b"), "level", "n", "rate"))
    return levels.groupBy("feature").agg(F.count(F.lit(1)).alias("levels"), best.alias("t")).select(
        "feature",
        "levels",
        F.col("t.level").alias("top_level"),
        F.col("t.n").alias("top_level_rows"),
        F.col("t.rate").alias("top_level_positive_rate"),
        safe_divide(F.col("t.rate"), overall).alias("lift_vs_global"),
    )


def feature_pairs(df: DataFrame, features: Sequence[str], at_least: float = 0.85) -> DataFrame:
    """Feature pairs whose absolute Spearman correlation reaches the threshold.

    Average ranks replace the values, then one aggregation yields every pair's
    correlation; the number of pairs depends on the columns only.
    """
    keyed = materialize(df.select(F.monotonically_increasing_id().alias("_id"), *features))
    long = keyed.select(
        "_id",
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
        ).alias("_f"),
    ).select("_id", "_f.feature", "_f.x")
    ranks = group_ranks(long.filter("x IS NOT NULL"), "x", ["feature"], {"r": "avg"}, wide=True)
    wide = ranks.groupBy("_id").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("r"))).alias(f) for f in features]
    )
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = wide.agg(F.array(*[_pair(a, b) for a, b in pairs]).alias("_p"))
    return (
        one.select(F.explode("_p").alias("_p"))
        .select("_p.*")
        .filter(F.col("abs_spearman") >= at_least)
        .orderBy(F.desc("abs_spearman"), "feature_a", "feature_b")
    )


def _pair(a: str, b: str) -> Column:
    return F.struct(
        F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.abs(_corr(a, b)).alias("abs_spearman")
    )


def high_half_positive_rate(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Label rate among rows at or above each feature's median (nulls take the median)."""
    hist = materialize(_histogram(df, features, target))
    median = _by_feature(_cuts(_placed(hist), {"median": 0.5}))["median"]
    high = F.coalesce("x", median) >= median
    sums = [F.sum(F.when(high, F.col(c))) for c in ("p", "n")]
    return hist.groupBy("feature").agg(F.max(median).alias("median"), F.try_divide(*sums).alias("positive_rate_high"))
