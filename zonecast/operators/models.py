"""Training, comparing and applying classifiers with Spark MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.operators import metrics, ranker, scoring, splits
from zonecast.session import materialize

# Feature lists of the two stages and of the cell model.
ACTIVITY_NUMERIC = (
    "hour", "day_of_week", "is_weekend",
    "city_event_count_1h", "city_event_count_3h", "city_event_count_24h", "city_event_count_7d",
    "active_districts_24h", "active_regions_24h",
    "city_3h_to_24h_ratio", "city_24h_to_7d_ratio",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
)
ACTIVITY_CATEGORICAL = ("hour_bucket",)
ZONE_NUMERIC = (
    "zone_lat", "zone_lng",
    "hour", "day_of_week", "is_weekend",
    "zone_event_count_1h", "zone_event_count_3h", "zone_event_count_24h", "zone_event_count_7d",
    "zone_hours_since_last_event",
    "district_event_count_3h", "district_event_count_24h", "district_active_zones_24h",
    "zone_same_hour_rate", "district_same_hour_rate", "is_urban_core",
    "zone_3h_to_24h_ratio", "zone_24h_to_7d_ratio", "district_3h_to_24h_ratio",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "neighbor_event_count_3h", "neighbor_event_count_24h", "neighbor_event_count_7d",
    "neighbor_active_zones_24h",
    "ring2_event_count_24h", "ring2_event_count_7d", "ring2_active_zones_24h",
    "ring2_to_ring1_24h_ratio",
    "distance_to_nearest_event_3h_m", "distance_to_nearest_event_24h_m",
    "distance_to_district_recent_centroid_24h_m",
    "zone_24h_share_of_district", "zone_7d_rank_in_district", "zone_same_hour_percentile_in_district",
    "nearest_road_m", "road_segment_count", "road_source_mismatch", "has_drivable_road",
)
ZONE_CATEGORICAL = ("district", "region", "hour_bucket")
CELL_NUMERIC = (
    "hour", "day_of_week", "is_weekend", "month",
    "cell_historical_freq", "cell_7d_count", "cell_24h_count",
    "cell_last_seen_hours_ago", "neighbor_24h_count", "streak_active",
    "upvote_ratio", "avg_report_count",
    "district_24h_count", "district_historical_rate", "district_active_cells", "district_hour_rate",
    "hour_historical_rate", "dow_hour_rate",
)
CELL_CATEGORICAL = ("district", "region")

MIN_DAYS = 14


def data_gate(days: DataFrame) -> DataFrame:
    """Whether enough days were collected to train."""
    d = F.col("days_collected")
    return days.select(
        "days_collected",
        F.lit(MIN_DAYS).alias("days_needed"),
        F.greatest(F.lit(0), F.lit(MIN_DAYS) - d).alias("days_remaining"),
        (d >= MIN_DAYS).cast("int").alias("ready"),
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Mode of each categorical column (one row)."""
    row = df.agg(*[F.mode(c, deterministic=True).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else "missing" for c in columns}


def preprocess(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Median impute and standardise numbers; index and one-hot categories, unknown as its own slot."""
    filled = [f"{c}_filled" for c in numeric]
    indexed = [f"{c}_index" for c in categorical]
    hot = [f"{c}_hot" for c in categorical]
    stages = [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numbers"),
        StandardScaler(withMean=True, withStd=True, inputCol="numbers", outputCol="scaled"),
    ]
    if categorical:
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep"),
        ]
    return [*stages, VectorAssembler(inputCols=["scaled", *hot], outputCol="features")]


def _doubles(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in numeric})


def with_class_weight(df: DataFrame, target: str) -> DataFrame:
    """Balanced weights: rows / (2 * rows of the class). Both class sizes are scalars, so no row moves."""
    known = df.filter(F.col(target).isNotNull())
    ones = F.count_if(F.col(target) == 1)
    sizes = known.agg(F.struct(F.count(F.lit(1)).alias("n"), ones.alias("p")).alias("s")).scalar()
    mine = F.when(F.col(target) == 1, sizes["p"]).otherwise(sizes["n"] - sizes["p"])
    return known.withColumn("weight", sizes["n"] / (2 * mine))


CANDIDATES: dict[str, Callable[[str], object]] = {
    "logistic_balanced": lambda y: LogisticRegression(
        labelCol=y, weightCol="weight", maxIter=50, regParam=0.01
    ),
    "random_forest_balanced": lambda y: RandomForestClassifier(
        labelCol=y, weightCol="weight", numTrees=40, maxDepth=8, minInstancesPerNode=2, seed=42
    ),
    "boosted_trees_balanced": lambda y: GBTClassifier(
        labelCol=y, weightCol="weight", maxIter=20, maxDepth=4, stepSize=0.1, minInstancesPerNode=20, seed=42
    ),
    "pairwise_ranker": None,
    "prior": None,
}
#: Candidates that learn from pairs inside target times; they need zones and are no use to the activity stage.
RANKERS = ("pairwise_ranker",)


def fit(
    name: str, train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str]
) -> tuple[PipelineModel | None, float]:
    """Fitted pipeline and the training base rate (the prior has no pipeline, nor has a ranker without a pair to learn from)."""
    rate = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    if CANDIDATES[name] is None and name not in RANKERS:
        return None, rate
    weighted = with_class_weight(_doubles(train, numeric), target)
    modes = most_frequent(weighted, categorical) if categorical else {}
    ready = weighted.na.fill(modes) if modes else weighted
    if name in RANKERS:
        prepared = Pipeline(stages=preprocess(numeric, categorical)).fit(ready)
        last = ranker.fit_ranker(prepared.transform(ready), target)
        return (PipelineModel(stages=[*prepared.stages, *last.stages]) if last else None), rate
    return Pipeline(stages=[*preprocess(numeric, categorical), CANDIDATES[name](target)]).fit(ready), rate


def fit_boosted(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    keys: Sequence[str],
    max_rounds: int = 100,
    step: float = 0.1,
    depth: int = 4,
) -> tuple[PipelineModel | None, DataFrame]:
    """Boosted trees that stop when a validation part gains nothing more, and their report on rows they never saw.

    Rows are taken in the order of ``keys``: the first 80 % train, the next 10 % decide after how many rounds to stop, the
    last 10 % give the report: one row with the three sizes, the rounds in use, ROC AUC, and precision, recall and F1 at
    0.5. Training parts with one class only give no model; the report then scores the base rate.
    """
    known = _doubles(df.filter(F.col(target).isNotNull()), numeric)
    rows = materialize(splits.positional_split(known, list(keys)))
    seen = rows.filter("role <> 'test'")
    train = rows.filter("role = 'train'")
    classes = train.agg(F.min(target).alias("low"), F.max(target).alias("high"), F.avg(F.col(target).cast("double")).alias("rate")).first()
    model, rounds = None, 0
    if classes["low"] != classes["high"]:
        modes = most_frequent(train, categorical) if categorical else {}
        fill = lambda d: d.na.fill(modes) if modes else d
        prepared = Pipeline(stages=preprocess(numeric, categorical)).fit(fill(train))
        weighted = with_class_weight(fill(seen), target).withColumn("decides", F.col("role") == "validation")
        ready = materialize(prepared.transform(weighted).select("features", "weight", "decides", target))
        trees = GBTClassifier(
            labelCol=target, weightCol="weight", validationIndicatorCol="decides", validationTol=0.0,
            maxIter=max_rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=20, seed=42,
        ).fit(ready)
        model, rounds = PipelineModel(stages=[*prepared.stages, trees]), trees.getNumTrees
    scored = predict(model, rows.filter("role = 'test'"), numeric, classes["rate"] or 0.0)
    judged = materialize(scored.select(*[k for k in keys if k != target], "score", F.col(target).cast("int").alias("actual")))
    size = lambda role: F.count_if(F.col("role") == role).alias(f"{role}_rows")
    cut = metrics.threshold_metrics(judged).select(F.struct("precision", "recall", "f1")).scalar()
    report = rows.agg(size("train"), size("validation"), size("test")).select(
        "*",
        F.lit(rounds).alias("rounds"),
        metrics.roc_auc(judged).scalar().alias("roc_auc"),
        *(cut[c].alias(c) for c in ("precision", "recall", "f1")),
    )
    return model, report


def predict(
    model: PipelineModel | None, df: DataFrame, numeric: Sequence[str], rate: float = 0.0, out: str = "score"
) -> DataFrame:
    """Positive-class probability, without the intermediate columns."""
    if model is None:
        return df.withColumn(out, F.lit(float(rate)))
    scored = model.transform(_doubles(df, numeric))
    return scored.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, out)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importance(model: PipelineModel, df: DataFrame, top: int = 30) -> DataFrame:
    """Largest importances (or absolute coefficients) with feature names."""
    meta = model.transform(df.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a.get("name", str(a["idx"])) for part in meta.values() for a in part}
    last = model.stages[-1]
    raw = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(names.get(i, str(i)), abs(float(v))) for i, v in enumerate(raw.toArray())]
    out = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.desc("importance"), "feature").limit(top)


def evaluate_candidates(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    horizon_minutes: int | None,
    names: Sequence[str] = tuple(CANDIDATES),
    n_splits: int = 4,
    stage: str = "spatial",
) -> DataFrame:
    """Metrics per (model, fold). With a horizon the folds are purged, else walk-forward.

    The loop is over models and folds; fitting, scoring and metrics are Spark jobs.
    The spatial stage trains on sampled rows and blends the recent prior; the activity stage leaves rankers out.
    """
    if stage == "activity":
        names = [n for n in names if n not in RANKERS]
    frame = materialize(df)
    tags = materialize(
        splits.purged_rolling_splits(frame, horizon_minutes, n_splits)
        if horizon_minutes is not None
        else splits.walk_forward_splits(frame, n_splits)
    )
    folds = [r["fold"] for r in tags.select("fold").distinct().orderBy("fold").collect()]
    scored = used = None
    for fold in folds:
        train = splits.rows_for(frame, tags, fold, "train")
        test = splits.rows_for(frame, tags, fold, "validation")
        if stage == "spatial":
            train = splits.sample_training_rows(train, target)
        train = materialize(train)
        size = train.agg(F.lit(fold).alias("fold"), F.count(F.lit(1)).alias("train_rows"))
        used = size if used is None else used.unionByName(size)
        seen = train.agg(F.min(target), F.max(target)).first()
        if seen[0] is None or seen[0] == seen[1]:
            continue
        for name in names:
            model, rate = fit(name, train, target, numeric, categorical)
            one = predict(model, test, numeric, rate)
            if stage == "spatial":
                one = scoring.blend_recent_prior(one, scoring.blend_alpha(target))
            keep = [c for c in ("zone_id", "district", "region") if c in one.columns]
            one = one.select(
                F.lit(name).alias("model"),
                F.lit(fold).alias("fold"),
                "target_time",
                *keep,
                "score",
                F.col(target).cast("int").alias("actual"),
            )
            scored = one if scored is None else scored.unionByName(one)
    if scored is None:
        raise ValueError("no fold has both classes in training")
    spatial = stage == "spatial"
    summary = metrics.score_summary(
        materialize(scored),
        by=["model", "fold"],
        groups=("district", "region") if spatial else (),
        hits=spatial,
        threshold=None if spatial else 0.5,
    )
    return summary.join(fold_volumes(frame, tags), "fold").join(used, "fold")


def fold_volumes(frame: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows and time bounds of both parts of every fold."""
    per_time = frame.groupBy("target_time").agg(F.count(F.lit(1)).alias("_n"))
    part = lambda f, c, role: f(F.when(F.col("role") == role, F.col(c)))
    return (
        tags.select("target_time", "fold", "role")
        .join(per_time, "target_time")
        .groupBy("fold")
        .agg(
            part(F.sum, "_n", "train").alias("unsampled_train_rows"),
            part(F.sum, "_n", "validation").alias("validation_rows"),
            part(F.min, "target_time", "train").alias("train_start"),
            part(F.max, "target_time", "train").alias("train_end"),
            part(F.min, "target_time", "validation").alias("validation_start"),
            part(F.max, "target_time", "validation").alias("validation_end"),
        )
    )


VOLUMES = (
    "train_rows", "unsampled_train_rows", "validation_rows",
    "train_start", "train_end", "validation_start", "validation_end",
)


def summarize_folds(folds: DataFrame) -> DataFrame:
    names = [c for c in folds.columns if c not in ("model", "fold", "rows", "positives", "base_rate", *VOLUMES)]
    return metrics.fold_medians(folds, names, spread=("precision_at_20", "average_precision"))


def holdout_activity(df: DataFrame, target: str, name: str, min_positives: int = 50) -> DataFrame:
    """Refit on everything before the holdout; (target_time, activity_probability, actual)."""
    tags = materialize(splits.positive_count_holdout(df, target, min_positives))
    part = lambda role: df.join(tags.filter(F.col("role") == role).select("target_time"), "target_time", "left_semi")
    model, rate = fit(name, part("train"), target, ACTIVITY_NUMERIC, ACTIVITY_CATEGORICAL)
    return predict(model, part("holdout"), ACTIVITY_NUMERIC, rate, "activity_probability").select(
        "target_time",
        scoring.clip01(F.col("activity_probability")).alias("activity_probability"),
        F.col(target).cast("int").alias("actual"),
    )


def holdout_spatial(
    df: DataFrame, target: str, name: str, activity: DataFrame, min_positives: int = 50
) -> DataFrame:
    """Ranked, banded and dispatch-ordered predictions of the zone holdout."""
    tags = materialize(splits.positive_count_holdout(df, target, min_positives))
    part = lambda role: df.join(tags.filter(F.col("role") == role).select("target_time"), "target_time", "left_semi")
    train = materialize(splits.sample_training_rows(part("train"), target))
    model, rate = fit(name, train, target, ZONE_NUMERIC, ZONE_CATEGORICAL)
    scored = scoring.blend_recent_prior(
        predict(model, part("holdout"), ZONE_NUMERIC, rate), scoring.blend_alpha(target)
    )
    base = scored.select(
        "target_time",
        "zone_id",
        "district",
        "region",
        "zone_lat",
        "zone_lng",
        scoring.clip01(F.col("score")).alias("spatial_probability"),
        F.col(target).cast("int").alias("actual"),
    )
    combined = scoring.combine_scores(scoring.activity_lookup(base, activity))
    return scoring.dispatch_rank(combined, scoring.dispatch_quota(target))


