"""End-to-end compositions of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions.timecols import activity_target, zone_target
from zonecast.operators import cell_features, clean, metrics, models, scoring
from zonecast.operators.city_features import activity_features, effective_lookback
from zonecast.operators.zone_features import zone_features
from zonecast.session import materialize
from zonecast.sources.adapter import with_places


def clean_events(reports: DataFrame) -> DataFrame:
    """Valid reports, clustered into events, with zone, district and region."""
    merged = clean.consolidate_events(clean.valid_reports(reports))
    return with_places(merged).withColumnRenamed("create_dt", "ts")


def train_and_forecast(events: DataFrame, at: Column, model: str = "random_forest_balanced") -> DataFrame:
    """Train the cell model on history and score every cell at one moment."""
    rows = materialize(cell_features.cell_features(events))
    fitted, rate = models.fit(model, rows, "has_event", models.CELL_NUMERIC, models.CELL_CATEGORICAL)
    now = cell_features.cell_features_at(events, at)
    scored = models.predict(fitted, now, models.CELL_NUMERIC, rate, "probability")
    return scoring.cell_forecast(scored, events, at)


def cell_model_report(events: DataFrame, max_rounds: int = 100, top: int = 10) -> tuple[DataFrame, DataFrame | None]:
    """The boosted cell model, stopped on its validation part: sizes, rounds and holdout metrics, and its ``top`` features."""
    rows = materialize(cell_features.cell_features(events))
    model, report = models.fit_boosted(
        rows, "has_event", models.CELL_NUMERIC, models.CELL_CATEGORICAL, ["target_time", "grid_cell"], max_rounds
    )
    return report, models.feature_importance(model, models._doubles(rows, models.CELL_NUMERIC), top) if model else None


def two_stage(
    events: DataFrame,
    horizon_minutes: int,
    names: Sequence[str] = ("logistic_balanced", "random_forest_balanced"),
    n_splits: int = 4,
    min_positives: int = 50,
) -> dict[str, DataFrame]:
    """Activity and zone stages: features, folds, selection, holdout predictions."""
    look = effective_lookback(events).first()["lookback_hours"]
    a_target, z_target = activity_target(horizon_minutes), zone_target(horizon_minutes)
    activity = materialize(activity_features(events, horizon_minutes, look))
    zones = materialize(zone_features(events, max(1, look // 24), horizon_minutes))
    # Where every hour is active (or none is) there is nothing to learn for stage one:
    # it falls back to the base rate instead of failing the whole run.
    varied = activity.agg(F.min(a_target) < F.max(a_target)).first()[0]
    a_folds = materialize(
        models.evaluate_candidates(
            activity, a_target, models.ACTIVITY_NUMERIC, models.ACTIVITY_CATEGORICAL,
            horizon_minutes, names, n_splits, "activity",
        )
    ) if varied else None
    z_folds = materialize(
        models.evaluate_candidates(
            zones, z_target, models.ZONE_NUMERIC, models.ZONE_CATEGORICAL,
            horizon_minutes, names, n_splits, "spatial",
        )
    )
    a_best = (
        metrics.select_model(models.summarize_folds(a_folds), "activity").first()["model"]
        if varied
        else "prior"
    )
    z_best = metrics.select_model(models.summarize_folds(z_folds), "spatial").first()["model"]
    a_pred = materialize(models.holdout_activity(activity, a_target, a_best, min_positives))
    z_pred = materialize(models.holdout_spatial(zones, z_target, z_best, a_pred, min_positives))
    scored = z_pred.withColumn("score", F.col("spatial_probability")).drop("rank")
    return {
        "activity_folds": a_folds,
        "spatial_folds": z_folds,
        "activity_predictions": a_pred,
        "predictions": z_pred,
        "holdout_metrics": metrics.score_summary(scored, hits=True),
        "dispatch_metrics": metrics.dispatch_topk_metrics(z_pred),
    }


def multi_horizon(events: DataFrame, horizons: Sequence[int] = (30, 60, 120), **kwargs) -> DataFrame:
    """Holdout metrics of the two-stage run, one row per horizon."""
    activity = spatial = None
    for h in horizons:
        run = two_stage(events, h, **kwargs)
        a = metrics.score_summary(
            run["activity_predictions"].withColumnRenamed("activity_probability", "score"), groups=()
        ).withColumn("horizon_minutes", F.lit(h))
        d = run["dispatch_metrics"].withColumn("horizon_minutes", F.lit(h))
        z = run["holdout_metrics"].withColumn("horizon_minutes", F.lit(h)).join(d, "horizon_minutes")
        activity = a if activity is None else activity.unionByName(a)
        spatial = z if spatial is None else spatial.unionByName(z)
    return metrics.horizon_summary(activity, spatial)
