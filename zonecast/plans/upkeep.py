"""Clusters that are kept up to date: a batch of reports folds anew only the components it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import clean
from zonecast.session import materialize
from zonecast.sources import versioned

PART, SINCE, UNTIL = "part", "part_since", "part_until"
OWN = ("cluster_id", PART, SINCE, UNTIL)


def _days(df: DataFrame, first: str, last: str) -> set[str]:
    """Days that rows' spans cover: as many values as days."""
    spans = df.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("INTERVAL 1 DAY"))).alias("d")).distinct()
    return {str(r["d"]) for r in spans.collect()}


def _touched(near: DataFrame, fresh: DataFrame) -> DataFrame:
    """Components that hold a spot in reach of a spot of the new reports."""
    new = clean.spot_presence(fresh).withColumn("run", F.concat(F.lit("new:"), "run"))
    # A micro cell's bucket belongs to one component, so its rows keep the component in place of a run.
    old = clean.spot_rows(near, [F.col(PART)]).withColumnRenamed(PART, "run")
    both = materialize(new.select(*old.columns).unionByName(old))
    is_new = lambda c: F.col(c).startswith("new:")
    linked = clean.link_runs(both).filter(is_new("a") != is_new("b")).select(F.when(is_new("a"), F.col("b")).otherwise(F.col("a")).alias(PART))
    at = ["i", "j", "b"]
    same = both.filter(~is_new("run")).join(both.filter(is_new("run")).select(*at).hint("merge"), at, "left_semi").select(F.col("run").alias(PART))
    return linked.union(same).distinct()


def update_clusters(batch: DataFrame, path: str) -> int:
    """Add new reports to the clusters at ``path``; the number of the version that holds them.

    Reports need an id that was not added before, a position and ``create_dt``. Rows lie by the day of the report. The days around the
    batch are read for the places and times of their reports, then all reports of the components
    that the batch touches; these and the batch are clustered anew. All other components keep their rows; days that
    neither reach are not read or written. Readers see the new version as a whole, a failed update leaves the
    old one. One writer at a time.
    """
    spark = batch.sparkSession
    fresh = materialize(batch)
    day = F.to_date("create_dt")
    affected, touched = fresh, None
    if versioned.versions(spark, path):
        around = _days(fresh.select(F.date_sub(day, 1).alias("a"), F.date_add(day, 1).alias("b")).distinct(), "a", "b")
        near = versioned.read_version(spark, path, days=around)
        # Stored tables are far smaller on disk than in memory; what grows with the batch is not to be broadcast.
        touched = materialize(_touched(near, fresh)).hint("merge")
        spans = near.join(touched, PART, "left_semi").select(SINCE, UNTIL).distinct()
        members = versioned.read_version(spark, path, days=_days(spans, SINCE, UNTIL)).join(touched, PART, "left_semi")
        affected = materialize(members.select(*fresh.columns).unionByName(fresh))
    placed = affected.join(clean.label_clusters(affected).withColumnRenamed("label", PART).hint("merge"), "report_id")
    placed = materialize(placed)
    spans = placed.groupBy(PART).agg(F.min(day).alias(SINCE), F.max(day).alias(UNTIL))
    rows = placed.join(spans.hint("merge"), PART).select(*fresh.columns, *OWN)
    if touched is None:
        return versioned.replace_table(rows, path, F.col("create_dt"))
    changed = {str(r["d"]) for r in affected.select(day.alias("d")).distinct().collect()}
    others = versioned.read_version(spark, path, days=changed).join(touched, PART, "left_anti").select(*rows.columns)
    return versioned.replace_days(others.unionByName(rows), path, F.col("create_dt"))


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Reports with their ``cluster_id`` and component."""
    return versioned.read_version(spark, path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events as :func:`zonecast.operators.clean.consolidate_events` gives them for all reports so far."""
    return clean.merge_clusters(read_members(spark, path).drop(PART, SINCE, UNTIL))
