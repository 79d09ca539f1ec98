"""Fixed-grid marts, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions.timecols import seconds_between
from zonecast.operators.spatial import neighbors
from zonecast.scale import exact_quantiles
from zonecast.session import materialize

DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _counts(events: DataFrame, *by: str, name: str = "event_count") -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def sparsity_profile(grid: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each zone of the grid, of its district and of its region; events are read once."""
    n = F.coalesce("event_count", F.lit(0))
    counted = materialize(_counts(events, "zone_id", "district", "region", name="_n"))
    total = lambda by, name: counted.groupBy(by).agg(F.sum("_n").alias(name))
    return (
        grid.select("zone_id", "district", "region")
        .join(total("zone_id", "event_count"), "zone_id", "left")
        .join(total("district", "district_event_count"), "district", "left")
        .join(total("region", "region_event_count"), "region", "left")
        .select(
            "zone_id",
            "district",
            "region",
            n.alias("event_count"),
            F.round(F.log1p(n), 6).alias("log_event_count"),
            (n > 0).cast("int").alias("has_observed_history"),
            (n == 0).cast("int").alias("is_zero_history"),
            F.coalesce("district_event_count", F.lit(0)).alias("district_event_count"),
            F.coalesce("region_event_count", F.lit(0)).alias("region_event_count"),
        )
    )


def _profile(grid: DataFrame, events: DataFrame, part: str, size: int, share: str) -> DataFrame:
    """Complete zone x bucket table with counts and the share of the zone's total."""
    value = {"hour": F.hour("ts"), "day_of_week": F.weekday("ts")}[part]
    counts = events.groupBy("zone_id", value.alias(part)).agg(F.count(F.lit(1)).alias("event_count"))
    slots = grid.select("zone_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(part))
    n = F.coalesce("event_count", F.lit(0))
    return (
        slots.join(counts, ["zone_id", part], "left")
        .join(_counts(events, "zone_id", name="_total"), "zone_id", "left")
        .select(
            "zone_id",
            part,
            n.alias("event_count"),
            F.when(F.col("_total") > 0, F.round(n / F.col("_total"), 6)).otherwise(F.lit(0.0)).alias(share),
        )
    )


def hour_profile(grid: DataFrame, events: DataFrame) -> DataFrame:
    return _profile(grid, events, "hour", 24, "zone_hour_share")


def daily_profile(grid: DataFrame, events: DataFrame) -> DataFrame:
    return _profile(grid, events, "day_of_week", 7, "zone_day_share")


def recency_profile(grid: DataFrame, events: DataFrame) -> DataFrame:
    """Days since the last event of a zone, as of the newest event of the table."""
    as_of = events.agg(F.max("ts").alias("t")).scalar()
    last = events.groupBy("zone_id").agg(F.max("ts").alias("last_event_time"))
    days = seconds_between(as_of, F.col("last_event_time")) / F.lit(86400.0)
    recent = lambda n: F.coalesce((days <= n).cast("int"), F.lit(0))
    return grid.select("zone_id").join(last, "zone_id", "left").select(
        "zone_id",
        "last_event_time",
        F.round(days, 3).alias("days_since_last_event"),
        recent(7).alias("has_recent_7d"),
        recent(30).alias("has_recent_30d"),
    )


def neighbor_context(grid: DataFrame, events: DataFrame) -> DataFrame:
    """Neighbours that are in the grid, how many were ever active, and their events."""
    zones = grid.select("zone_id")
    counts = _counts(events, "zone_id", name="_n").withColumnRenamed("zone_id", "neighbor_id")
    around = (
        neighbors(zones, 1)
        .join(zones.withColumnRenamed("zone_id", "neighbor_id"), "neighbor_id")
        .join(counts, "neighbor_id", "left")
        .groupBy("zone_id")
        .agg(
            F.count(F.lit(1)).alias("fixed_neighbor_count"),
            F.count(F.when(F.col("_n") > 0, 1)).alias("observed_neighbor_count"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("neighbor_event_count"),
        )
    )
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.when(
        F.col("fixed_neighbor_count") > 0,
        F.round(F.col("observed_neighbor_count") / F.col("fixed_neighbor_count"), 6),
    ).otherwise(F.lit(0.0))
    return zones.join(around, "zone_id", "left").select(
        "zone_id",
        whole("fixed_neighbor_count"),
        whole("observed_neighbor_count"),
        whole("neighbor_event_count"),
        share.alias("neighbor_observed_share"),
    )


def zone_summary(events: DataFrame) -> DataFrame:
    by = ["zone_id", "district", "region"]
    zones = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min("zone_lat").alias("zone_lat"),
        F.min("zone_lng").alias("zone_lng"),
        F.countDistinct("grid_cell").alias("unique_grid_cells"),
    )
    active = events.groupBy("district").agg(F.countDistinct("zone_id").alias("district_active_zones"))
    return (
        zones.join(active, "district", "left")
        .withColumn("is_one_off_zone", (F.col("events") == 1).cast("int"))
        .orderBy(F.desc("events"), F.desc("last_seen"), "zone_id")
    )


def district_summary(events: DataFrame) -> DataFrame:
    # Unnamed districts are dropped on an aggregate: a filter on the key would be
    # pushed below the row-wise district lookup and evaluate it twice per row.
    return (
        events.groupBy("district", "region")
        .agg(
            F.max("district").alias("_name"),
            F.count(F.lit(1)).alias("events"),
            F.round(F.avg("total_upvotes"), 6).alias("avg_upvotes"),
            F.sum("total_upvotes").alias("total_upvotes"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .filter("_name <> ''")
        .drop("_name")
        .orderBy(F.desc("events"), "district")
    )


def region_share(events: DataFrame) -> DataFrame:
    total = events.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        events.groupBy("region")
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("pct", F.round(F.col("events") * F.lit(100.0) / total, 1))
        .orderBy(F.desc("events"), "region")
    )


def group_count_stats(events: DataFrame, group: str = "district") -> DataFrame:
    """Mean, median, sample deviation and extremes of the rows per group."""
    counts = events.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("n").alias("mean_count"),
        F.stddev_samp("n").alias("std_count"),
        F.min("n").alias("min_count"),
        F.min(F.struct("n", group))[group].alias("min_group"),
        F.max("n").alias("max_count"),
        F.min(F.struct(-F.col("n"), F.col(group).alias("g")))["g"].alias("max_group"),
    ).withColumn(
        "median_count",
        exact_quantiles(counts, "n", {"m": 0.5}).scalar(),
    )


def empty_groups(reference: DataFrame, events: DataFrame, group: str = "district") -> DataFrame:
    """Reference groups that have no row at all."""
    return reference.join(events.select(group).distinct(), group, "left_anti")


def report_totals(reports: DataFrame) -> DataFrame:
    span = F.floor(F.greatest(seconds_between(F.max("ts"), F.min("ts")), F.lit(0.0)) / F.lit(86400.0)) + 1
    return reports.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("district").alias("districts"),
        F.countDistinct("region").alias("regions"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("first_dt"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("last_dt"),
        span.alias("days_span"),
    )


def hourly_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("event_count"))


def weekday_counts(reports: DataFrame) -> DataFrame:
    """All seven day names in week order, zero where nothing happened."""
    days = reports.sparkSession.range(7).select(F.col("id").cast("int").alias("day_of_week"))
    named = F.get(F.array(*[F.lit(d) for d in DAY_NAMES]), F.col("day_of_week"))
    counts = reports.groupBy(F.weekday("ts").alias("day_of_week")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "day_of_week", "left").select(
        "day_of_week", named.alias("day_name"), F.coalesce("n", F.lit(0)).alias("event_count")
    )


def heatmap(reports: DataFrame) -> DataFrame:
    """Day name x hour of day, one column per hour."""
    day = F.get(F.array(*[F.lit(d) for d in DAY_NAMES]), F.weekday("ts"))
    wide = (
        reports.withColumn("hour", F.hour("ts"))
        .groupBy(day.alias("day_name"))
        .pivot("hour", list(range(24)))
        .agg(F.count(F.lit(1)))
    )
    return wide.select(
        "day_name", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in range(24)]
    )


def top_addresses(reports: DataFrame, n: int = 15) -> DataFrame:
    return (
        reports.filter("address <> ''")
        .groupBy("address")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy(F.desc("event_count"), "address")
        .limit(n)
    )


def latest_reports(reports: DataFrame, n: int = 20) -> DataFrame:
    return reports.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def dataset_stats(tables: dict[str, DataFrame], days: DataFrame) -> DataFrame:
    """(metric, value): row count per named table and the covered days."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
        rows = one if rows is None else rows.unionByName(one)
    return rows.unionByName(
        days.select(F.lit("days_collected").alias("metric"), F.col("days_collected").alias("value"))
    )


def top_positive_zones(frame: DataFrame, target: str, n: int = 20) -> DataFrame:
    return (
        frame.groupBy("zone_id", "district", "region")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(target).alias("positives"))
        .orderBy(F.desc("positives"), F.desc("rows"), "zone_id", "district")
        .limit(n)
    )


def resolution_profile(frame: DataFrame, target: str, resolution: int) -> DataFrame:
    """Density of one resolution's training table."""
    per = frame.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))
    median = exact_quantiles(per, "n", {"m": 0.5}).scalar()
    one = per.agg(
        F.sum("n").alias("training_rows"),
        F.count(F.lit(1)).alias("active_zones"),
        F.avg((F.col("n") == 1).cast("double")).alias("one_off_zone_rate"),
    )
    rate = frame.agg(F.avg(F.col(target).cast("double")).alias("r")).scalar()
    return one.select(
        F.lit(resolution).alias("resolution"),
        "training_rows",
        "active_zones",
        median.alias("median_events_per_zone"),
        "one_off_zone_rate",
        rate.alias("positive_rate"),
    )


def choose_resolution(rows: DataFrame, limit: float = 0.60) -> DataFrame:
    """Best row by (precision@20, lift, fewer one-offs); sparse ones only if nothing else."""
    dense = F.col("one_off_zone_rate") <= limit
    order = F.struct(
        dense.cast("int").alias("a"),
        F.col("precision_at_20").alias("b"),
        F.col("top_decile_lift").alias("c"),
        (-F.col("one_off_zone_rate")).alias("d"),
        (-F.col("resolution")).alias("e"),
    )
    return rows.agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")
