"""Tables that seem small to Spark and are not must not pass through the driver."""

from pyspark.sql import functions as F

from zonecast.functions import geo
from zonecast.operators import clean, zone_features
from zonecast.scale import group_ranks
from zonecast.session import materialize


def broadcasts(df):
    """The parts of the plan that would be broadcast, each as its lines."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
        end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
        out.append(lines[i:end])
    return out


def reports(spark):
    return spark.range(40).selectExpr(
        "cast(id AS string) report_id", "cast(22.3 + id % 2 * 0.0003 AS double) lat", "cast(114.1 + id div 10 * 0.01 AS double) lng",
        "timestamp_ntz'2026-06-01 00:00:00' + make_dt_interval(0, 0, cast(id AS int)) create_dt",
    )


def test_linked_runs_send_no_exploded_table_through_the_driver(spark):
    linked = clean.link_runs(materialize(clean.spot_presence(reports(spark))))
    assert not [x for part in broadcasts(linked) for x in part if "Generate" in x]
    assert linked.count() == 4


def test_clusters_broadcast_nothing_that_grows_with_the_reports(spark):
    owned = clean.assign_clusters(materialize(reports(spark)))
    assert not broadcasts(owned)
    assert owned.count() == 40


def zone_rows(spark):
    """Twelve zones side by side at two hours; one of them is active at the first."""
    zone = geo.hex_id(F.col("id") % 4 + 30000, F.expr("id div 4 % 3") + 4000, geo.DEFAULT_RESOLUTION)
    counts = {f"zone_event_count_{w}": F.when(F.col("id") == 5, n).otherwise(0) for w, n in (("3h", 1), ("24h", 2), ("7d", 3))}
    at = F.expr("timestamp_ntz'2026-06-01 00:00:00' + make_dt_interval(0, cast(id div 12 AS int))")
    df = spark.range(24).select(at.alias("target_time"), zone.alias("zone_id"), F.lit("A").alias("district"), *[c.alias(k) for k, c in counts.items()])
    lat, lng = geo.hex_center(*geo.hex_qr(F.col("zone_id")), geo.DEFAULT_RESOLUTION)
    more = {"zone_lat": lat, "zone_lng": lng, "zone_same_hour_rate": F.col("zone_event_count_3h") / 7, "district_event_count_24h": F.lit(2)}
    return materialize(df.withColumns(more))


def test_rings_are_not_broadcast(spark):
    got = zone_features.add_ring(zone_rows(spark), 1)
    assert not broadcasts(got)
    assert got.filter("neighbor_event_count_24h = 2 AND neighbor_active_zones_24h = 1").count() == 6


def test_ranks_in_groups_are_not_broadcast(spark):
    rows = zone_rows(spark)
    ranked = group_ranks(rows, "zone_event_count_7d", ["target_time", "district"], {"r": "min_desc"})
    assert not broadcasts(ranked)
    assert sorted((r["r"], r["n"]) for r in ranked.groupBy("r").agg(F.count("*").alias("n")).collect()) == [(1.0, 13), (2.0, 11)]
    both = zone_features.add_district_relative(rows)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 4  # rows, totals, a histogram of each value
