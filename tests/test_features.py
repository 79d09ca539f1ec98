import pytest
from pyspark.sql import functions as F

from zonecast.operators import cell_features, zone_features
from zonecast.operators.city_features import activity_features, effective_lookback
from zonecast.sources import adapter
from tests.helpers import events, t

Z = "h9:0:0"


def at(df, when, zone=None):
    df = df.filter(F.col("target_time") == F.lit(when).cast("timestamp_ntz"))
    return (df.filter(F.col("zone_id") == zone) if zone else df).collect()[0]


def test_zone_window_is_half_open(spark):
    ev = events(spark, [(f"2026-06-{s}", Z, "D") for s in ("01 09:00:00", "02 10:00:00", "02 11:00:00")])
    row = at(zone_features.zone_base_features(ev, 1, 120), "2026-06-02 09:00:00")
    assert (row.zone_event_count_24h, row.event_count_next_horizon, row.alert_next_2h) == (1, 1, 1)


def test_sub_hour_horizon(spark):
    days = [(f"2026-06-{d:02d} 10:00:00", Z, "D") for d in range(1, 17)] + [("2026-06-17 10:45:00", Z, "D")]
    ev = events(spark, days)
    assert at(zone_features.zone_base_features(ev, 7, 30), "2026-06-17 10:00:00").alert_next_30m == 0
    assert at(zone_features.zone_base_features(ev, 7, 120), "2026-06-17 10:00:00").alert_next_2h == 1


def test_activity_counts(spark):
    ev = events(spark, [("2026-06-01 00:10:00", Z, "D"), ("2026-06-01 03:30:00", Z, "D")])
    got = {r.target_time.hour: r for r in activity_features(ev, 60, 1).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[2].activity_next_1h, got[3].activity_next_1h, got[1].city_event_count_1h) == (0, 1, 1)


def test_effective_lookback(spark):
    ev = events(spark, [("2026-06-01 00:00:00", Z, "D"), ("2026-06-02 06:00:00", Z, "D")])
    assert effective_lookback(ev).collect()[0].lookback_hours == 29


FRAME = "target_time timestamp_ntz, zone_id string, district string, hour int, day_of_week int, zone_event_count_3h long, zone_event_count_24h long, zone_event_count_7d long, district_event_count_3h long, district_event_count_24h long, zone_same_hour_rate double"


def frame(spark, rows):
    when = t("2026-06-01 06:00:00")
    return spark.createDataFrame([(when, z, d, 6, 0, *n) for z, d, *n in rows], FRAME)


def test_engineered_ratios_and_neighbours(spark):
    df = frame(spark, [(Z, "D", 2, 10, 100, 5, 20, 0.1), ("h9:1:0", "D", 4, 8, 40, 5, 20, 0.1)])
    row = at(zone_features.add_engineered(df), "2026-06-01 06:00:00", Z)
    assert (row.zone_3h_to_24h_ratio, row.zone_24h_to_7d_ratio, row.district_3h_to_24h_ratio) == (0.2, 0.1, 0.25)
    assert (row.neighbor_event_count_3h, row.neighbor_event_count_24h, row.neighbor_active_zones_24h) == (4, 8, 1)
    assert row.hour_sin == pytest.approx(1) and row.hour_cos == pytest.approx(0, abs=1e-9)


def test_engineered_ring2(spark):
    df = frame(spark, [(Z, "D", 0, 1, 1, 0, 1, 0.0), ("h9:1:0", "D", 0, 5, 5, 0, 1, 0.0), ("h9:2:0", "D", 0, 7, 11, 0, 1, 0.0)])
    row = at(zone_features.add_engineered(df), "2026-06-01 06:00:00", Z)
    assert (row.ring2_event_count_24h, row.ring2_event_count_7d, row.ring2_active_zones_24h) == (7, 11, 1)
    assert row.ring2_to_ring1_24h_ratio == pytest.approx(7 / 5)


def test_engineered_district_and_distances(spark):
    df = frame(spark, [(Z, "D", 1, 8, 9, 0, 10, 0.9), ("h9:0:1", "D", 0, 2, 3, 0, 10, 0.1), ("h9:1:0", "D", 0, 0, 0, 0, 10, 0.0)])
    got = {r.zone_id: r for r in zone_features.add_engineered(df).collect()}
    assert got[Z].zone_24h_share_of_district == 0.8 and got["h9:0:1"].zone_24h_share_of_district == 0.2
    assert got[Z].zone_7d_rank_in_district == 1 and got[Z].zone_same_hour_percentile_in_district == 1.0
    quiet = got["h9:1:0"]
    assert 0 < quiet.distance_to_nearest_event_24h_m < 1500 and quiet.distance_to_district_recent_centroid_24h_m > 0
    assert quiet.nearest_road_m == 999_999.0


def test_fused_rings_equal_the_generic_ones(spark, sf):
    base = zone_features.zone_base_features(adapter.events(spark, sf), 7, 120)
    cols = ["target_time", "zone_id", "neighbor_event_count_24h", "neighbor_active_zones_24h", "ring2_event_count_7d", "ring2_active_zones_24h"]
    again = zone_features.add_ring(zone_features.add_ring(base, 1), 2)
    assert base.select(cols).exceptAll(again.select(cols)).count() == 0


def test_no_leakage_from_later_events(spark, sf):
    """Features at a time stay the same when every later event is removed."""
    ev = adapter.events(spark, sf)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    past = ev.filter(F.col("ts") < cut)
    drop = ["event_count_next_horizon", "alert_next_2h"]
    early = F.col("target_time") <= F.lit("2024-01-19 20:00:00").cast("timestamp_ntz")
    zones = past.select("zone_id").distinct()
    a = zone_features.zone_base_features(ev).filter(early).join(zones, "zone_id", "left_semi").drop(*drop)
    b = zone_features.zone_base_features(past).filter(early).drop(*drop)
    assert b.count() > 0
    assert b.exceptAll(a.select(b.columns)).count() == 0


def test_cell_features_at_equals_training_row(spark, sf):
    ev = adapter.events(spark, sf)
    rows = cell_features.cell_features(ev)
    when = rows.select(F.max("target_time")).collect()[0][0]
    train = rows.filter(F.col("target_time") == F.lit(when)).drop("has_event")
    now = cell_features.cell_features_at(ev, F.lit(str(when)))
    rounded = lambda d: d.select(*[F.round(c, 6).alias(c) if d.schema[c].dataType.typeName() == "double" else F.col(c).cast("string").alias(c) for c in sorted(train.columns)])
    a, b = rounded(train), rounded(now)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
