import datetime as dt

import pytest
from pyspark.sql import functions as F

from zonecast.functions import geo
from zonecast.operators import diagnose, metrics, models, scoring, splits
from zonecast.scale import exact_quantiles, group_ranks, ordered_rank, running_totals
from tests.helpers import scored, t, value


def flat(spark, labels, scores):
    return scored(spark, [("2026-06-01 10:00:00", f"z{i:02d}", float(s), y) for i, (y, s) in enumerate(zip(labels, scores))])


def test_precision_recall_lift(spark):
    df = flat(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    assert value(metrics.precision_at_k(df, 2)) == 0.5 and value(metrics.recall_at_k(df, 2)) == 0.5
    ten = flat(spark, [1] + [0] * 9, [1 - i / 10 for i in range(10)])
    assert value(metrics.top_decile_lift(ten)) == pytest.approx(10)
    with pytest.raises(ValueError):
        metrics.precision_at_k(df, 0)


def test_probability_metrics(spark):
    df = flat(spark, [1, 0, 1, 0], [0.8, 0.4, 0.6, 0.2])
    assert value(metrics.brier_score(df)) == pytest.approx((0.04 + 0.16 + 0.16 + 0.04) / 4)
    two = flat(spark, [0, 1], [0.2, 0.5])
    assert value(metrics.expected_calibration_error(two, 2)) == pytest.approx(0.35)


def test_tied_average_precision_and_auc(spark):
    df = flat(spark, [1, 0, 1, 0], [0.9, 0.5, 0.5, 0.1])
    row = metrics.curve_metrics(df).collect()[0]
    assert row.average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert row.roc_auc == pytest.approx((2 + 1.5) / 4)
    assert metrics.curve_metrics(flat(spark, [0, 0], [0.1, 0.2])).collect()[0].roc_auc == 0.0


def test_group_metrics(spark):
    rows = [("2026-06-01 10:00:00", "a", 0.9, 1), ("2026-06-01 10:00:00", "b", 0.1, 0), ("2026-06-01 11:00:00", "a", 0.9, 0), ("2026-06-01 11:00:00", "b", 0.1, 1)]
    df = scored(spark, rows)
    assert value(metrics.group_precision_at_k(df, 1)) == 0.5 and value(metrics.group_recall_at_k(df, 1)) == 0.5
    none = spark.createDataFrame([], "zone_id string, neighbor_id string")
    assert value(metrics.near_miss_hit_rate_at_k(df, 1, lookup=none)) == 0.5
    near = spark.createDataFrame([("a", "b")], "zone_id string, neighbor_id string")
    assert value(metrics.near_miss_hit_rate_at_k(df, 1, lookup=near)) == 1.0
    g = df.withColumn("district", F.col("zone_id"))
    assert value(metrics.group_hit_rate_at_k(g, "district", 2)) == 0.5


def test_model_selection_rules(spark):
    rows = [("neighbor_only", 0.215, 0.002, 0.0, 0.0, 0.003, 0.02, 0.9), ("rank_quality", 0.205, 0.007, 0.05, 0.03, 0.04, 0.44, 3.8)]
    cols = ["model", *[f"median_{c}" for c in ("neighbor_hit_rate_at_50", "group_precision_at_50", "precision_at_50", "precision_at_100", "average_precision", "group_recall_at_50", "top_decile_lift")]]
    assert metrics.select_model(spark.createDataFrame(rows, cols)).collect()[0].model == "rank_quality"
    plain = spark.createDataFrame([("lift_only", 0.0, 5.0), ("top_k", 0.02, 2.0)], ["model", "median_precision_at_50", "median_top_decile_lift"])
    assert metrics.select_model(plain).collect()[0].model == "top_k"


def hourly(spark, n, target=None):
    rows = [(t("2026-06-01 00:00:00") + dt.timedelta(hours=i), f"z{i}", (target or [0] * n)[i]) for i in range(n)]
    return spark.createDataFrame(rows, "target_time timestamp_ntz, zone_id string, target int")


def test_purged_splits(spark):
    meta = splits.split_metadata(splits.purged_rolling_splits(hourly(spark, 16), 120, 3), 120).collect()
    assert len(meta) == 3
    assert all(m.validation_start - m.train_end >= dt.timedelta(minutes=120) and m.train_rows > 0 for m in meta)
    with pytest.raises(Exception, match="distinct target times"):
        splits.purged_rolling_splits(hourly(spark, 4), 120, 3).collect()


def test_positive_holdout(spark):
    df = hourly(spark, 8, [0, 1, 0, 1, 0, 0, 0, 1])
    m = splits.holdout_metadata(splits.positive_count_holdout(df, "target", 2), 2).collect()[0]
    assert (m.holdout_start, m.met_min_positives, m.holdout_positives, m.train_rows) == (t("2026-06-01 03:00:00"), 1, 2, 3)
    short = splits.holdout_metadata(splits.positive_count_holdout(hourly(spark, 4, [0, 0, 1, 0]), "target", 5), 5).collect()[0]
    assert (short.met_min_positives, short.train_rows) == (0, 0)


def test_sampling_keeps_positives(spark):
    cols = "target_time string, zone_id string, zone_event_count_24h int, district_event_count_24h int, y int"
    one = spark.createDataFrame([("t", z, a, b, y) for z, a, b, y in zip("abcde", [2, 1, 9, 0, 5], [3, 3, 7, 0, 7], [1, 1, 0, 0, 0])], cols)
    got = splits.sample_training_rows(one, "y", 1).collect()
    assert sorted(r.zone_id for r in got) == ["a", "b", "c", "e"]
    rows = [("t0", z, 0, 0, 0) for z in "abc"] + [("t1", z, n, n, int(z == "d")) for z, n in zip("defg", [3, 2, 1, 0])]
    two = splits.sample_training_rows(spark.createDataFrame(rows, cols), "y", 2, 0.5).collect()
    assert sum(r.target_time == "t0" for r in two) <= 1 and sum(r.y for r in two) == 1
    none = splits.sample_training_rows(spark.createDataFrame(rows[:3], cols), "y", 2, 0.5)
    assert none.count() == 0


def test_combine_and_dispatch(spark):
    df = scored(spark, [("2026-06-01", "b", 0.2, 0), ("2026-06-01", "a", 0.8, 1)]).withColumnsRenamed({"score": "spatial_probability"}).withColumn("activity_probability", F.lit(0.5))
    got = {r.zone_id: (round(r.probability, 9), r.rank) for r in scoring.combine_scores(df).collect()}
    assert got == {"a": (0.4, 1), "b": (0.1, 2)}
    rows = [("2026-06-01", "a", 0.9, 0), ("2026-06-01", "b", 0.8, 0), ("2026-06-01", "c", 0.7, 0), ("2026-06-02", "d", 0.6, 1)]
    d = scoring.dispatch_rank(scored(spark, rows).withColumnRenamed("score", "probability"), 1)
    assert [r.zone_id for r in d.orderBy("dispatch_rank").collect()] == ["a", "d", "b", "c"]
    assert [scoring.dispatch_quota(f"alert_next_{h}") for h in ("30m", "1h", "2h")] == [10, 20, 1]


def test_blend_lifts_recent_zone(spark):
    df = scored(spark, [("2026-06-01", "cold", 0.5, 0), ("2026-06-01", "hot", 0.5, 0)])
    hot = F.col("zone_id") == "hot"
    df = df.withColumns({"zone_event_count_24h": F.when(hot, 10).otherwise(0), "neighbor_event_count_24h": F.when(hot, 5).otherwise(0), "district_event_count_24h": F.lit(1), "zone_same_hour_percentile_in_district": F.when(hot, 1.0).otherwise(0.1)})
    got = {r.zone_id: r.score for r in scoring.blend_recent_prior(df, 0.1).collect()}
    assert 0 <= got["cold"] < got["hot"] <= 1


def test_risk_bands(spark):
    df = spark.createDataFrame([(0.2,), (0.01,), (0.03,), (0.08,)], "p double")
    assert [r.b for r in df.select(geo.risk_band(F.col("p")).alias("b")).collect()] == ["critical", "low", "elevated", "high"]


def test_location_lookup(spark):
    lat, lng = geo.hex_center(F.lit(0), F.lit(0))
    z = spark.range(1).select(lat.alias("y"), lng.alias("x")).collect()[0]
    cols = "target_time string, zone_id string, district string, region string, zone_lat double, zone_lng double, score double"
    preds = spark.createDataFrame([("2026-06-01 10:00:00", "h9:0:0", "D", "R", z.y, z.x, 0.91), ("2026-06-01 10:00:00", "h9:9:9", "D", "R", z.y + 0.05, z.x, 0.2)], cols).withColumn("target_time", F.col("target_time").cast("timestamp_ntz"))
    pts = spark.createDataFrame([(1, z.y, z.x, t("2026-06-01 12:20:00")), (2, z.y + 0.04, z.x, t("2026-06-01 09:00:00"))], "point_id int, lat double, lng double, requested_time timestamp_ntz")
    got = {r.point_id: r for r in scoring.score_locations(pts, preds).collect()}
    assert (got[1].matched_zone, got[1].rank, got[1].risk_band, got[1].distance_km) == ("h9:0:0", 1, "high", 0.0)
    assert got[2].matched_zone == "h9:9:9" and 0 < got[2].distance_km < 2
    wide = scoring.score_locations_multi_horizon(pts, {"30m": preds, "1h": preds, "2h": preds})
    assert {"risk_30m", "risk_1h", "risk_2h"} <= set(wide.columns)


def test_error_scopes(spark):
    rows = [("2026-06-01 10:00:00", "a", 0.9, 0), ("2026-06-01 10:00:00", "b", 0.1, 1), ("2026-06-01 11:00:00", "c", 0.5, 1)]
    df = scored(spark, rows)
    a = diagnose.error_summary(df, "1h", 1, "artifact").collect()[0]
    b = diagnose.error_summary(df, "1h", 1, "per_target_time").collect()[0]
    assert (a.top1_true_positives, b.top1_true_positives, b.top1_recall) == (0, 1, 0.5)


def test_near_miss_rings(spark):
    rows = [("2026-06-01 10:00:00", "h9:0:0", 0.9, 0), ("2026-06-01 10:00:00", "h9:1:0", 0.1, 1)]
    df = scored(spark, rows).withColumns({"district": F.lit("D"), "region": F.lit("R")})
    r = diagnose.near_miss_summary(df, 1).collect()[0]
    assert (r.exact_hits, r.ring1_hits, r.district_hits, r.region_hits) == (0, 1, 1, 1)


def test_distributed_ranks_totals_and_quantiles(spark):
    """A third of the rows share one key and value; results equal plain windows."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"), (F.col("id") * 37 % 101).alias("v"))
    plain = {r.id: r for r in df.selectExpr("id", "row_number() OVER (ORDER BY v DESC, id) a", "row_number() OVER (PARTITION BY k ORDER BY v DESC, id) b", "sum(v) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) c", "rank() OVER (PARTITION BY k ORDER BY v DESC) d").collect()}
    order = [F.col("v").desc(), F.col("id")]
    assert all(plain[r.id].a == r["rank"] for r in ordered_rank(df, order).collect())
    assert all(plain[r.id].b == r["rank"] for r in ordered_rank(df, order, ["k"]).collect())
    assert all((plain[r.id].c or 0) == r.c for r in running_totals(df, [F.col("id")], {"c": "v"}, ["k"]).collect())
    for wide in (False, True):
        assert all(plain[r.id].d == r.d for r in group_ranks(df, "v", ["k"], {"d": "min_desc"}, wide).collect())
    q = exact_quantiles(df, "v", {"a": 0.5, "b": 0.95}, ["k"])
    want = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.95)).alias("b")).collect()}
    assert all(want[r.k] == pytest.approx((r.a, r.b)) for r in q.collect())


def test_feature_importance_and_io(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"), ((F.col("id") % 7) > 3).cast("int").alias("y"))
    m, rate = models.fit("random_forest_balanced", df, "y", ["x"], ["c"])
    top = models.feature_importance(m, df).collect()[0]
    assert top.importance > 0.5
    models.save_model(m, str(tmp_path / "m"))
    new = df.limit(20).withColumn("c", F.lit("unseen"))
    got = models.predict(models.load_model(str(tmp_path / "m")), new, ["x"], rate)
    assert got.filter("score < 0 OR score > 1").count() == 0 and got.columns == ["x", "c", "y", "score"]
