"""Damaged archives, GeoJSON, stored intermediates, plans without needless moves."""

import json
import random

from pyspark.sql import functions as F

from tests.helpers import t
from zonecast import scale, session
from zonecast.operators import metrics, models
from zonecast.sources import archive
from zonecast.streaming import ingest


def test_salvage_accounts_for_every_piece(spark):
    records = {
        "1": {"alert_record_id": "1", "lat": "22.3", "address": "a {b} c"},
        "2": {"lat": "22.4", "address": 'quote " and \\ and }'},
        "3": {"lat": "22.5", "address": "x" * 20_000},
        "4": {"lat": "22.6", "address": {"nested": "{}"}},
    }
    whole = json.dumps({"meta": {"k": {"v": 1}}, "alerts": records})
    cut = whole[: whole.index('"3"')] + '"5": {"address": "crea'
    rows = [("whole", whole), ("cut", cut), ("none", "not an archive"), ("odd", '{"alerts": {"6": {"colour": "red"}}}'), ("empty", '{"alerts": {}}')]
    good, bad = archive.salvage_reports(spark.createDataFrame(rows, "path string, value string"))
    assert sorted((r.path, r.report_id) for r in good.collect()) == [("cut", "1"), ("cut", "2"), *(("whole", k) for k in "1234")]
    left = {r.path: r.raw for r in bad.collect()}
    assert set(left) == {"odd", "cut", "none"} and "crea" in left["cut"]
    texts = {r.report_id: r.address for r in good.filter("path = 'whole'").collect()}
    assert texts["1"] == "a {b} c" and texts["2"] == 'quote " and \\ and }'


def test_polygons_of_a_collection(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 1], [0.5, 0.5]]
    shape = lambda kind, c: {"type": kind, "coordinates": c}
    features = [
        {"type": "Feature", "properties": {"name": "holed"}, "geometry": shape("Polygon", [square, hole])},
        {"type": "Feature", "properties": {"name": "parts"}, "geometry": shape("MultiPolygon", [[square], [hole]])},
        {"type": "Feature", "properties": {"name": " "}, "geometry": shape("Polygon", [square])},
        {"type": "Feature", "properties": {}, "geometry": shape("Polygon", [square])},
        {"type": "Feature", "properties": {"name": "line"}, "geometry": shape("LineString", square)},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = archive.explode_polygons(archive.read_features(spark, str(tmp_path)))
    assert {r.name: [len(x) for x in r.rings] for r in got.collect()} == {"holed": [5, 5], "parts": [5, 5]}


def test_late_ids_are_kept(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "report_id string, seen_at timestamp_ntz"
    for rows in ([("a", t("2026-06-05 10:00:00"))], [("a", t("2026-06-05 11:00:00")), ("late", t("2026-06-01 10:00:00"))]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        ingest.run_available(ingest.stream_dedupe(spark.readStream.schema(schema).parquet(path)), str(tmp_path / "ck"), "append", path=out)
    assert sorted(r.report_id for r in spark.read.parquet(out).collect()) == ["a", "late"]


def test_kept_tables_live_in_the_shared_folder(spark):
    df = session.materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert all(f.startswith("file:") and "/kept-" in f for f in df.inputFiles())
    assert "x" not in df.select("id")._jdf.queryExecution().toString().split("ReadSchema")[-1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_on_blocks_models_or_labels(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(1000).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
        assert "Join" not in plan(scale.ordered_rank(df, [F.col("x"), F.col("id")]))
        assert "Join" not in plan(models.with_class_weight(df, "y"))
        ranked = df.select(F.lit("m").alias("model"), F.col("id").alias("rank"), F.col("y").alias("actual"))
        assert "Join" not in plan(metrics._decile(ranked, ["model"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    got = {(r.y, r.weight) for r in models.with_class_weight(df, "y").collect()}
    assert got == {(0, 8 / 12), (1, 2.0)}


def test_fold_rows_carry_volumes_and_thresholds(spark):
    pick = random.Random(4)
    rows = [(t(f"2026-06-{1 + h // 24:02d} {h % 24:02d}:00:00"), float(h % 5), "day", int(pick.random() < (h % 5) / 5)) for h in range(240)]
    df = spark.createDataFrame(rows, "target_time timestamp_ntz, x double, kind string, y int")
    got = models.evaluate_candidates(df, "y", ("x",), ("kind",), 60, ("logistic_balanced", "prior"), 2, "activity")
    assert got.count() == 4
    for r in got.collect():
        assert r.train_rows == r.unsampled_train_rows > 0 and r.validation_rows == r.rows and r.train_end < r.validation_start
        assert 0 <= r.precision_at_threshold_0_5 <= 1 and 0 <= r.recall_at_threshold_0_5 <= 1
    assert "median_precision_at_threshold_0_5" in models.summarize_folds(got).columns


def test_refresh_state_reads_only_touched_buckets(spark, tmp_path):
    state, log = str(tmp_path / "state"), str(tmp_path / "log")
    sink = ingest.refresh_sink(state, log)
    schema = "report_id string, seen_at timestamp_ntz, upvote long, address string"
    for k in range(6):
        rows = [(str(i), t(f"2026-06-01 1{k}:00:00"), k, f"at {k}") for i in range(k, k + 3)] + [(None, t(f"2026-06-01 1{k}:00:00"), 1, "none")]
        sink(spark.createDataFrame(rows, schema), k)
    sink(spark.createDataFrame([("0", t("2026-06-01 18:00:00"), 9, "late")], schema), 6)
    sink(spark.createDataFrame([], schema), 7)
    now = {r.report_id: (r.upvote, r.address) for r in ingest.read_refreshed(spark, state).collect()}
    assert now == {"0": (9, "at 0"), **{str(i): (min(i, 5), f"at {max(i - 2, 0)}") for i in range(1, 8)}}
    counts = [(r.total_reports, r.new_reports) for r in ingest.read_batch_log(spark, log).orderBy("batch_id").collect()]
    assert counts == [(4, 3), *[(4, 1)] * 5, (1, 0), (0, 0)]
    part = spark.read.parquet(state).filter("bucket IN (3, 4)")
    assert "bucket" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
