"""The registered queries: contract, plan shape, and a few oracles end to end."""

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.oracle import ORACLE
from catalog.queries import QUERIES

TABLES = ("region", "nation", "customer", "supplier", "events")


def test_contract():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 130
    extra = entry.queries().keys() - QUERIES.keys()
    assert QUERIES.keys() <= entry.queries().keys() and all(k == "pipeline" or k.startswith("op") for k in extra)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["d2_dedupe_refresh", "g5_point_in_polygon", "g14_nearest_line", "z2_zone_counts", "z15_nearest_active", "x5_district_recent", "w1_stream_dedupe", "w2_stream_refresh", "w4_stream_zone_counts", "k4_dispatch_rank"])
def test_oracle_agrees(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    assert mine == sorted(str(tuple(r)) for r in cur.fetchall())


NO_PAIRING = ["f1_valid_reports", "d1_dedupe_keep_first", "g4_nearest_station", "m2_hour_profile", "m4_recency_profile", "z17_line_context"]


@pytest.mark.parametrize("name", NO_PAIRING)
def test_plans_have_no_cross_join(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    from zonecast.sources import archive

    plan = archive.events_since(df, "2024-01-20").select("event_id", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
