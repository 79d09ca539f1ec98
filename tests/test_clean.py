import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from zonecast.operators import clean
from tests.helpers import t

SCHEMA = "report_id string, lat double, lng double, address string, create_dt timestamp_ntz, upvote long, downvote long"


def reports(spark, rows):
    return spark.createDataFrame(
        [(r, a, b, f"at {r}", t(ts) if isinstance(ts, str) else ts, u, 0) for r, a, b, ts, u in rows], SCHEMA
    )


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def sequential(rows):
    """Plain first-fit clustering of all rows, as the rule is stated."""
    out, clusters = {}, []
    for rid, lat, lng, ts, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        for c in clusters:
            fresh = (ts - c["last"]).total_seconds() <= 15 * 60
            if fresh and metres(lat, lng, c["y"] / c["n"], c["x"] / c["n"]) <= 20:
                c["y"] += lat
                c["x"] += lng
                c["n"] += 1
                c["last"] = ts
                out[rid] = c["id"]
                break
        else:
            clusters.append({"id": rid, "y": lat, "x": lng, "n": 1, "last": ts})
            out[rid] = rid
    return out


def random_rows(n, spots, minutes, seed):
    rnd = random.Random(seed)
    centres = [(22.3 + rnd.random() * 0.002, 114.1 + rnd.random() * 0.002) for _ in range(spots)]
    rows = []
    for i in range(n):
        y, x = rnd.choice(centres)
        ts = dt.datetime(2026, 6, 1) + dt.timedelta(seconds=rnd.randrange(minutes * 60))
        rows.append((f"{i:05d}", y + rnd.gauss(0, 1e-4), x + rnd.gauss(0, 1e-4), ts, i % 7))
    return rows


def test_one_report_is_one_event(spark):
    got = clean.consolidate_events(reports(spark, [("a", 22.3154, 114.1698, "2026-06-28 11:37:50", 1)])).collect()
    assert [r.report_count for r in got] == [1]


def test_close_reports_merge(spark):
    rows = [("a", 22.31540, 114.16980, "2026-06-28 11:37:50", 3), ("b", 22.31542, 114.16982, "2026-06-28 11:40:00", 1)]
    (got,) = clean.consolidate_events(reports(spark, rows)).collect()
    assert (got.report_count, got.total_upvotes, got.address) == (2, 4, "at a")
    assert got.duration_min == pytest.approx(130 / 60)


@pytest.mark.parametrize("second", [(22.3199, 114.1698, "2026-06-28 11:40:00"), (22.3154, 114.1698, "2026-06-28 11:57:51")])
def test_far_or_late_reports_stay_apart(spark, second):
    rows = [("a", 22.3154, 114.1698, "2026-06-28 11:37:50", 0), ("b", *second, 0)]
    assert clean.consolidate_events(reports(spark, rows)).count() == 2


def test_clusters_equal_sequential_first_fit(spark):
    """Also with a hot spot that holds most rows, and far north, where cells in reach are many."""
    rows = random_rows(260, 3, 400, 7) + [
        (f"h{i:04d}", 22.4 + i % 3 * 2e-5, 114.2, dt.datetime(2026, 6, 1) + dt.timedelta(seconds=97 * i), 1)
        for i in range(150)
    ]
    rows += [(f"n{r}", lat + 56, (lng - 114) * 5, ts, u) for r, lat, lng, ts, u in random_rows(200, 6, 200, 8)]
    got = {r.report_id: r.cluster_id for r in clean.assign_clusters(reports(spark, rows)).collect()}
    assert got == sequential(rows)


def test_spot_that_never_falls_silent(spark):
    rows = [(f"{i:05d}", 22.4 + i % 5 * 5e-5, 114.2, dt.datetime(2026, 6, 1) + dt.timedelta(minutes=i), 1) for i in range(5000)]
    got = {r.report_id: r.cluster_id for r in clean.assign_clusters(reports(spark, rows)).collect()}
    assert got == sequential(rows)


def test_missing_votes_do_not_name_the_address(spark):
    rows = [("a", 22.3154, 114.1698, "2026-06-28 11:37:50", None), ("b", 22.3154, 114.1698, "2026-06-28 11:40:00", 2)]
    (got,) = clean.consolidate_events(reports(spark, rows)).collect()
    assert got.address == "at b"


def test_valid_reports_rules(spark):
    rows = [("a", 22.3, 114.1, "2026-06-01 10:00:00", 0), ("b", 0.0, 114.1, "2026-06-01 10:00:00", 0), ("c", 22.15, 113.83, "2026-06-01 09:00:00", 0)]
    df = reports(spark, rows).withColumn("downvote", F.when(F.col("report_id") == "a", 3).otherwise(F.col("downvote")).cast("long"))
    assert [r.report_id for r in clean.valid_reports(df).collect()] == ["c"]


def test_keep_first_and_refresh(spark):
    rows = [("x", 1, 2, "2026-06-01 10:00:00", "first"), ("x", 0, 5, "2026-06-01 11:00:00", "second"), ("", 9, 9, "2026-06-01 11:00:00", "none")]
    df = spark.createDataFrame(
        [(r, u, v, t(s), a) for r, u, v, s, a in rows],
        "report_id string, upvote long, downvote long, seen_at timestamp_ntz, address string",
    )
    first = {r.report_id: (r.address, r.upvote) for r in clean.dedupe_keep_first(df).collect()}
    assert first["x"] == ("first", 1)
    (kept,) = clean.dedupe_refresh(df).collect()
    assert (kept.address, kept.upvote, kept.downvote) == ("first", 1, 5)
    assert (kept.first_seen, kept.last_seen) == (t("2026-06-01 10:00:00"), t("2026-06-01 11:00:00"))


def test_partial_states_fold_in_any_split(spark, sf):
    from catalog import inputs

    df = inputs.copies(spark, sf)
    whole = clean.dedupe_refresh(df)
    cut = F.col("seen_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    split = clean.merge_partials(
        clean.refresh_partials(df.filter(cut)).unionByName(clean.refresh_partials(df.filter(~cut)))
    )
    assert whole.exceptAll(split).count() == 0 and split.exceptAll(whole).count() == 0


def test_refresh_takes_text_zeros_and_all_fields(spark):
    schema = "report_id string, seen_at timestamp_ntz, upvote string, downvote string, lastupdate_dt string, user_up string, user_down string, address string"
    rows = [
        ("x", t("2026-06-01 10:00:00"), "3", "1", "10:00", "u1", None, "first"),
        ("x", t("2026-06-01 11:00:00"), "0", None, "11:00", "", "d2", "second"),
        ("x", t("2026-06-01 12:00:00"), "", "2", None, None, None, "third"),
    ]
    (got,) = clean.dedupe_refresh(spark.createDataFrame(rows, schema)).collect()
    assert (got.upvote, got.downvote, got.lastupdate_dt, got.user_up, got.user_down, got.address) == ("0", "2", "11:00", "u1", "d2", "first")
