import datetime as dt
import random

from pyspark.sql import functions as F

from tests.helpers import t
from zonecast.operators.clean import dedupe_refresh
from zonecast.streaming import ingest, keyed, runs, sessions

SCHEMA = "report_id string, seen_at timestamp_ntz, upvote long, address string"


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    """Fifty batches: the state of touched ids is written, runs are merged, the log is right."""
    rng = random.Random(1)
    path, ck, state, log = (str(tmp_path / n) for n in ("in", "ck", "state", "log"))
    sink, everything, want, known, updated = keyed.states_sink(state, log, width=4), [], [], set(), []
    kept = {}

    def each(batch, batch_id):
        sink(batch, batch_id)
        kept[batch_id] = batch.filter("NOT _of_batch").count()

    for k in range(50):
        ids = [str(rng.randint(0, 40 + 5 * k)) for _ in range(12)] + ["hot"] * 5 + [None, ""]
        rows = [(i, t("2026-06-01 00:00:00") + dt.timedelta(minutes=10 * k - rng.randint(0, 300), seconds=n), rng.randint(0, 3), f"at {k}.{n}") for n, i in enumerate(ids)]
        everything += rows
        fresh = {i for i in ids if i} - known
        known |= fresh
        want.append((k, len(rows), len(fresh)))
        updated.append(len({i for i in ids if i}))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    ingest.run_available(keyed.refresh_states(source), ck, "update", each=each)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    logged = sorted((r.batch_id, r.total_reports, r.new_reports) for r in keyed.read_log(spark, log, 4).collect())
    assert len(logged) == 50 and sorted(x[1:] for x in logged) == sorted(x[1:] for x in want) and sum(x[2] for x in logged) == len(known)
    assert sorted(kept.values()) == sorted(updated)
    assert len(runs.current_runs(spark, state, 4)) == 3 + 0 + 2 and len(runs._listed(spark, f"{state}/level=0")) <= 18
    got = {tuple(r) for r in keyed.read_current(spark, state, width=4).collect()}
    assert got == {tuple(r) for r in dedupe_refresh(spark.createDataFrame(everything, SCHEMA)).collect()}


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    one = lambda n: spark.createDataFrame([(n,)], "n long")
    for batch in (0, 1, 1, 2, 3, 3, 4):
        runs.add_run(one(batch), path, batch, lambda d: d, 2)
    assert sorted(r.n for r in runs.read_runs(spark, path, 2).collect()) == [0, 1, 2, 3, 4]
    runs.remove(spark, f"{path}/level=2/run=0/_SUCCESS")  # a merge that did not finish
    assert sorted(r.n for r in runs.read_runs(spark, path, 2).collect()) == [0, 1, 2, 3, 4]


def plain_sessions(rows, gap):
    out = []
    for cell, ts in sorted(rows):
        if out and out[-1][0] == cell and ts - out[-1][2] < gap:
            out[-1] = (cell, out[-1][1], ts, out[-1][3] + 1)
        else:
            out.append((cell, ts, ts, 1))
    return sorted(out)


def test_late_rows_join_the_sessions_they_belong_to(spark, tmp_path):
    rng = random.Random(4)
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    at = lambda minutes: t("2026-06-01 00:00:00") + dt.timedelta(minutes=minutes, seconds=rng.randint(0, 59))
    batches = []
    for k in range(8):
        on_time = [(rng.choice("abc"), at(120 * k + rng.randint(0, 119))) for _ in range(25)]
        late = [(rng.choice("ab"), at(rng.randint(0, 120 * max(k - 2, 0)))) for _ in range(6)] if k > 2 else []
        batches.append(on_time + late)
    sink = sessions.sessions_sink(out, "cell", 15, "ts", 60)
    schema = "cell string, ts timestamp_ntz"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        ingest.run_available(spark.readStream.schema(schema).parquet(path), ck, "append", each=sink)
    got = sessions.read_sessions(spark, out, "cell", 15)
    assert sorted(tuple(r) for r in got.select("cell", "start_dt", "end_dt", "report_count").collect()) == plain_sessions(sum(batches, []), dt.timedelta(minutes=15))
    marks = sessions.read_marks(spark, out)
    assert marks.agg(F.sum("late_rows")).first()[0] >= 20 and marks.agg(F.sum("rows")).first()[0] == sum(map(len, batches))
    closed = spark.read.parquet(f"{out}/closed").drop("batch_id")
    keys = {r.cell for r in spark.read.parquet(f"{out}/late").collect()}
    assert keys == {"a", "b"} and closed.filter("cell = 'c'").exceptAll(got.filter("cell = 'c'").drop("state")).count() == 0
    assert len(runs._listed(spark, f"{out}/open")) == 2
    before = sorted(map(tuple, got.collect()))
    sink(spark.createDataFrame(batches[-1], schema), 7)  # the last batch again
    assert sorted(map(tuple, sessions.read_sessions(spark, out, "cell", 15).collect())) == before


def test_sessions_of_empty_batches(spark, tmp_path):
    sink, out = sessions.sessions_sink(str(tmp_path / "s"), "cell", 15, "ts"), str(tmp_path / "s")
    none = spark.createDataFrame([], "cell string, ts timestamp_ntz")
    for batch, rows in enumerate(([], [("a", t("2026-06-01 10:00:00")), ("a", None)], [])):
        sink(spark.createDataFrame(rows, none.schema), batch)
    assert [tuple(r) for r in sessions.read_sessions(spark, out, "cell", 15).collect()] == [("a", t("2026-06-01 10:00:00"), t("2026-06-01 10:00:00"), 1, "open")]
