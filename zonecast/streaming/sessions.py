"""Sessions of a stream, with a side channel for rows that come behind the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonecast.session import materialize
from zonecast.streaming.runs import complete, remove

def fold_sessions(pieces: DataFrame, key: str, gap_minutes: int) -> DataFrame:
    """(key, start_dt, end_dt, report_count): pieces of sessions joined where less than the gap lies between them."""
    w = W.partitionBy(key).orderBy("start_dt", "end_dt")
    before = F.max("end_dt").over(w.rowsBetween(W.unboundedPreceding, -1))
    near = F.timestamp_diff("MICROSECOND", before, F.col("start_dt")) < gap_minutes * 60_000_000
    marked = pieces.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_s", F.sum("_new").over(w))
    return marked.groupBy(key, "_s").agg(
        F.min("start_dt").alias("start_dt"), F.max("end_dt").alias("end_dt"), F.sum("report_count").alias("report_count")
    ).drop("_s")


def minute_pieces(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Rows of one minute as one piece, so that a window over a busy key is bounded by minutes, not rows."""
    minute = F.date_trunc("minute", time).cast("timestamp_ntz")
    return rows.groupBy(key, minute.alias("_m")).agg(
        F.min(time).alias("start_dt"), F.max(time).alias("end_dt"), F.count(F.lit(1)).alias("report_count")
    ).drop("_m")


def sessions_sink(
    path: str, key: str = "grid_cell", gap_minutes: int = 15, time: str = "ts", lateness_minutes: int = 120
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: closed sessions are emitted once, late rows go to a table of their own.

    The watermark is the latest time of earlier batches less the lateness. Rows at or ahead of it extend the sessions that
    are open; what then ends more than the gap behind the new watermark is closed and not touched again. Rows behind the
    watermark are late. A batch reads its rows and the open sessions that the batch before left, nothing else, and writes
    folders of its own, so a retry repeats it. Rows without a time are left out; the gap is a minute or more.
    """
    if gap_minutes < 1:
        raise ValueError("the gap has to be a minute or more")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = lambda part, k=batch_id: f"{path}/{part}/batch_id={k}"
        rows = batch.select(key, F.col(time).cast("timestamp_ntz").alias(time)).filter(F.col(time).isNotNull())
        before = spark.read.parquet(at("mark", batch_id - 1)).first()["latest"] if batch_id else None
        back = F.make_dt_interval(mins=F.lit(lateness_minutes))
        behind = F.col(time) < F.lit(before).cast("timestamp_ntz") - back if before else F.lit(False)
        pieces = minute_pieces(rows.filter(~behind), key, time)
        if batch_id and complete(spark, at("open", batch_id - 1)):
            pieces = pieces.unionByName(spark.read.parquet(at("open", batch_id - 1)))
        latest = F.greatest(F.max(time), F.lit(before).cast("timestamp_ntz"))
        mark = rows.agg(latest.alias("latest"), F.count_if(behind).alias("late_rows"), F.count(F.lit(1)).alias("rows"))
        mark.write.mode("overwrite").parquet(at("mark"))
        now = spark.read.parquet(at("mark")).first()["latest"]
        folded = materialize(fold_sessions(pieces, key, gap_minutes))
        closed = F.col("end_dt") + F.make_dt_interval(mins=F.lit(gap_minutes)) <= F.lit(now).cast("timestamp_ntz") - back
        closed = closed if now else F.lit(False)
        folded.filter(closed).write.mode("overwrite").parquet(at("closed"))
        folded.filter(~closed).write.mode("overwrite").parquet(at("open"))
        minute_pieces(rows.filter(behind), key, time).write.mode("overwrite").parquet(at("late"))
        if batch_id > 1:
            remove(spark, at("open", batch_id - 2))

    return write


def read_sessions(spark: SparkSession, path: str, key: str = "grid_cell", gap_minutes: int = 15, state: str = "state") -> DataFrame:
    """All sessions with their ``state`` (open or closed); keys with late rows are folded anew, all others are as emitted."""
    last = max(r["batch_id"] for r in spark.read.parquet(f"{path}/mark").select("batch_id").distinct().collect())
    part = lambda name: spark.read.parquet(f"{path}/{name}").drop("batch_id")
    late = part("late")
    still = spark.read.parquet(f"{path}/open/batch_id={last}")
    emitted = part("closed").withColumn(state, F.lit("closed")).unionByName(still.withColumn(state, F.lit("open")))
    keys = late.select(key).distinct()
    whole = emitted.join(keys, key, "left_anti")
    pieces = emitted.join(keys, key, "left_semi").unionByName(late.withColumn(state, F.lit("closed")))
    ends = pieces.filter(F.col(state) == "open").groupBy(key).agg(F.min("start_dt").alias("_open"))
    again = fold_sessions(pieces.drop(state), key, gap_minutes).join(ends, key, "left")
    marked = again.withColumn(state, F.when(F.col("end_dt") >= F.col("_open"), "open").otherwise("closed")).drop("_open")
    return whole.unionByName(marked)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, latest, late_rows, rows), a row per batch."""
    return spark.read.parquet(f"{path}/mark")
