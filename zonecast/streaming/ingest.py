"""Structured Streaming versions of ingest, dedupe and windowed counts.

Event time must be a ``timestamp`` for watermarks, so wall clocks are cast under a
UTC session. Sinks are parquet folders laid out by batch id: a batch that is
retried after a failure overwrites its own folder and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from zonecast.operators.clean import REFRESHED, merge_partials, refresh_partials


def event_time(df: DataFrame, column: str, lateness: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def stream_dedupe(stream: DataFrame, key: str = "report_id") -> DataFrame:
    """First copy per id, however late it comes.

    Every id stays in the state store, as no age tells that an id will not return;
    set the RocksDB provider to keep that state on disk and its changes incremental.
    """
    return stream.dropDuplicates([key])


def _slot(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


#: Folders that the state of a refresh stream is dealt to by id.
BUCKETS = 16


def refresh_sink(path: str, log_path: str, tie: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of mergeable per-id states plus one log row per batch.

    State is append-only, in buckets by id: a batch reads only the ids of the buckets that it
    touches. Readers fold it with :func:`read_refreshed`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        bucket = F.pmod(F.xxhash64("report_id"), F.lit(BUCKETS)).cast("int")
        partials = refresh_partials(batch, tie=tie).withColumn("bucket", bucket)
        known = _states(spark, path, partials.schema, f"batch_id < {batch_id}")
        partials.write.mode("overwrite").partitionBy("bucket").parquet(_slot(path, batch_id))
        mine = spark.read.schema(partials.schema).parquet(_slot(path, batch_id)).select("report_id", "bucket")
        fresh = mine
        if known is not None:
            touched = [r["bucket"] for r in mine.select("bucket").distinct().collect()]
            seen = known.filter(F.col("bucket").isin(touched)).select("report_id")
            fresh = mine.join(seen, "report_id", "left_anti")
        row = batch.agg(
            F.count(F.lit(1)).alias("total_reports"), F.max("seen_at").alias("timestamp")
        ).withColumn("new_reports", fresh.agg(F.count(F.lit(1)).alias("n")).scalar())
        row.write.mode("overwrite").parquet(_slot(log_path, batch_id))
        batch.unpersist()

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a batch was written to the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(at) and len(files.listStatus(at)) > 0


def _states(spark: SparkSession, path: str, schema: StructType, where: str) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    return spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(path).filter(where)


def read_refreshed(spark: SparkSession, path: str, mutable: Sequence[str] = REFRESHED) -> DataFrame:
    """Current reports: all batch states folded per id."""
    return merge_partials(spark.read.parquet(path).drop("batch_id", "bucket"), mutable=mutable)


def read_batch_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.parquet(log_path)


def latest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer for update-mode aggregates, one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_slot(path, batch_id))

    return write


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key written by :func:`latest_sink`."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return (
        rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_r")).select(*keys, "_r.*")
    )


def zone_counts(
    stream: DataFrame, size: str = "1 hour", slide: str | None = None, time: str = "ts", lateness: str = "2 hours"
) -> DataFrame:
    """Tumbling or sliding event counts per zone, tolerating late events."""
    timed = event_time(stream, time, lateness)
    window: Column = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        timed.groupBy(window.alias("w"), "zone_id")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "zone_id",
            "event_count",
        )
    )


def stream_sessions(
    stream: DataFrame, key: str = "grid_cell", gap: str = "15 minutes", time: str = "ts", lateness: str = "2 hours"
) -> DataFrame:
    """Activity sessions per key, closed after a silent gap.

    In append mode a session is emitted once the watermark has passed it, and its state is dropped.
    """
    timed = event_time(stream, time, lateness)
    return (
        timed.groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("report_count"), F.max(time).alias("_last"))
        .select(
            key,
            F.col("w.start").cast("timestamp_ntz").alias("start_dt"),
            F.col("_last").cast("timestamp_ntz").alias("end_dt"),
            "report_count",
        )
    )


def run_available(
    df: DataFrame, checkpoint: str, mode: str = "append", path: str | None = None,
    each: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Process everything that has landed, then stop."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    query.awaitTermination()
