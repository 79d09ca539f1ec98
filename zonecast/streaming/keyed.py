"""Vote refresh as one keyed state: each id has a row in the state store, a batch reads and writes the ids it holds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators.clean import REFRESHED, combine_partials, merge_partials, refresh_aggregates
from zonecast.streaming.runs import WIDTH, add_run, read_runs


def refresh_states(
    stream: DataFrame, key: str = "report_id", mutable: Sequence[str] = REFRESHED, tie: Sequence[str] = ()
) -> DataFrame:
    """State of every id that a batch touches, for update mode, and one row for the batch itself.

    Copies are folded before the shuffle, so an id that fills a batch sends one row per task. A batch is told by its
    trigger time, which the offset log keeps and a retry repeats: an id is new if its first and last batch are one.
    The batch's row counts all rows, those without an id too. Ids never expire, as one may return at any age; the RocksDB provider
    keeps their states on disk and writes only changes.
    """
    has_id = F.col(key).isNotNull() & (F.col(key) != "")
    both = stream.withColumn("_batch", F.current_timestamp()).withColumn("_of_batch", F.explode(F.array(F.lit(True), F.lit(False))))
    named = both.filter(F.col("_of_batch") | has_id).withColumn("_name", F.when(F.col("_of_batch"), F.col("_batch").cast("string")).otherwise(F.col(key)))
    return named.groupBy("_of_batch", "_name").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.min("_batch").alias("_first_batch"),
        F.max("_batch").alias("_last_batch"),
        *refresh_aggregates(stream, key, mutable, tie),
    )


def states_sink(
    path: str, log_path: str, key: str = "report_id", mutable: Sequence[str] = REFRESHED, width: int = WIDTH
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer for :func:`refresh_states`: the states a batch changed, and a log row.

    Nothing that earlier batches wrote is read, but for the merge of ``width`` runs into one.
    """
    combine = lambda df: combine_partials(df, key, mutable)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        ids = batch.filter(~F.col("_of_batch"))
        row = batch.agg(
            F.coalesce(F.sum(F.when(F.col("_of_batch"), F.col("_copies"))), F.lit(0)).alias("total_reports"),
            F.max(F.when(F.col("_of_batch"), F.col("last_seen"))).alias("timestamp"),
            F.count_if(~F.col("_of_batch") & (F.col("_first_batch") == F.col("_last_batch"))).alias("new_reports"),
        ).withColumn("batch_id", F.lit(batch_id).cast("long"))
        states = ids.withColumnRenamed("_name", key).drop("_of_batch", "_copies", "_first_batch", "_last_batch")
        add_run(states, path, batch_id, combine, width)
        add_run(row, log_path, batch_id, lambda df: df.coalesce(1), width)
        batch.unpersist()

    return write


def read_current(
    spark: SparkSession, path: str, key: str = "report_id", mutable: Sequence[str] = REFRESHED, width: int = WIDTH
) -> DataFrame:
    """Current reports: the newest state of every id."""
    return merge_partials(read_runs(spark, path, width), key, mutable)


def read_log(spark: SparkSession, log_path: str, width: int = WIDTH) -> DataFrame:
    """(total_reports, timestamp, new_reports, batch_id), a row per batch."""
    return read_runs(spark, log_path, width)
