"""Tables that a stream adds to batch by batch, merged so that a reader never meets many small parts.

Each batch writes a run of level 0. When ``WIDTH`` runs of a level are complete, they are combined into one of the next,
so that a row is rewritten once a level and a reader finds at most ``WIDTH`` runs of each. Names follow from batch ids:
a retried batch overwrites its own runs. A run counts once Spark has marked it complete. What went into a merged run
stays until the next merge of that size two levels above, for retries and for readers that began before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

WIDTH = 8


def _at(path: str, level: int, index: int) -> str:
    return f"{path}/level={level}/run={index}"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def _listed(spark: SparkSession, path: str) -> list[str]:
    at, files = _files(spark, path)
    return [status.getPath().getName() for status in files.listStatus(at)] if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


def add_run(df: DataFrame, path: str, batch_id: int, combine: Callable[[DataFrame], DataFrame], width: int = WIDTH) -> None:
    """Write a batch's rows and merge the levels that it completes. ``combine`` gives rows of the same columns."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(_at(path, 0, batch_id))
    level, done = 0, batch_id + 1
    while done % width == 0:
        done //= width
        parts = [_at(path, level, i) for i in range((done - 1) * width, done * width)]
        parts = [p for p in parts if complete(spark, p)]
        combine(spark.read.schema(df.schema).parquet(*parts)).write.mode("overwrite").parquet(_at(path, level + 1, done - 1))
        if level and done > 1:
            for i in range((done - 2) * width * width, (done - 1) * width * width):
                remove(spark, _at(path, level - 1, i))
        level += 1


def current_runs(spark: SparkSession, path: str, width: int = WIDTH) -> list[str]:
    """Complete runs that no complete run above covers."""
    levels = sorted((int(name.split("=")[1]) for name in _listed(spark, path) if name.startswith("level=")), reverse=True)
    covered: set[tuple[int, int]] = set()
    out = []
    for level in levels:
        for name in _listed(spark, f"{path}/level={level}"):
            index = int(name.split("=")[1])
            if any((up, index // width ** (up - level)) in covered for up in levels if up > level) or not complete(spark, _at(path, level, index)):
                continue
            covered.add((level, index))
            out.append(_at(path, level, index))
    return sorted(out)


def read_runs(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """Rows of all batches, combined as far as merging went."""
    return spark.read.parquet(*current_runs(spark, path, width))
