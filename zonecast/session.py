"""Session settings and the shared place for materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "zonecast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes.

    Adaptive execution chooses join strategies from measured sizes, so nothing in
    the package forces a broadcast of data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, else the context's.

    Only on a local master, where driver and executors are one process, a session with
    neither gets a temporary folder; elsewhere that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="zonecast-"))
    return context.getCheckpointDir()


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df: DataFrame) -> DataFrame:
    """Store as Parquet in the shared folder and read it back.

    Lineage ends at the files, which outlive executors; later readers fetch only the
    columns and row groups they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
