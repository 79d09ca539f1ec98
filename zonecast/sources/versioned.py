"""Tables that are replaced as a whole or by day while others read them.

Data goes to folders of its own first; then one small file, ``commits/<number>``, names the folders that make up the
new version. The file is created only if that number is free, so of two writers one has to look again, and a
reader sees the old version or the new one, never a mixture. A job that fails leaves folders that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DAY = "_day"
NO_DAY = "none"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, oldest first."""
    at, files = _fs(spark, f"{path}/commits")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    """A version's ``days``, each with its folder, and its ``schema``."""
    at, files = _fs(spark, f"{path}/commits/{version:012d}")
    stream = files.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> bool:
    """Create the version's file; False if another writer was first. The file is complete once it is named."""
    at, files = _fs(spark, f"{path}/commits/{version:012d}")
    temp, _ = _fs(spark, f"{path}/pending/{uuid.uuid4().hex}")
    stream = files.create(temp, False)
    stream.write(json.dumps(manifest, sort_keys=True).encode())
    stream.close()
    files.mkdirs(at.getParent())
    if files.exists(at) or not files.rename(temp, at):
        files.delete(temp, False)
        return False
    return True


def _write(df: DataFrame, path: str, day: Column) -> dict[str, str]:
    """Write rows by day into a fresh folder; the folder of each day that has rows."""
    spark = df.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    value = F.coalesce(F.to_date(day).cast("string"), F.lit(NO_DAY))
    df.withColumn(DAY, value).write.partitionBy(DAY).parquet(f"{path}/{folder}")
    at, files = _fs(spark, f"{path}/{folder}")
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names if n.startswith(f"{DAY}=")}


def replace_table(df: DataFrame, path: str, day: Column) -> int:
    """Make ``df`` the whole table; the number of the new version."""
    return _publish(df, path, day, lambda old, new: new)


def replace_days(df: DataFrame, path: str, day: Column, also: tuple[str, ...] = ()) -> int:
    """Replace the days that ``df`` has rows of, and empty the days in ``also``; all other days stay as they are.

    Another writer's days that were committed in between are kept.
    """
    return _publish(df, path, day, lambda old, new: {d: f for d, f in old.items() if d not in also} | new)


def _publish(df: DataFrame, path: str, day: Column, merged) -> int:
    spark = df.sparkSession
    schema = json.loads(df.schema.json())
    new = _write(df, path, day)
    while True:
        last = (versions(spark, path) or [0])[-1]
        old = _manifest(spark, path, last)["days"] if last else {}
        if _commit(spark, path, last + 1, {"days": merged(old, new), "schema": schema}):
            return last + 1


def read_version(
    spark: SparkSession, path: str, version: int | None = None, days: Collection[str] | None = None
) -> DataFrame:
    """Rows of the newest version, or of an older one that is still there; of some ``days`` only, no others are read."""
    found = versions(spark, path)
    if version is None and not found:
        raise FileNotFoundError(f"no version was committed to {path}")
    content = _manifest(spark, path, found[-1] if version is None else version)
    schema = StructType.fromJson(content["schema"])
    folders = [f"{path}/{f}" for d, f in content["days"].items() if days is None or d in days]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def remove_old(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions and the folders that only they name; number of folders deleted.

    Run it while nobody writes: folders of a job that has not committed yet belong to no version.
    """
    found = versions(spark, path)
    used = {f.rsplit("/", 1)[0] for v in found[-keep:] for f in _manifest(spark, path, v)["days"].values()}
    for v in found[:-keep]:
        at, files = _fs(spark, f"{path}/commits/{v:012d}")
        files.delete(at, False)
    at, files = _fs(spark, f"{path}/data")
    gone = [s.getPath() for s in files.listStatus(at) if f"data/{s.getPath().getName()}" not in used] if files.exists(at) else []
    for folder in gone:
        files.delete(folder, True)
    return len(gone)
