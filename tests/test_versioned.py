import pytest
from pyspark.sql import functions as F

from tests.helpers import t
from zonecast.sources import versioned

SCHEMA = "id long, ts timestamp_ntz"


def table(spark, rows):
    return spark.createDataFrame([(i, t(f"2026-06-{d:02d} 10:00:00") if d else None) for i, d in rows], SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_failing_rebuild_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versioned.replace_table(table(spark, [(1, 1), (2, 2), (3, None)]), path, F.col("ts")) == 1
    before = versioned.read_version(spark, path)
    broken = table(spark, [(n, 1 + n % 20) for n in range(100)]).repartition(8).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="no"):
        versioned.replace_table(broken, path, F.col("ts"))
    assert ids(versioned.read_version(spark, path)) == ids(before) == [1, 2, 3] and versioned.versions(spark, path) == [1]
    assert versioned.replace_table(table(spark, [(9, 9)]), path, F.col("ts")) == 2
    assert ids(before) == [1, 2, 3] and ids(versioned.read_version(spark, path)) == [9] and ids(versioned.read_version(spark, path, 1)) == [1, 2, 3]


def test_days_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.replace_table(table(spark, [(1, 1), (2, 2), (3, 3), (4, None)]), path, F.col("ts"))
    versioned.replace_days(table(spark, [(20, 2), (21, 2), (50, 5)]), path, F.col("ts"), also=("2026-06-03",))
    new = versioned.read_version(spark, path)
    assert ids(new) == [1, 4, 20, 21, 50] and new.columns == ["id", "ts"]
    assert ids(versioned.read_version(spark, path, 1)) == [1, 2, 3, 4]
    versioned.replace_table(table(spark, []), path, F.col("ts"))
    assert ids(versioned.read_version(spark, path)) == []
    assert versioned.remove_old(spark, path, 2) == 1 and versioned.remove_old(spark, path, 1) == 2
    assert versioned.versions(spark, path) == [3] and ids(versioned.read_version(spark, path)) == []


def test_two_writers_both_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versioned.replace_table(table(spark, [(1, 1)]), path, F.col("ts"))
    real, calls = versioned._commit, []

    def between(spark_, path_, version, manifest):
        if not calls:
            calls.append(1)
            versioned.replace_days(table(spark, [(3, 3)]), path, F.col("ts"))
        return real(spark_, path_, version, manifest)

    monkeypatch.setattr(versioned, "_commit", between)
    assert versioned.replace_days(table(spark, [(2, 2)]), path, F.col("ts")) == 3
    assert ids(versioned.read_version(spark, path)) == [1, 2, 3]
    with pytest.raises(FileNotFoundError):
        versioned.read_version(spark, str(tmp_path / "none"))
