"""Small builders shared by the tests."""

import datetime as dt

from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp_ntz, lat double, lng double, zone_id string, grid_cell string, district string, region string, report_count long, total_upvotes long, total_downvotes long"


def t(text):
    return dt.datetime.fromisoformat(text)


def events(spark, rows):
    """(ts, zone, district) rows to an event table."""
    full = [
        (i, t(ts), 22.3, 114.1, zone, f"22.30{i % 3}_114.100", district, "R", 1, 2, 1)
        for i, (ts, zone, district) in enumerate(rows)
    ]
    return spark.createDataFrame(full, EVENT)


def scored(spark, rows, cols="target_time string, zone_id string, score double, actual int"):
    df = spark.createDataFrame(rows, cols)
    if "target_time" in df.columns:
        df = df.withColumn("target_time", F.col("target_time").try_cast("timestamp_ntz"))
    return df


def value(df):
    return df.collect()[0][-1]
