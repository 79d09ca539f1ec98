"""District reference points of the default region, as row-wise expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# District, region, latitude, longitude.
STATIONS = (
    ("Central & Western", "Hong Kong Island", 22.2816, 114.1585),
    ("Wan Chai", "Hong Kong Island", 22.2780, 114.1720),
    ("Eastern", "Hong Kong Island", 22.2870, 114.2190),
    ("Southern", "Hong Kong Island", 22.2470, 114.1580),
    ("Yau Tsim Mong", "Kowloon West", 22.3193, 114.1694),
    ("Sham Shui Po", "Kowloon West", 22.3310, 114.1590),
    ("Kowloon City", "Kowloon West", 22.3280, 114.1870),
    ("Wong Tai Sin", "Kowloon East", 22.3420, 114.1930),
    ("Kwun Tong", "Kowloon East", 22.3130, 114.2250),
    ("Tsuen Wan", "New Territories South", 22.3710, 114.1140),
    ("Kwai Tsing", "New Territories South", 22.3560, 114.1300),
    ("Sha Tin", "New Territories South", 22.3810, 114.1880),
    ("Sai Kung", "New Territories South", 22.3170, 114.2590),
    ("Islands", "New Territories South", 22.3080, 113.9185),
    ("Tuen Mun", "New Territories North", 22.3910, 113.9770),
    ("Yuen Long", "New Territories North", 22.4440, 114.0220),
    ("North", "New Territories North", 22.5030, 114.1280),
    ("Tai Po", "New Territories North", 22.4510, 114.1680),
)

# Districts flagged as urban core by default.
URBAN_CORE = (
    "Central",
    "Wan Chai",
    "Eastern",
    "Yau Tsim",
    "Mong Kok",
    "Sham Shui Po",
    "Kowloon City",
    "Kwun Tong",
)


def with_nearest_station(df: DataFrame, lat: str = "lat", lng: str = "lng", stations=STATIONS) -> DataFrame:
    """Add ``district`` and ``region`` of the nearest reference point, the first on ties.

    A constant list needs no join. Points are compared by the squared chord between
    unit vectors, which orders them like the great-circle distance but needs the
    row's sines and cosines only once.
    """
    phi, lam = F.radians(lat), F.radians(lng)
    axis = lambda c: F.coalesce(c, F.lit(0.0))
    vectors = df.withColumns(
        {"_ux": axis(F.cos(phi) * F.cos(lam)), "_uy": axis(F.cos(phi) * F.sin(lam)), "_uz": axis(F.sin(phi))}
    )
    table = []
    for i, (_, _, y, x) in enumerate(stations):
        p, m = math.radians(y), math.radians(x)
        parts = (math.cos(p) * math.cos(m), math.cos(p) * math.sin(m), math.sin(p))
        table.append(F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", parts)], F.lit(i).alias("i")))

    def chord(s):
        gaps = [F.col(f"_u{c}") - s[c] for c in "xyz"]
        return F.struct(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]).alias("d"), s["i"].alias("i"))

    # One lambda over a literal array keeps the expression small wherever a later
    # filter on the district is pushed down through it.
    placed = vectors.withColumn("_at", F.array_min(F.transform(F.array(*table), chord))["i"])
    # Null exactly where a coordinate is, which the optimizer can tell: a join on the district asks each row whether it
    # has one, and that question must not compare the row with all reference points again.
    known = F.col(lat).isNotNull() & F.col(lng).isNotNull()
    named = lambda i: F.get(F.array(*[F.lit(s[i]) for s in stations]), F.col("_at"))
    pick = lambda i: F.when(known, F.coalesce(named(i), F.lit("")))
    return placed.withColumns({"district": pick(0), "region": pick(1)}).drop(
        "_ux", "_uy", "_uz", "_at"
    )
