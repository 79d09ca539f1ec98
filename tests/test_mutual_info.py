import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecast.operators import mutual_info
from zonecast.operators.mutual_info import nearest_mutual_info

EULER = 0.5772156649015329


def psi(m):
    return sum(1 / j for j in range(1, m)) - EULER


def spread(x, feature, key):
    size = 2.0 ** (math.ceil(math.log2(max(1.0, np.mean(np.abs(x))))) - 33)
    draw = np.array([int(hashlib.md5(f"{feature}|{k}".encode()).hexdigest()[:8], 16) for k in key])
    return x + (draw / 2.0**31 - 1) * size


def plain(rows, feature, k=3):
    """All distances of all rows."""
    rows = [r for r in rows if r["y"] is not None]
    x = np.array([np.nan if r[feature] is None else r[feature] for r in rows], float)
    if np.isnan(x).all():
        return None
    x = spread(np.where(np.isnan(x), np.nanmedian(x), x), feature, [r["id"] for r in rows])
    y = np.array([r["y"] for r in rows])
    fine = np.isin(y, [c for c in set(y.tolist()) if (y == c).sum() > 1])
    x, y = x[fine], y[fine]
    total = 0.0
    for i in range(len(x)):
        own = np.sort(np.abs(x[y == y[i]] - x[i]))
        n = len(own)
        near = min(k, n - 1)
        r = own[near] * (1 - 2.0**-40)
        total += psi(near) - psi(n) - psi(int(((x >= x[i] - r) & (x <= x[i] + r)).sum()))
    return max(0.0, psi(len(x)) + total / len(x))


def made_up(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.05) if rng.random() < 0.98 else None
        out.append(
            {
                "id": i, "near": rng.gauss(2 * (y or 0), 1), "noise": rng.random() * 1000, "count": float(min(rng.randint(0, 4) * rng.randint(0, 1) + (y or 0), 4)),
                "gaps": None if rng.random() < 0.3 else rng.gauss(0, 1), "none": None, "same": 7.0, "y": 2 if i == 5 else y,
            }
        )
    return out


SCHEMA = "id long, near double, noise double, count double, gaps double, none double, same double, y int"


@pytest.mark.parametrize(("n", "block"), [(5_000, 300), (700, 7)])
def test_equals_all_distances(spark, n, block):
    rows = made_up(n)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    features = ["near", "noise", "count", "gaps", "none", "same"]
    got = {r.feature: r.mutual_info for r in nearest_mutual_info(df, features, "y", ["id"], 3, block).collect()}
    assert set(got) == set(features) - {"none"}
    for f in got:
        assert got[f] == pytest.approx(plain(rows, f), abs=1e-9), f
    assert got["near"] > 0.03 and got["noise"] < 0.02


def test_few_rows_and_labels(spark):
    rows = [{"id": i, "near": float(i), "noise": float(-i), "count": 0.0, "gaps": None, "none": None, "same": 1.0, "y": y} for i, y in enumerate([0, 0, 1, 1, 1, 3])]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = {r.feature: r.mutual_info for r in nearest_mutual_info(df, ["near", "count"], "y", ["id"]).collect()}
    assert got == {f: pytest.approx(plain(rows, f), abs=1e-9) for f in ("near", "count")}
    assert nearest_mutual_info(df.limit(0), ["near"], "y", ["id"]).count() == 0
    assert nearest_mutual_info(df.limit(1), ["near"], "y", ["id"]).count() == 0


def test_digamma(spark):
    got = spark.createDataFrame([(float(m),) for m in (1, 2, 3, 10, 500)], "m double").select("m", mutual_info.digamma(F.col("m")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(int(r.m)), abs=1e-10) for r in got)
