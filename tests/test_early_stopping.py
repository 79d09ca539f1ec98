import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import scored
from zonecast.operators import models, splits


def made_up(spark, n, noise, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.random(), rng.random()
        y = int((a > 0.5) != (rng.random() < noise))
        rows.append((f"2026-06-{1 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00", i, a, b, rng.choice("xy"), y))
    return scored(spark, rows, "target_time string, id long, a double, b double, c string, y int")


def test_rounds_end_where_the_validation_part_gains_nothing(spark):
    df = made_up(spark, 3000, 0.25)
    model, report = models.fit_boosted(df, "y", ["a", "b"], ["c"], ["target_time", "id"], max_rounds=40)
    row = report.first()
    assert (row.train_rows, row.validation_rows, row.test_rows) == (2400, 300, 300)
    trees = model.stages[-1]
    assert 0 < row.rounds == trees.getNumTrees < 40
    parts = splits.positional_split(models._doubles(df, ["a", "b"]), ["target_time", "id"])
    middle = parts.filter("role = 'validation'")
    for stage in model.stages[:-1]:
        middle = stage.transform(middle)
    balanced = models.with_class_weight(parts.filter("role <> 'test'"), "y").filter("role = 'validation'").select("id", "weight")
    losses = trees.evaluateEachIteration(middle.withColumn("y", F.col("y").cast("double")).join(balanced, "id").select("features", "y", "weight"))
    assert min(losses) == pytest.approx(losses[-1])
    last = models.predict(model, parts.filter("role = 'test'"), ["a", "b"]).select("score", "y").collect()
    said = [(r.score >= 0.5, r.y) for r in last]
    right = sum(s and y for s, y in said)
    assert row.precision == pytest.approx(right / sum(s for s, _ in said)) and row.recall == pytest.approx(right / sum(y for _, y in said))
    wins = [(p.score > q.score) + (p.score == q.score) / 2 for p in last if p.y for q in last if not q.y]
    assert row.roc_auc == pytest.approx(sum(wins) / len(wins)) and row.roc_auc > 0.65


def test_one_class_gives_no_model(spark):
    model, report = models.fit_boosted(made_up(spark, 50, 0).withColumn("y", F.lit(0)), "y", ["a", "b"], ["c"], ["target_time", "id"])
    row = report.first()
    assert model is None and (row.train_rows, row.test_rows, row.rounds, row.precision, row.roc_auc) == (40, 5, 0, 0.0, 0.0)
