import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tests.helpers import scored, t, value
from zonecast.operators import models, ranker


def plain_ndcg(rows, k=None):
    groups = {}
    for time, zone, score, actual in rows:
        groups.setdefault(time, []).append((-score, zone, actual))
    out = []
    for g in groups.values():
        labels = [y for *_, y in sorted(g)]
        if sum(labels):
            n = k or len(labels)
            dcg = sum(y / math.log2(i + 2) for i, y in enumerate(labels[:n]))
            out.append(dcg / sum(1 / math.log2(i + 2) for i in range(min(sum(labels), n))))
    return sum(out) / len(out)


def made_up(n=12, seed=1):
    rng = random.Random(seed)
    return [(f"2026-06-01 {h:02d}:00:00", f"z{z:02d}", rng.randint(0, 5) / 5, int(rng.random() < 0.2)) for h in range(n) for z in range(15)]


@pytest.mark.parametrize("k", [None, 3])
def test_ndcg(spark, k):
    rows = made_up()
    assert ranker.ndcg(scored(spark, rows), k).first().ndcg == pytest.approx(plain_ndcg(rows, k))
    assert value(ranker.ndcg(scored(spark, [(*r[:3], 0) for r in rows[:5]]), k).select("ndcg")) == 0.0


def test_pairs_weigh_what_a_swap_changes(spark):
    rows = made_up(6, 2)
    got = {(str(r.target_time), r.positive, r.negative): r.weight for r in ranker.ranked_pairs(scored(spark, rows), "actual", [-F.col("score")], 4).collect()}
    want = {}
    for time in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == time), key=lambda r: (-r[2], r[1]))
        positives = [i for i, r in enumerate(order) if r[3]]
        for p in positives:
            for q in [i for i, r in enumerate(order) if not r[3]][:4]:
                swapped = [*order]
                swapped[p], swapped[q] = ((*order[p][:3], 0), (*order[q][:3], 1))
                dcg = lambda rs: sum(r[3] / math.log2(i + 2) for i, r in enumerate(rs))
                best = sum(1 / math.log2(i + 2) for i in range(len(positives)))
                want[time, order[p][1], order[q][1]] = abs(dcg(order) - dcg(swapped)) / best
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_groups_without_a_positive_or_a_negative_teach_nothing(spark):
    rows = [("2026-06-01 11:00:00", "a", 0.1, 0), ("2026-06-01 10:00:00", "a", 0.9, 1), ("2026-06-01 10:00:00", "b", 0.8, 0), ("2026-06-01 12:00:00", "a", 0.7, 1)]
    pairs = ranker.ranked_pairs(scored(spark, rows), "actual", [-F.col("score")]).collect()
    assert [(r.target_time, r.positive, r.negative) for r in pairs] == [(t("2026-06-01 10:00:00"), "a", "b")]
    lonely = VectorAssembler(inputCols=["score"], outputCol="features").transform(scored(spark, rows[:1] + rows[3:]))
    assert ranker.fit_ranker(lonely, "actual") is None


def test_ranker_beats_the_balanced_logistic_on_a_planted_order(spark):
    """Both features carry the level of their hour, which hides the order from a model that looks at single rows."""
    rng = random.Random(7)
    rows = []
    for h in range(80):
        level, zones = rng.gauss(0, 5), [(rng.random(), rng.random()) for _ in range(30)]
        best = sorted(zones, reverse=True)[:3]
        rows += [(f"2026-06-{1 + h // 24:02d} {h % 24:02d}:00:00", f"z{i:02d}", level + u, level + v, int((u, v) in best)) for i, (u, v) in enumerate(zones)]
    df = scored(spark, rows, "target_time string, zone_id string, a double, b double, actual int")
    train, test = df.filter("target_time < '2026-06-03'"), df.filter("target_time >= '2026-06-03'")
    found = {}
    for name in ("logistic_balanced", "pairwise_ranker"):
        model, rate = models.fit(name, train, "actual", ["a", "b"], [])
        one = models.predict(model, test, ["a", "b"], rate)
        assert one.filter("score < 0 or score > 1 or score is null").count() == 0
        found[name] = ranker.ndcg(one).first().ndcg
    assert found["pairwise_ranker"] > 0.97 and found["pairwise_ranker"] > found["logistic_balanced"] + 0.05, found


def test_activity_stage_skips_rankers(spark):
    rows = [(f"2026-06-01 {h:02d}:00:00", h, h % 2) for h in range(12)]
    df = scored(spark, rows, "target_time string, x int, y int")
    got = models.evaluate_candidates(df, "y", ["x"], [], 60, ("pairwise_ranker", "prior"), 2, "activity")
    assert {r.model for r in got.collect()} == {"prior"}
