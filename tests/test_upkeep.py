import datetime as dt
import random

import pytest

from tests.helpers import t
from zonecast import scale
from zonecast.operators import clean
from zonecast.plans import upkeep
from zonecast.session import materialize
from zonecast.sources import versioned

SCHEMA = "report_id string, lat double, lng double, address string, create_dt timestamp_ntz, upvote long, downvote long"


def made_up(n, seed, days=5):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        place, minute = rng.randint(0, 5), rng.choice([rng.randint(0, 1440 * days), 1440 * rng.randint(1, days - 1) + rng.randint(-25, 25)])
        at = t("2026-06-01 00:00:00") + dt.timedelta(minutes=minute, seconds=rng.randint(0, 59))
        out.append((f"r{k:04d}", 22.3 + 0.002 * place + rng.gauss(0, 0.0001), 114.1 + rng.gauss(0, 0.0001), f"a{k % 7}", at, rng.randint(0, 4), rng.randint(0, 2)))
    return out


def test_batches_in_any_cut_give_one_full_run(spark, tmp_path):
    rows = made_up(500, 3)
    random.Random(1).shuffle(rows)
    path, cuts = str(tmp_path / "c"), [0, 300, 310, 500]
    for a, b in zip(cuts, cuts[1:]):
        upkeep.update_clusters(spark.createDataFrame(rows[a:b], SCHEMA), path)
    whole = spark.createDataFrame(rows, SCHEMA)
    got = {(r.report_id, r.cluster_id) for r in upkeep.read_members(spark, path).collect()}
    assert got == {tuple(r) for r in clean.assign_clusters(whole).collect()} and len(got) == 500
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rounded(upkeep.read_events(spark, path)) == rounded(clean.consolidate_events(whole))


@pytest.mark.parametrize("links", [10**6, 0])
def test_component_labels(spark, links, monkeypatch):
    """A small graph takes two stored tables, however long its chains; rounds give the same."""
    made = []
    monkeypatch.setattr(scale, "LINKS", links)
    monkeypatch.setattr(scale, "materialize", lambda df: made.append(df) or materialize(df))
    pick = random.Random(4).sample(range(300), 300)
    chain = [(f"{pick[i]:03d}", f"{pick[i + 1]:03d}") for i in range(199)] + [("z1", "z2"), ("z2", "z1"), ("z1", "z1"), (None, "z1")]
    nodes = [(f"{k:03d}",) for k in range(300)] + [("z1",), ("z2",), ("z2",), (None,)]
    got = scale.component_labels(spark.createDataFrame(nodes, "node string"), spark.createDataFrame(chain, "a string, b string")).collect()
    least, held = f"{min(pick[:200]):03d}", {f"{k:03d}" for k in pick[:200]}
    want = {n: least if n in held else n for (n,) in nodes} | {"z2": "z1"}
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
    assert len(made) == 2 or links == 0
    alone = scale.component_labels(spark.createDataFrame(nodes[:3], "node string"), spark.createDataFrame([], "a string, b string"))
    assert {r.node: r.label for r in alone.collect()} == {n: n for (n,) in nodes[:3]}


def test_days_out_of_reach_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "c")
    upkeep.update_clusters(spark.createDataFrame(made_up(300, 4), SCHEMA), path)
    before = versioned._manifest(spark, path, 1)["days"]
    late = [("new1", 22.3, 114.1, "x", t("2026-06-04 12:00:00"), 1, 0), ("new2", 25.0, 114.1, "x", t("2026-06-04 12:05:00"), 1, 0)]
    assert upkeep.update_clusters(spark.createDataFrame(late, SCHEMA), path) == 2
    after = versioned._manifest(spark, path, 2)["days"]
    changed = {d for d in after if before.get(d) != after[d]}
    assert "2026-06-04" in changed and not changed & {"2026-06-01", "2026-06-02"} and len(changed) <= 3
    near = versioned.read_version(spark, path, days=changed)
    files = near.inputFiles()
    assert files and all(f.rsplit("/", 2)[1].split("=")[1] in changed for f in files)
