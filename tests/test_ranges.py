import json
import random

import pyarrow as pa
import pytest

from zonecast.sources import archive, ranges


@pytest.fixture
def cut_at(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


ODD = ['plain', 'a } b { c', 'say \\"}{\\" x', '\\\\', 'end \\\\"}', '{"alerts": {"x": {}}}', "", "é }🙂{", "line\\n}", '\\"', '}' * 30, '","k":{"lat":"1"}']


def written(folder, n, seed=1, **dump):
    rng = random.Random(seed)
    folder.mkdir()
    for f in range(3):
        records = {
            f"{f}-{i}{rng.choice(['', '}', '{', chr(34)])}": {
                "alert_record_id": rng.choice([None, f"r{f}-{i}"]), "lat": str(22 + i / 1000), "lng": "114.1", "address": rng.choice(ODD),
                "alert_type": "x", "create_dt": "2026-06-01 10:00:00", "upvote": str(i), "more": {"deep": {"deeper": [1, {"a": "}"}]}},
            }
            for i in range(n)
        }
        content = {"meta": {"v": 1, "alerts": {"no": {"lat": "9"}}}, "alerts": records, "after": {"k": {"lat": "8"}, "t": "}"}}
        (folder / f"{f}.json").write_text(json.dumps(content, ensure_ascii=False, **dump) + "\n" * f, encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize("size", [67, 1000])
def test_any_cut_reads_the_same(spark, tmp_path, cut_at, size):
    n = 4 if size < 1000 else 60
    for k, dump in enumerate(({"indent": 1}, {"separators": (",", ":")})):
        path = written(tmp_path / f"a{k}", n, k, **dump)
        want = sorted(map(tuple, archive.read_report_archive(spark, path).collect()), key=str)
        assert len(want) == 3 * n
        cut_at(size)
        assert sorted(map(tuple, ranges.read_report_ranges(spark, path).collect()), key=str) == want
        cut_at(1 << 27)


@pytest.mark.parametrize("size", [50, 1 << 27])
def test_a_file_that_breaks_off_keeps_its_whole_entries(spark, tmp_path, cut_at, size):
    records = {f"k{i}": {"lat": str(i), "address": ODD[i % len(ODD)]} for i in range(20)}
    text = json.dumps({"alerts": records}, ensure_ascii=False)
    for k, keep in enumerate((text.index('"k15"') + 20, text.index('"k15"'), text.index('"k15"') + 3)):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "cut.json").write_text(text[:keep], encoding="utf-8")
        cut_at(size)
        got = ranges.archive_segments(spark, str(tmp_path / f"{k}")).collect()
        assert sorted(r.data.decode().lstrip(", ").split('"')[1] for r in got if r.whole) == sorted(f"k{i}" for i in range(15))
        assert len([r for r in got if not r.whole]) == 1


def test_one_large_archive_is_read_by_many_tasks(spark, tmp_path, cut_at):
    record = json.dumps({"lat": "22.3", "lng": "114.1", "address": 'corner of "A} street" {' + "x" * 400, "upvote": "3"})
    n = 400_000
    with open(tmp_path / "large.json", "w") as file:
        file.write('{"alerts":{')
        for i in range(0, n, 1000):
            file.write(("," if i else "") + ",".join(f'"{j}":{record}' for j in range(i, i + 1000)))
        file.write("}}")
    assert (tmp_path / "large.json").stat().st_size > 190_000_000
    cut_at(8 << 20)
    path = str(tmp_path)
    assert ranges._pieces(spark, path).rdd.getNumPartitions() > 20
    row = ranges.read_report_ranges(spark, path).selectExpr("count(*) n", "count(DISTINCT report_id) ids", "sum(upvote) up").first()
    assert (row.n, row.ids, row.up) == (n, n, 3 * n)


def test_files_without_the_section(spark, tmp_path):
    for name, text in (("a", "{}"), ("b", '{"other": {"k": {"lat": "1"}}}'), ("c", ""), ("d", '{"alerts": {}}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert ranges.read_report_ranges(spark, str(tmp_path)).count() == 0


def test_first_range_of_a_file_is_noted_from_outside_of_a_text_only():
    piece = b'{"alerts":{"a":{"x":"1"'
    batch = lambda start: pa.RecordBatch.from_pylist([{"file": "f", "start": start, "size": 90, "data": piece}])
    inside = lambda start: [n["inside"] for b in ranges._note(iter([batch(start)])) for n in b.to_pylist()]
    assert inside(0) == [False]
    assert inside(50) == [False, True]
