"""Archives as a data source: ranges, broken records, arrays, compression."""

import io
import json
import tarfile

from pitengine.sources import dumps as S


def archive(path, mode, **members):
    with tarfile.open(path, mode) as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))


def rows_of(df):
    return sorted(map(str, df.drop("archive").collect()))


def test_rows_do_not_depend_on_ranges(spark, tmp_path):
    record = lambda k: json.dumps({"id": f"e{k}", "name": "é" * (k % 50), "relations": [{"target-type": "artist", "artist": {"id": f"a{k % 3}"}}] * 2})
    lines = [record(k) if k % 10 else "{broken" if k % 20 else json.dumps({"name": "no id"}) for k in range(400)] + ["", "[1]", "  "]
    archive(tmp_path / "a.tar", "w", events="\n".join(lines), empty="", places=record(1000) + "\n\n" + record(1001) + "\n")
    whole = S.read_dump(spark, str(tmp_path / "a.tar"))
    want = rows_of(whole)
    assert len(want) == 403 and whole.where("problem IS NULL").count() == 362
    assert {(r.problem, r["count"]) for r in whole.groupBy("problem").count().collect()} == {(None, 362), ("BAD_JSON", 20), ("NO_ID", 20), ("NO_OBJECT", 1)}
    for size in (997, 4000):
        assert rows_of(S.read_dump(spark, f"file://{tmp_path}/a.tar", size)) == want
    (tmp_path / "few").mkdir()
    archive(tmp_path / "few" / "a.tar", "w", events="\n".join(lines[:6]) + "\n\n")
    want = rows_of(S.read_dump(spark, str(tmp_path / "few")))
    for size in (7, 30):
        assert rows_of(S.read_dump(spark, str(tmp_path / "few"), size)) == want and len(want) == 6
    assert {tuple(r.related) for r in whole.where("id = 'e4'").collect()} == {("a1",)}


def test_arrays_and_compressed_archives(spark, tmp_path):
    archive(tmp_path / "a.tar", "w", arr=json.dumps([{"id": "x"}, {"id": "y", "type": "T", "begin-date": "2020"}, 5]), bad="[{")
    archive(tmp_path / "b.tar.xz", "w:xz", lines='{"id": "z"}\n{"id": "w"}')
    got = S.read_dump(spark, str(tmp_path), 2).collect()
    assert sorted((str(r.id), r.problem) for r in got) == [("None", "BAD_JSON"), ("None", "NO_OBJECT"), ("w", None), ("x", None), ("y", None), ("z", None)]
    web = {"relation-list": [{"relations": [{"target-type": "artist", "artist": {"id": "q"}}, {"target-type": "url", "url": {"id": "u"}}]}]}
    assert S.related_ids(web, "artist") == ["q"] and S.related_ids(web) == ["q", "u"] and S.related_ids({"relations": 5}) == []


def test_written_archives_are_read_back(spark, tmp_path):
    rows = spark.range(1000).selectExpr("concat('k', id % 3) AS kind", "to_json(named_struct('id', cast(id AS string))) AS payload").repartition(4)
    for _ in range(2):  # again: the same archives
        wrote = S.write_dump(rows, str(tmp_path / "d"), 1000).collect()
    assert sum(r.records for r in wrote) == 1000 and sum(r.members for r in wrote) > 12
    back = S.read_dump(spark, str(tmp_path / "d"), 500)
    assert {int(r.id) for r in back.collect()} == set(range(1000)) and back.count() == 1000
    assert back.where("member NOT LIKE 'dump/k%'").count() == 0


def test_a_task_reads_neighbouring_ranges(spark, tmp_path, monkeypatch):
    """Small ranges make no task each: a task takes up to TASK_BYTES of an archive and hands on Arrow batches; each range is read once."""
    for name in ("a.tar", "b.tar"):
        archive(tmp_path / name, "w", **{f"m{k}": "\n".join(json.dumps({"id": f"{name}-{k}-{i}", "relations": [{"target-type": "x", "x": {"id": i + 1}}]}) for i in range(100)) for k in range(3)}, arr='[{"id": "z"}]')
    archive(tmp_path / "c.tar.gz", "w:gz", lines='{"id": "y"}')
    reader = S.DumpReader({"path": str(tmp_path), "rangebytes": "500"})
    assert len(reader.ranges()) > 60 and [len(t.ranges) for t in reader.partitions()] == [len(reader.ranges()) // 2] * 2 + [1]
    monkeypatch.setattr(S, "TASK_BYTES", 2000)
    tasks = reader.partitions()
    assert [r for t in tasks for r in t.ranges] == reader.ranges() and 20 < len(tasks) < 40
    assert all(len({r.archive for r in t.ranges}) == 1 for t in tasks)
    monkeypatch.setattr(S, "BATCH_RECORDS", 7)
    batches = [b for t in tasks for b in reader.read(t)]
    assert all(isinstance(b, S.pa.RecordBatch) and 0 < b.num_rows <= 7 for b in batches)
    rows = [r for b in batches for r in b.to_pylist()]
    assert sorted(r["id"] for r in rows) == sorted([f"{n}.tar-{k}-{i}" for n in "ab" for k in range(3) for i in range(100)] + ["z", "z", "y"])
    assert all(r["related"] == [str(int(r["id"].split("-")[2]) + 1)] for r in rows if "-" in r["id"])
    assert S.read_dump(spark, str(tmp_path), 500).count() == 603
