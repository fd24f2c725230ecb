"""Growing log files: appended, half-written, rewritten and long ones; restarts; spans and bounds."""

import json
import random

import pytest

from talkloom.sources import logs, tail


def line(n):
    return json.dumps({"type": "user", "uuid": str(n), "message": {"role": "user", "content": f"message {n}"}}) + "\n"


def uuids(rows):
    return [json.loads(r["value"])["uuid"] for r in sorted(rows, key=lambda r: (r["file"], r["generation"], r["start"]))]


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(tail.GrowingLines)


class Tail:
    """A stream over a folder that is started again for every look, as after a restart."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, {"journal": f"{folder}/../journal", **options}

    def look(self):
        stream = self.spark.readStream.format("growing_lines").option("path", f"{self.folder}").options(**self.options).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/../check").start(f"{self.folder}/../out")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return self.spark.read.parquet(f"{self.folder}/../out").collect()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path / "logs"


def test_appended_half_and_rewritten_lines(spark, folder):
    file, seen = folder / "s.jsonl", Tail(spark, folder)
    file.write_text(line(1) + line(2))
    assert uuids(seen.look()) == ["1", "2"]
    half = line(3)[:10]
    with file.open("a") as f:
        f.write(half)
    assert uuids(seen.look()) == ["1", "2"]  # not whole yet
    now = spark.read.format("growing_lines").option("path", str(folder)).load().collect()
    assert [(r["whole"], r["value"]) for r in now][-1] == (False, half) and len(now) == 3
    with file.open("a") as f:
        f.write(line(3)[10:] + "not json\n\n" + line(4))
    rows = seen.look()
    assert [r["value"] for r in rows].count("not json") == 1 and uuids([r for r in rows if r["value"][0] == "{"]) == ["1", "2", "3", "4"]  # never twice
    file.write_text(line(7) + line(8) + line(9))  # rewritten, shorter
    (folder / "t.jsonl").write_text(line(5))
    frame = spark.createDataFrame(seen.look())
    assert uuids(tail.latest_generation(frame).collect()) == ["7", "8", "9", "5"]
    file.write_text(line(7) * 40)  # rewritten, longer, another seam
    assert {r["generation"] for r in seen.look()} == {0, 1, 2}
    entries = logs.session_entries(frame.selectExpr("file", "start as line", "value")).collect()
    assert len(entries) == len([r for r in frame.collect() if r["value"] != "not json"])


def test_offsets_are_bounded_and_lines_come_once(folder):
    rng = random.Random(1)
    want = {}
    for name in ("a.jsonl", "sub/b.jsonl", "c.jsonl"):
        (folder / name).parent.mkdir(exist_ok=True)
        want[name] = [rng.choice(["x", "yyé" * rng.randint(1, 60), "z" * rng.randint(1, 2000)]) for _ in range(200)]
        (folder / name).write_text("".join(f"{v}\n" for v in want[name]))
    options = {"path": str(folder), "journal": f"{folder}/../j", "batchBytes": "5000", "taskBytes": "700"}
    start, got, sizes = {}, [], []
    for k in range(1000):
        # every other time as a reader that was started again
        reader = tail.LinesStreamReader(options) if k % 2 == 0 else reader
        end = reader.latestOffset()
        if end == start:
            break
        parts = reader.partitions(start, end)
        sizes.append(sum(p.end - p.start for p in parts))
        got += [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        start = end
    assert max(sizes) <= 5000 and all(r["whole"] for r in got)
    for name, values in want.items():
        assert [r["value"] for r in sorted((r for r in got if r["file"].endswith(name)), key=lambda r: r["start"])] == values


def test_a_line_longer_than_batches_and_tasks(folder):
    (folder / "a.jsonl").write_text("x" * 5000 + "\nshort\n" + "y" * 3000 + "\n")
    reader = tail.LinesStreamReader({"path": str(folder), "journal": f"{folder}/../j", "batchBytes": "100", "taskBytes": "64"})
    start, seen = {}, []
    while (end := reader.latestOffset()) != start:
        seen += [r["value"] for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        start = end
    assert [len(v) for v in seen] == [5000, 5, 3000]


def test_a_file_rewritten_while_a_batch_is_read(folder):
    file = folder / "a.jsonl"
    file.write_text(line(1) + line(2))
    reader = tail.LinesStreamReader({"path": str(folder), "journal": f"{folder}/../j"})
    end = reader.latestOffset()
    file.write_text(line(8) + line(9))
    read = lambda a, b: [json.loads(r["value"])["uuid"] for p in reader.partitions(a, b) for x in reader.read(p) for r in x.to_pylist()]
    assert read({}, end) == []
    later = reader.latestOffset()
    assert read(end, later) == ["8", "9"] and next(iter(later.values()))["generation"] == 1
    file.unlink()
    assert reader.latestOffset() == later and read(end, later) == []


def test_journals(folder):
    (folder / "a.jsonl").write_text(line(1))
    with pytest.raises(ValueError, match="journal"):
        tail.LinesStreamReader({"path": str(folder)})
    reader = tail.LinesStreamReader({"path": str(folder), "journal": f"{folder}/../j", "batchBytes": "1"})
    end = reader.latestOffset()
    (folder / "a.jsonl").write_text("")
    other = tail.LinesStreamReader({"path": str(folder), "journal": f"{folder}/../lost"})
    with pytest.raises(ValueError, match="lost"):
        other.partitions(end, other.latestOffset())


def test_empty_folder(spark, folder):
    assert spark.read.format("growing_lines").option("path", f"file://{folder}").load().count() == 0
