"""Kept state: answers worked out once, files written once, sessions last seen, ends of files, hooks over candidates."""

import random
import time

import pytest
from pyspark.sql import functions as F

from talkloom.operators import retrieval
from talkloom.sources import files, once, tail
from talkloom.streaming import seen

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_answers_are_worked_out_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/answers", []

    def work(rows):
        calls.append(sorted(r["k"] for r in rows.collect()))
        return rows.where("k <> 3").select("t", "k", F.concat(F.lit("answer "), "k").alias("text"))

    ask = lambda keys, batch: {(r["t"], r["k"]): r["text"] for r in once.answered_once(spark.createDataFrame([("t", k) for k in keys], "t string, k int"), path, key=["t", "k"], answer="text", work=work, batch=batch).collect()}
    assert ask([1, 2, 3, 1, None], "a") == {("t", 1): "answer 1", ("t", 2): "answer 2", ("t", 3): ""}
    assert calls == [[1, 2, 3]]
    assert ask([1, 3], "b") == ask([2], "a") and calls == [[1, 2, 3]]  # nothing is new; a batch again
    assert ask([2, 4], "c")[("t", 4)] == "answer 4" and calls == [[1, 2, 3], [4]]
    (tmp_path / "answers" / "batch=c" / "_SUCCESS").unlink()  # as if the run had died
    assert ("t", 4) in ask([4], "c") and calls[-1] == [4]
    assert len(ask([], "d")) == 4


def test_files_are_written_when_they_change(spark, tmp_path):
    out, kept = f"file://{tmp_path}/out", f"file://{tmp_path}/manifest"
    rows = lambda *r: spark.createDataFrame(list(r), "file string, content string").repartition(3)
    put = lambda *r: files.write_changed(rows(*r), out, kept)
    assert put(("a/turn-1.md", "one"), ("index.md", "é"), ("none.md", None), (None, "x")) == 3
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.md")}
    assert put(("a/turn-1.md", "one"), ("index.md", "new"), ("index.md", "a")) == 1
    assert put(("a/turn-1.md", "one"), ("index.md", "new")) == 0
    now = {p: p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert {p.name: t for p, t in now.items()} == {"turn-1.md": "one", "index.md": "new", "none.md": ""}  # no temporary file is left
    assert {p.name for p in now if p.stat().st_mtime_ns != stamps[p]} == {"index.md"}
    with pytest.raises(Exception, match="outside the folder"):
        put(("../up.md", "x"))
    assert put(("c.md", "kept")) == 1 and not (tmp_path / "up.md").exists()


def test_an_aborted_job_leaves_no_file(tmp_path):
    writer = files.FilesWriter({"path": str(tmp_path)})
    said = [writer.write(iter([{"file": f"{n}.md", "content": "x"}])) for n in "ab"]
    assert len(list(tmp_path.iterdir())) == 2 and all(p.name.startswith(".") for p in tmp_path.iterdir())
    writer.abort([*said, None])
    assert list(tmp_path.iterdir()) == []


def test_sessions_are_recorded_with_quiet_times(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for s in ["a", "b", "c"]:
        at = 0
        for _ in range(60):
            at += rng.choice([10, 5_000, 29_999, 30_000, 61_000])
            rows.append((s, at, rng.choice(["m", "m", "m", "n", None]), rng.choice([None, "/x", "/y"]), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "session string, at long, mode string, cwd string, has_file boolean")
    want = []
    for s in "abc":
        last = None
        for _, at, mode, cwd, has in (r for r in rows if r[0] == s):
            if last and last[1] == mode and at - last[0] < 30_000 and not (has and not last[2]):
                continue
            last = (at, mode, (last and last[2]) or (cwd if has else None))
            want.append((s, *last))
    assert sorted(map(tuple, seen.recorded(df).collect()), key=repr) == sorted(want, key=repr)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = lambda: seen.recorded_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
        for low in (0, 300_000, 900_000):
            df.where((F.col("at") >= low) & (F.col("at") < {0: 300_000, 300_000: 900_000}.get(low, 1 << 50))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query = stream().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").start(f"{tmp_path}/out")
            end = time.time() + 60  # batches without rows go on for the times to live, so the query is never idle
            while time.time() < end and not any(p["numInputRows"] for p in query.recentProgress):
                time.sleep(0.3)
            query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("session", "at", "mode", "cwd").collect()), key=repr) == sorted(want, key=repr)


def test_newest_sessions_stay_few(spark, tmp_path):
    rows = [(f"s{i % 40}", i, "m", None) for i in range(100)]
    df = spark.createDataFrame(rows, "session string, at long, mode string, cwd string")
    want = [(f"s{i % 40}", i) for i in range(99, 89, -1)]
    assert [(r["session"], r["at"]) for r in seen.newest(df, 10).collect()] == want
    for low in (0, 50):
        df.where((F.col("at") >= low) & (F.col("at") < low + 50)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = seen.keep_newest(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/top", f"{tmp_path}/check", 10)
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(f"{tmp_path}/top/version={low // 50}").count() == 10
    assert {(r["session"], r["at"]) for r in spark.read.parquet(f"{tmp_path}/top/version=1").collect()} == set(want)


def test_ends_of_files(spark, tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text('{"cwd":"/home/é","n":1}\n{"cwd":"/later"}\n' + "x" * 500 + '\n{"aiTitle":"a \\"name\\""}\n')
    (tmp_path / "b.jsonl").write_text('{"type":"user"}\n')
    (tmp_path / "empty.jsonl").write_text("")
    spark.dataSource.register(tail.FileEnds)
    frame = spark.read.format("file_ends").option("path", f"{tmp_path}").option("headBytes", "60").option("tailBytes", "40").option("files", "1").load()
    got = {r["file"].rsplit("/", 1)[1]: r for r in frame.select("*", tail.folder_of().alias("cwd"), tail.title_of().alias("title")).collect()}
    assert (got["a.jsonl"]["cwd"], got["a.jsonl"]["title"]) == ("/home/é", 'a \\"name\\"') and (got["b.jsonl"]["cwd"], got["b.jsonl"]["title"]) == (None, None)
    assert all(len(r["head"].encode()) <= 60 and len(r["tail"].encode()) <= 40 for r in got.values()) and got["empty.jsonl"]["size"] == 0
    # of a large file only its ends are read
    read = []
    real = tail.Files.span
    monkeypatch.setattr(tail.Files, "span", lambda self, file, a, b: read.append(len(out := real(self, file, a, b))) or out)
    (tmp_path / "p" / "a.jsonl").write_text("y" * 1_000_000)
    reader = tail.EndsReader({"path": str(tmp_path / "p")})
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 1 and sum(read) <= tail.HEAD_BYTES + tail.TAIL_BYTES


def test_hooks_reorder_and_fall_back(spark):
    hits = spark.createDataFrame([(q, i, (q or 0) * 10 + i) for q in (1, 2, 3, None) for i in range(1, 9)], "q int, rank int, d int")

    def hook(q, found):
        if q == 2:
            raise RuntimeError
        return [999, found[3], found[3], found[1]]

    got = {}
    for r in retrieval.reranked(hits, hook, query_id="q", key=["d"], candidates=6, keep=4).collect():
        got.setdefault(r["q"], {})[r["rank"]] = (r["d"], r["reranked"])
    assert got[1] == {1: (14, True), 2: (12, True), 3: (11, True), 4: (13, True)}
    assert got[2] == {k: (20 + k, False) for k in range(1, 5)} and [got[None][k][0] for k in range(1, 5)] == [4, 2, 1, 3]
    pairs = retrieval.reranked(hits.withColumn("e", F.col("d") + 1), lambda q, found: found[::-1], query_id="q", key=["d", "e"], candidates=3).where("q = 3").orderBy("rank").collect()
    assert [(r["d"], r["e"]) for r in pairs] == [(33, 34), (32, 33), (31, 32)]


def test_recall_with_a_hook(spark):
    chunks = spark.createDataFrame([(i, i, None, f"call {i}", [f"alpha beta {'gamma ' * i}"]) for i in range(5)], "chunk int, turn int, source string, call string, lines array<string>")
    prompts = spark.createDataFrame([(1, "alpha beta gamma")], "p int, prompt string")
    ask = lambda **more: retrieval.recall(prompts, chunks, prompt_id="p", prompt="prompt", per_query=2, **more).first()["text"]
    assert "call 0" in ask(rerank=lambda line, found: [0, 1] if line == "alpha beta gamma" else []) and "call 4" not in ask(rerank=lambda line, found: [0, 1])
    assert ask(rerank=lambda line, found: 1 / 0) == ask()
