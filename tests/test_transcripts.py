"""Log entries to rendered turns, and short turns, on hand-made logs."""

import json

from pyspark.sql import functions as F

from talkloom.operators import reduction, render, transcripts, turns
from talkloom.sources import logs


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}, "timestamp": "2026-01-02T03:04:05Z", **more}


def agent(*blocks):
    return {"type": "assistant", "message": {"role": "assistant", "content": list(blocks)}}


def said(text):
    return {"type": "text", "text": text}


def call(id_, **input_):
    return {"type": "tool_use", "id": id_, "name": "Bash", "input": input_}


def result(id_, content, **more):
    return user([{"type": "tool_result", "tool_use_id": id_, "content": content, **more}])


LOG = [
    agent(said("before any prompt")),
    user("do <system-reminder>x</system-reminder>it"), user("meta", isMeta=True), user("<system-reminder>only</system-reminder>"),
    agent(said("draft"), said("I will look"), call("a", command="ls  -l")), result("a", [said("out\n"), {"type": "image"}], is_error=True), result("a", "second"),
    {"type": "system", "subtype": "compact_boundary"}, agent(said("done")), agent(said("carried on")),
    user([{"type": "image"}]), agent(call("b", pattern="x"), call("c", file_path="/f")), agent(said(" bye ")), user("side", isSidechain=True),
]


def entries(spark, tmp_path, rows=LOG):
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    return logs.session_entries(logs.lines(spark, str(tmp_path)))


def test_log_turns(spark, tmp_path):
    got = transcripts.turns(entries(spark, tmp_path)).orderBy("number").collect()
    assert [(r["number"], r["time"], r["prompt"], r["final"], r["calls"]) for r in got] == [(1, "2026-01-02 03:04", "do it", "carried on", 1), (2, "2026-01-02 03:04", "[image]", "bye", 2)]
    first, second = ([(p["kind"], p["text"] or p["call"]) for p in r["parts"]] for r in got)
    assert first == [("say", "I will look"), ("tool", "`ls -l`"), ("say", transcripts.BOUNDARY)]
    # what was said last and led to no call yet comes in front of the next call, even a turn later
    assert second == [("say", "carried on"), ("tool", '"x"'), ("tool", "/f")]
    tool = got[0]["parts"][1]
    assert tool["output"] == "out\n\n[image]" and tool["error"] and tool["n"] == 1
    assert transcripts.turns(entries(spark, tmp_path).limit(0)).count() == 0
    shown = transcripts.turns(entries(spark, tmp_path)).where("number = 1").select(render.markdown().alias("m")).first()["m"]
    assert "> I will look\n\n### [tool 1/1] Bash: `ls -l`\n\n[output of tool 1, error]" in shown


def test_side_run_files(spark, tmp_path):
    run = transcripts.turns(entries(spark, tmp_path)).withColumnRenamed("file", "run_id")
    records = run.select("run_id").distinct().select("run_id", F.lit(0).alias("turn"), F.lit(2).alias("k"), F.lit('a "b"').alias("description"))
    text = render.run_files(run, records).first()
    assert text["file"] == "turn-0000-subagent-2.md" and text["content"].startswith('# Subagent of turn ? · "a "b""\n') and "## Message 1\n\ndo it\n\n## Work (1 tool call)" in text["content"]
    xml = render.run_files(run, records, as_xml=True).first()
    assert xml["file"].endswith(".xml") and xml["content"].startswith('<subagent parent_turn="0" description="a &quot;b&quot;">\n<turn n="1"') and xml["content"].endswith("</turn>\n\n</subagent>\n")


def folded(spark, tmp_path, rows):
    found = logs.messages(entries(spark, tmp_path, rows)).select(F.col("file").alias("t"), F.col("line").alias("seq"), "role", "blocks")
    split = turns.split_turns(found, thread="t", seq="seq", role="role", prompt=turns.is_prompt(F.col("role"), F.col("blocks")))
    return reduction.block_rows(split)


def test_reduced_turns_from_logs(spark, tmp_path):
    note = {"type": "user", "message": {"role": "system", "content": "mind this"}}
    stale = {"type": "user", "message": {"role": "system", "content": "f changed on disk since you last read it"}}
    rows = [
        user("go"), note, agent(said("first")), agent(call("a", command="ls")), user([{"type": "tool_result", "tool_use_id": "a", "content": "out"}, said("and this")]), note, stale, agent(said(" "), said("end")),
        user("again"), agent(said("w" * 700), *[call(f"c{i}", command=f"x{i}") for i in range(22)]),
        user("alone"),
    ]
    flat = folded(spark, tmp_path, rows)
    got = reduction.reduced_turns(flat, thread="t").orderBy("turn", "part", "seq", "pos").collect()
    of = lambda n: [(r["part"], r["role"], r["text"]) for r in got if r["turn"] == n]
    assert of(1) == [(0, "user", "go"), (1, "user", "and this"), (3, "system", "mind this"), (4, "assistant", "end")]
    (_, _, text) = of(2)[1]
    assert text.split("\n")[1] == "Last thing you said: " + "w" * 600 + "…" and "Tool calls (22, last 20 shown): Bash `x2`; " in text and text.endswith("transcript.")
    assert of(3) == [(0, "user", "alone"), (4, "assistant", f"{reduction.INTERRUPTED}\n{reduction.IN_TRANSCRIPT}")]
    evidence = spark.createDataFrame([(flat.first()["t"], 1, "seen")], "t string, turn int, evidence string")
    assert [r["text"] for r in reduction.reduced_turns(flat, thread="t", evidence=evidence).where("part = 2").collect()] == ["seen"]
    assert reduction.reduced_turns(flat.limit(0), thread="t").count() == 0


def test_recall_chunks_from_logs(spark, tmp_path):
    rows = [user("go"), agent(said("let me see"), call("a", command="list things")), result("a", "one\ntwo\nthree"), agent(call("b", command="kept")), result("b", "same"), agent(said("end")), user("next")]
    flat = folded(spark, tmp_path, rows)
    kept = flat.where("call_id = 'b' and type = 'tool_result'").select("t", "call_id", "text")
    own = reduction.recall_chunks(flat, kept, thread="t", size=2)
    got = sorted((r["call"], r["chunk"], r["lines"], r["terms"]) for r in own.collect())
    assert got == [("Bash `list things`", 0, ["one", "two"], ["bash", "list", "things", "one", "two"]), ("Bash `list things`", 1, ["three"], ["bash", "list", "things", "three"]), ("agent", 0, ["let me see"], ["let", "see"])]
    other = reduction.source_chunks(flat, thread="t", origin=F.lit("old"), users=True)
    assert sorted(r["call"] for r in other.collect()) == ["Bash `kept`", "Bash `list things`", "agent", "you", "you"]
    runs = spark.createDataFrame([(flat.first()["t"], "look", 7)], "run_id string, description string, turn int")
    side = reduction.run_chunks(other, runs, thread="t")
    assert {(r["turn"], r["origin"]) for r in side.collect()} == {(7, 'subagent "look"')}
    whole = reduction.recall_corpus(own, other, [side], thread="t")
    assert whole.count() == own.count() + side.count() and reduction.recall_corpus(own.limit(0), other, [side], thread="t").count() == 2 * side.count()
