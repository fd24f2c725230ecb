"""Session catalogue, sizes and folded requests on hand-built rows."""

import json

from pyspark.sql import functions as F

from talkloom.operators import context, sessions


def test_outlines_candidates_and_ranking(spark):
    turns = spark.createDataFrame([("a", 1, "<note>x</note>fix the parser bug"), ("a", 2, "parser tests"), ("b", 1, "paint the garden fence"), ("b", 2, "garden again"), ("c", 1, "only one")], "id string, turn int, prompt string")
    out = sessions.outlines(turns, session="id", turn="turn", prompt="prompt")
    catalogue = out.withColumns({"cwd": F.lit("/x"), "mtime": F.ascii("id"), "label": F.col("id")})
    found = sessions.candidates(catalogue, owner=F.lit(True))
    assert {r["id"]: r["place"] for r in found.collect()} == {"b": 1, "a": 2}
    assert out.where("id = 'a'").first()["outline"] == "1. fix the parser bug\n2. parser tests"
    prompts = spark.createDataFrame([(1, "/x", "parser tests please"), (2, "/x", "unrelated")], "q int, cwd string, t string")
    ranked = sessions.ranked_candidates(prompts, found, prompt_id="q", prompt="t")
    assert [(r["q"], r["id"]) for r in ranked.collect()] == [(1, "a")]
    short = sessions.shortlist(ranked, found, prompt_id="q", prompts=prompts, k=2).orderBy("q", "place").collect()
    assert [(r["q"], r["id"]) for r in short] == [(1, "a"), (1, "b"), (2, "b"), (2, "a")]
    assert [r["id"] for r in sessions.filtered(ranked, found, "garden fence").orderBy("place").collect()] == ["a", "b"]


def test_side_runs(spark):
    schema = "run_id string, seq long, ts string, type string, text string"
    own = spark.createDataFrame([("r1", 1, "t2", "user", "look at it"), ("r1", 2, "t3", "assistant", "ok")], schema)
    inline = spark.createDataFrame([("r1", 1, "t0", "user", "same run"), ("r2", 2, "t1", "user", "inline run"), (None, 3, "t9", "user", None)], schema)
    meta = spark.createDataFrame([("r1", "Looker", "call-1")], "run_id string, description string, tool_use_id string")
    got = {r["run_id"]: (r["inline"], r["description"], r["tool_use_id"]) for r in sessions.side_runs(own, meta, inline).collect()}
    assert got == {"r1": (False, "Looker", "call-1"), "r2": (True, "inline run", None), "sidechain": (True, "", None)}


def test_joins_of_state(spark):
    prompts = spark.createDataFrame([("f1", ["a"]), ("f2", ["b"]), ("f3", ["c"])], "fp string, blocks array<string>")
    recalls = spark.createDataFrame([("f1", "r"), ("f2", "")], "fp string, text string")
    assert {r["fp"]: r["blocks"] for r in sessions.with_recalls(prompts, recalls, key="fp", blocks="blocks").collect()} == {"f1": ["a", "r"], "f2": ["b"], "f3": ["c"]}
    assert [r["fp"] for r in sessions.missing_recalls(prompts, recalls, key="fp").collect()] == ["f3"]
    handoffs = spark.createDataFrame([("f1", 'l"', "view"), ("f2", "l", None)], "fp string, label string, text string")
    got = {r["fp"]: r["blocks"] for r in sessions.with_handoffs(prompts, handoffs, key="fp", blocks="blocks").collect()}
    assert got == {"f1": ['<handoff from="l&quot;">\nview\n</handoff>', "a"], "f2": ["b"], "f3": ["c"]}
    live = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "session_id string, started_at long")
    seen = spark.createDataFrame([("a", 9), ("b", 2)], "session_id string, last_seen long")
    assert sorted(r["session_id"] for r in sessions.unrouted(live, seen).collect()) == ["b", "c"]
    ids = spark.createDataFrame([("go {x:continue:abcdef12}",), ("<handoff>{x:continue:abcdef12}</handoff>",), ("{continue:short}",)], "t string")
    assert [r[0] for r in ids.select(sessions.continue_id(F.col("t"))).collect()] == ["abcdef12", None, None]


def test_sizes_and_feedback(spark):
    raw = json.dumps({"a": "x", "data": "Q" * 3000}, separators=(",", ":"))
    df = spark.createDataFrame([(raw, "Prompt is too long: 210000 tokens > 200000 maximum"), ("{}", "other")], "j string, e string")
    got = df.select(context.size_of(F.col("j")).alias("s"), context.overflow(F.col("e")).alias("o")).collect()
    assert got[0]["s"] == len(raw) - 3000 + 5800 and tuple(got[0]["o"]) == (210000, 200000) and got[1]["o"] is None
    rows = spark.createDataFrame([("t", "m", 1, 100, 50, None), ("t", "m", 2, 100, None, "prompt is too long: 80 tokens > 70"), ("t", "big", 0, 100, 10, None), ("u", "m", 1, 0, 5, None)], "thread string, model string, seq long, chars long, tokens long, error string")
    learned = {r["thread"] + r["model"]: (r["ratio"], r["limit"]) for r in context.learned(rows).collect()}
    assert abs(learned["tm"][0] - 0.88) < 1e-9 and learned["tm"][1] == 70 and learned["tbig"] == (learned["tm"][0], None) and learned["um"] == (None, None)


def test_labels_of_calls(spark):
    rows = [("Bash", '{"command":"ls  -l"}'), ("Read", '{"file_path":"/a"}'), ("Grep", '{"pattern":"x","path":"src"}'), ("Edit", '{"old_string":"a","new_string":"b"}'), ("Other", '{"k":1}')]
    got = spark.createDataFrame(rows, "n string, i string").select(context.call_label(F.col("n"), F.col("i")), context.call_description(F.col("i")), context.call_body(F.col("n"), F.col("i"))).collect()
    assert [r[0] for r in got[:3]] == ["Bash `ls -l`", "Read /a", 'Grep "x"'] and got[2][1] == '"x" in src' and got[4][0] == 'Other {"k":1}'
    assert got[3][2] == "Replaced:\n```\na\n```\nWith:\n```\nb\n```" and got[0][2] == ""
    long = json.dumps({"a": ["y" * 3000, {"b": "short"}]})
    cut = json.loads(spark.createDataFrame([(long,)], "i string").select(context.shortened_input(F.col("i"))).first()[0])
    assert cut["a"][0].startswith("y" * 500 + "…") and cut["a"][1] == {"b": "short"}


def test_compacted_rows(spark):
    messages = spark.createDataFrame([("t", t, t * 10 + k, f"m{t}.{k}") for t in range(1, 5) for k in range(2)], "thread string, turn int, seq long, text string")
    reduced = spark.createDataFrame([("t", t, t * 10, f"r{t}") for t in range(1, 5)], "thread string, turn int, seq long, text string")
    cuts, pins = spark.createDataFrame([("t", 4)], "thread string, cut int"), spark.createDataFrame([("t", 2)], "thread string, turn int")
    got = context.compacted(messages, reduced, cuts, pins, thread="thread", seq="seq", turn="turn").orderBy("place").collect()
    assert [(r["kind"], r["text"]) for r in got] == [
        ("head", "m1.0"), ("notice", "2 earlier turns are shown in short form."), ("reduced", "r1"), ("pinned", "m2.0"), ("pinned", "m2.1"), ("reduced", "r3"), ("whole", "m4.0"), ("whole", "m4.1"),
    ]
