"""Operators on hand-built rows of their own record shapes."""

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import evals, evidence, fold, render, retrieval, turns, usage
from talkloom.sources import logs

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def block(kind, text=None):
    return (kind, text, None, None, None, None, None, None)


def test_terms(spark):
    df = spark.createDataFrame([("Fix src/app.ts:42 and the user_id=ab12 The $HOME x",)], "t string")
    assert df.select(T.terms(F.col("t"))).first()[0] == ["fix", "src/app.ts:42", "src", "app", "user_id", "user", "ab12", "$home"]


def test_clip_and_salience(spark):
    rows = [("  a\t b  ",), ("x" * 300,), ("Error: build failed",), ("commit 1a2b3c4",), ("all is well here",), ("exit code: 0",), ("exit code: 3",), ("id: abc-9f8e7d6",), ("é1234 elements",)]
    got = spark.createDataFrame(rows, "t string").select(T.clip(F.col("t"), 220), T.salience(F.col("t"))).collect()
    assert got[0][0] == "a b" and got[1][0] == "x" * 220 + "…"
    assert [r[1] for r in got[2:]] == [4 + 1 + 1, 4, None, None, 2 + 1 + 1 + 1, 3 + 1 + 1 + 1, 3]


def test_prompt_rule_and_turns(spark):
    rows = [
        (0, "system", [block("text", "hi")]), (1, "user", [block("text", "one")]), (2, "user", [block("text", "again")]), (3, "assistant", [block("text", "ok")]),
        (4, "user", [block("tool_result")]), (5, "user", [block("text", "[Image: original 10x10, displayed at 5x5. note]")]), (6, "user", [block("text", "two")]), (7, "user", [block("image")]), (8, "assistant", [block("text", "done")]),
    ]
    df = spark.createDataFrame([("t", *r) for r in rows], f"thread string, seq long, role string, blocks {BLOCKS}")
    got = turns.split_turns(df, thread="thread", seq="seq", role="role", prompt=turns.is_prompt(F.col("role"), F.col("blocks")))
    assert [r["turn"] for r in got.orderBy("seq").collect()] == [0, 1, 1, 1, 1, 1, 2, 2, 2]
    keys = turns.turn_keys(got.withColumn("text", F.lit("same")), thread="thread", seq="seq", opening=F.col("text")).orderBy("turn").collect()
    assert keys[1]["key"] == keys[0]["key"] + "~1" and len(keys[0]["key"]) == 24


def test_call_results_and_anti(spark):
    calls = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3)], "thread string, call_id string, seq int")
    results = spark.createDataFrame([("t", "a", 4, "old"), ("t", "a", 5, "new"), ("t", "b", 6, "kept")], "thread string, call_id string, rseq int, text string")
    last = turns.call_results(calls, results, scope=["thread"], call_id="call_id", seq="seq", result_seq="rseq")
    assert sorted((r["call_id"], r["text"]) for r in last.collect()) == [("a", "new"), ("b", "kept")]
    first = turns.call_results(calls, results, scope=["thread"], call_id="call_id", seq="seq", result_seq="rseq", last=False, how="left")
    assert sorted((r["call_id"], r["text"]) for r in first.collect()) == [("a", "old"), ("b", "kept"), ("c", None)]
    kept = spark.createDataFrame([("b", "kept"), ("a", "other")], "call_id string, text string")
    assert [r["call_id"] for r in turns.without_kept(last, kept, call_id="call_id", text="text").collect()] == ["a"]


def test_launch_turns(spark):
    runs = spark.createDataFrame([("r1", "c1", "p"), ("r2", None, "look"), ("r3", "zz", "look"), ("r4", None, None)], "run_id string, tool_use_id string, prompt string")
    calls = spark.createDataFrame([("c1", "Agent", "p", 4), ("c2", "Task", "look", 2), ("c3", "Bash", "look", 1)], "call_id string, name string, prompt string, turn int")
    assert {r["run_id"]: r["turn"] for r in turns.launch_turns(runs, calls).collect()} == {"r1": 4, "r2": 2, "r3": 0, "r4": 0}


def test_evidence_skips_what_does_not_fit(spark):
    long = "error " + "x" * 150
    rows = [("t", 1, f"{long}a\n{long}b\n{long}c\nid: abc-9f8e7d6\nplain"), ("t", 2, "all fine")]
    df = spark.createDataFrame(rows, "turn string, call int, text string")
    got = evidence.turn_evidence(df, turn=["turn"], call="call", head=F.lit("cmd"), text="text", turn_chars=220).first()
    # the best line and one long line fit; the others are skipped, not the loop stopped
    assert got["evidence"] == f"- cmd:\n    {long}a\n    id: abc-9f8e7d6" and got["used"] == len(long) + 1 + 5 + 7 + 15 + 5


def test_folded_view_stops_and_carried_skips(spark):
    rows = spark.createDataFrame([("t", i, size) for i, size in enumerate([10, 500, 10, 10])], "thread string, turn int, size int")
    view = fold.folded_view(rows, thread="thread", turn="turn", full=F.repeat(F.lit("x"), F.col("size")), short=F.lit("s"), cap=100)
    assert [r["is_full"] for r in view.orderBy("turn").collect()] == [False, False, True, True]
    notes = spark.createDataFrame([("t", 1, "a" * 50), ("t", 2, "b" * 90), ("t", 3, "a" * 50), ("t", 4, "c" * 20)], "thread string, seq int, text string")
    assert fold.carried(notes, thread="thread", seq="seq", text="text", most=100).first()["taken"] == ["c" * 20, "a" * 50]


def test_rolling_cut_and_shrink(spark):
    rows = spark.createDataFrame([("t", i, 10) for i in range(1, 11)], "thread string, turn int, size int")
    got = fold.rolling_cut(rows, thread="thread", turn="turn", size="size", keep=3, budget=20).collect()
    # ten turns of 10: turns 1 to 3 fold when turn 7 opens, 4 to 6 when turn 10 does
    assert [(r["turn"], r["cut"]) for r in got if r["rolled"]] == [(7, 3), (10, 6)]
    swept = fold.budget_sweep(rows, spark.createDataFrame([(20,), (1000,)], "budget long"), thread="thread", turn="turn", size="size", keep=3)
    assert sorted(map(tuple, swept.collect())) == [(20, "t", 2, 70, 9), (1000, "t", 0, 100, 0)]
    threads = spark.createDataFrame([("a", 3, 20, 5, 10, 1, 100, 75), ("b", 1, 5, 5, 1, 1, 100, 10)], "thread string, keep long, results long, protected long, turn_size long, result_size long, size long, target long")
    assert {r["thread"]: (r["keep"], r["cleared"], r["stuck"]) for r in fold.shrink_steps(threads).collect()} == {"a": (0, 0, False), "b": (0, 0, True)}


def test_rolling_cut_by_the_rule(spark):
    """Against the rule written out over whole lists, with interrupted turns."""
    rng = random.Random(2)
    threads = {f"t{n}": [(rng.choice([0, 5, 10, 40]), rng.random() < 0.3) for _ in range(rng.randint(1, 25))] for n in range(60)}
    rows = spark.createDataFrame([(k, i, s, b) for k, v in threads.items() for i, (s, b) in enumerate(v)], "thread string, turn int, size int, broken boolean")
    for keep, budget in ((0, 15), (1, 0), (3, 30)):
        got = {(r["thread"], r["turn"]): (r["cut"], r["rolled"]) for r in fold.rolling_cut(rows, thread="thread", turn="turn", size="size", keep=keep, budget=budget, interrupted="broken").collect()}
        for k, turns in threads.items():
            cut = 0
            for now in range(len(turns)):
                at = now - keep
                while at > 1 and turns[at][1]:
                    at -= 1
                roll = at >= 1 and at > cut and sum(s for s, _ in turns[cut:at]) > budget
                cut = at if roll else cut
                assert got[k, now] == (cut, roll)


def test_usage_lines_dedupe_and_price(spark, tmp_path):
    def line(out, **more):
        usage_ = {"input_tokens": 10, "output_tokens": out, "cache_creation_input_tokens": 100, "cache_read_input_tokens": 5, "cache_creation": {"ephemeral_1h_input_tokens": 40}, "service_tier": "standard"} | more
        return json.dumps({"type": "assistant", "timestamp": "2026-01-05T10:00:00.000Z", "requestId": "r", "message": {"id": "m", "model": "alpha-2-x", "usage": usage_}})

    (tmp_path / "s.jsonl").write_text("\n".join([line(8), line(300), line(154), "not json", '{"usage": broken', json.dumps({"type": "user"})]))
    got = usage.deduplicated_usage(logs.usage_lines(logs.lines(spark, str(tmp_path))))
    prices = spark.createDataFrame([(0, "alpha-2", 3.0, 15.0, 0.3), (1, "alpha", 1.0, 1.0, 1.0)], "pos int, prefix string, p_input double, p_output double, p_read double")
    row = usage.priced(got, prices, name="model").withColumn("cost", usage.cost()).first()
    assert (row["output"], row["cache_write_5m"], row["cache_write_1h"], row["prefix"]) == (300, 60, 40, "alpha-2")
    assert abs(row["cost"] - (10 * 3 + 300 * 15 + 5 * 0.3 + 60 * 3 * 1.25 + 40 * 3 * 2) / 1e6) < 1e-12


def test_lines_keep_their_order_and_equal_lines_count(spark, tmp_path):
    usage_ = {"input_tokens": 1, "output_tokens": 2, "service_tier": "standard"}
    line = json.dumps({"timestamp": "2026-01-05T10:00:00.000Z", "message": {"usage": usage_}})
    late = json.dumps({"timestamp": "2026-01-06T10:00:00.000Z", "message": {"usage": usage_ | {"output_tokens": 3}}})
    other = json.dumps({"timestamp": "2026-01-05T10:00:00.000Z", "message": {"text": "usage"}, "usage": 1})
    (tmp_path / "s.jsonl").write_text("\n".join([line, other, line, late]))
    rows = logs.lines(spark, str(tmp_path))
    got = usage.deduplicated_usage(logs.usage_lines(rows)).collect()
    assert sorted((r["model"], r["output"]) for r in got) == [("unknown", 2), ("unknown", 2), ("unknown", 3)]
    assert usage.deduplicated_usage(logs.usage_lines(rows, since_ms=1767657600000)).count() == 1
    said = "\n".join(json.dumps({"type": "user", "message": {"role": "user", "content": f"{i} " + "x" * 200}}) for i in range(3000))
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "t.jsonl").write_text(said)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        entries = logs.messages(logs.session_entries(logs.lines(spark, str(tmp_path / "big")))).repartition(7)
        texts = [r["blocks"][0]["text"] for r in entries.orderBy("file", "line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(t.split()[0]) for t in texts] == list(range(3000))


LOG = "thread string, seq long, ts string, input long, charsIn long, charsOut long, charsFixed long, cacheRead long, cacheWrite long, uncached long, compacted boolean, turns int, window long"


def test_native_compactions_golden_case(spark):
    plain = {"a": [500_000, 930_000, 950_000, 1_900_000], "b": [400_000]}
    rows = [(t, i, f"2026-01-0{i + 1}", 100, p // 100, 1, 0, 1, 2, 3, False, None, 1_000_000) for t, ps in plain.items() for i, p in enumerate(ps)]
    log = spark.createDataFrame(rows, LOG)
    hits = sorted((r["thread"], r["seq"]) for r in usage.native_compactions(log).where("hit").collect())
    assert hits == [("a", 1), ("a", 3)]
    peaks = {r["thread"]: (r["plain"], r["compactions"], r["turns"]) for r in usage.thread_peaks(log).collect()}
    assert peaks == {"a": (1_900_000, 2, None), "b": (400_000, 0, None)}


def test_sessions_totals_and_ties(spark):
    rows = [("s-" + "a" * 24, 1, "t1", 10, 40, 20, 5, 1, 1, 1, True, 3, 0), ("s-" + "b" * 24, 2, "t2", 20, 0, 20, 5, None, 1, 1, False, None, 0), ("s-" + "a" * 24, 3, "t3", 0, 9, 9, 9, 9, 9, 9, True, 9, 0)]
    log = spark.createDataFrame(rows, LOG)
    one = usage.per_session(log).first()
    assert (one["session"], one["context"], one["plain"], one["turns"], one["requests"], one["folds"], one["last_seen"]) == ("s", 20, None, 3, 2, 1, "t2")
    t = usage.totals(log).first()
    assert (t["requests"], t["cacheRead"], t["folds"], t["last_fold"], t["sent"], t["saved"]) == (2, 1, 1, "t1", 10, 10)
    tie = spark.createDataFrame([("x", 1, "t1", 10, 40, 20, 5, 1, 1, 1, False, 1, 0), ("x", 2, "t2", 20, 20, 20, 5, 1, 1, 1, False, 2, 0)], LOG)
    peak = usage.thread_peaks(tie).first()
    assert (peak["plain"], peak["sent"]) == (20, 20)  # the later row wins


def test_savings(spark):
    log = spark.createDataFrame([("x", 1, "t", 100, 200, 100, 0, 5, 10, 7, True, 1, 0), ("x", 2, "t", 100, 0, 100, 0, 5, 10, 7, False, 1, 0), ("x", 3, "t", 100, 300, 100, 0, 6, 6, 6, False, 1, 0)], LOG).withColumn("at", F.lit(1000).cast("long"))
    entries = spark.createDataFrame([(9, 1500, "alpha", 7, 3, 10, 0, 5, False), (8, 900_000, "alpha", 6, 3, 6, 0, 6, False)], "usage_id long, at long, model string, input long, output long, cache_write_5m long, cache_write_1h long, cache_read long, fast boolean")
    prices = spark.createDataFrame([(0, "alpha", 1.0, 5.0, 0.1)], "pos int, prefix string, p_input double, p_output double, p_read double")
    got = usage.savings(log, entries, prices).first()
    assert (got["handled"], got["priced"], got["unsized"], got["unmatched"]) == (3, 1, 1, 1)
    assert abs(got["saved"] - (100 * 0.1e-6 - 10 * (1.25e-6 - 0.1e-6))) < 1e-15


def test_floor_elements(spark):
    rows = spark.createDataFrame([(k, v) for k, vs in {"a": [4, 1, 3, 2], "b": [5]}.items() for v in vs], "k string, v int")
    assert {r["k"]: r["m"] for r in usage.nth_ascending(rows, ["k"], "v", 0.5, "m").collect()} == {"a": 3, "b": 5}
    assert {r["k"]: r["m"] for r in usage.nth_ascending(rows, ["k"], "v", 0.95, "m").collect()} == {"a": 4, "b": 5}


def test_shared_items_meet_in_one_exchange(spark, monkeypatch):
    """Before, the number of tasks did not follow the rows, the items of a group met its owners in one task, and rows were joined with themselves."""
    rng = random.Random(4)
    sets = [(g, rng.choice([None, *range(g * 3 + 1)]), rng.choice([None, *range(6)])) for g in range(4) for _ in range(60)]
    sets += [(None, 1, 1), (None, 2, 1), *((9, owner, item) for owner in range(300) for item in (owner % 7, 100 + owner % 2, 200)), *((9, owner, 300) for owner in range(150))]
    rows = spark.createDataFrame(sets * 2, "g long, o long, i long").repartition(3)
    monkeypatch.setattr(evals, "ITEM_ROWS", 200, raising=False)
    want = Counter()
    for g in {g for g, _, _ in sets if g is not None}:
        n = len({o for h, o, _ in sets if h == g and o is not None})
        for i in {i for h, _, i in sets if h == g and i is not None}:
            have = {o for h, o, j in sets if (h, j) == (g, i)}  # a missing owner counts as one that has the item, but meets nobody
            if n < 4 or len(have) <= n * 0.5:
                want.update((g, a, b) for a in have for b in have if a is not None and b is not None and a < b)
    found = evals.shared_items(rows, group="g", owner="o", item="i")
    assert {(r["g"], r["a"], r["b"]): r["shared"] for r in found.collect()} == want
    assert want[9, 0, 14] == 3 and want[9, 0, 1] == 1  # item 200 is everyone's
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(g#\d+L, i#\d+L, (\d+)\)", plan.partition("Initial Plan")[2])
    assert dealt == [str(-(-len(sets) * 2 // 200))]
    assert evals.shared_items(rows.where("false"), group="g", owner="o", item="i").count() == 0


def test_verdicts(spark):
    cases = [
        ("tool_value", "4,200", "", "It is 4200.", "correct"), ("revised", "blue", "red", "It was red before, now blue", "correct"), ("revised", "blue", "red", "use red, or blue", "wrong"),
        ("revised", "blue", "red", "red", "stale"), ("decision", "pg", "mysql", "we take pg, not mysql", "correct"), ("decision", "pg", "mysql", "mysql", "stale"), ("tool_value", "x1", "", "I don't know", "unknown"),
        ("tool_value", "x1", "", "no record of it", "unknown"), ("tool_value", "x1", "", "y2", "wrong"), ("tool_value", "x1", "", None, "unknown"),
    ]
    df = spark.createDataFrame(cases, "kind string, answer string, stale string, response string, want string")
    got = df.select("want", evals.verdict(F.col("kind"), F.col("answer"), F.col("stale"), F.col("response")).alias("v")).collect()
    assert [r["v"] for r in got] == [r["want"] for r in got]


def test_json_extraction():
    assert evals.first_json('x {"a": {"b": "}"}} y') == '{"a": {"b": "}"}}'
    assert evals.first_json('```json\n{"a": [1, 2,],}\n```') == '{"a": [1, 2]}'
    assert evals.first_json("none") is None and evals.first_json("{broken") is None


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "k string, i int, v double")
    a, b = (evals.bootstrap(df, "k", "i", "v", draws=400).first() for _ in range(2))
    assert a == b and 1 <= a["low"] < 2.5 < a["high"] <= 4


def test_excerpt_and_recall(spark):
    lines = ["zero", "one needle here", "two", "three", "error: boom", "five"]
    chunks = spark.createDataFrame([(1, 7, None, "cmd", lines), (2, 8, "other", "cmd", ["nothing", "else"])], "chunk long, turn int, source string, call string, lines array<string>")
    prompts = spark.createDataFrame([(1, "where is the needle five")], "id long, prompt string")
    got = retrieval.recall(prompts, chunks, prompt_id="id", prompt="prompt").first()
    assert got["text"] == "[turn 7] cmd:\n    zero\n    one needle here\n    two\n    error: boom\n    five"


def test_bm25_relaxes_for_rare_queries(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "delta")], "d long, t string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma unknownword"), (3, "nowhere")], "q long, t string")
    got = retrieval.bm25(asked, docs, query_id="q", query_terms=T.terms(F.col("t")), doc_key=["d"], doc_terms=T.terms(F.col("t")))
    assert sorted((r["q"], r["d"]) for r in got.collect()) == [(1, 1), (2, 2)]


def test_render(spark):
    part = "array<struct<kind:string,n:int,name:string,call:string,body:string,output:string,error:boolean,text:string>>"
    rows = [(1, "2026-01-01 10:00", "do it", [("say", None, None, None, None, None, False, "a\nb"), ("tool", 1, "Bash", "`ls`", "", "out", True, None)], "done", 1), (2, "", "q", [], "", 0)]
    df = spark.createDataFrame(rows, f"number int, time string, prompt string, parts {part}, final string, calls int")
    first, second = df.select(render.markdown().alias("m"), render.xml().alias("x")).collect()
    assert "> a\n> b\n\n### [tool 1/1] Bash: `ls`\n\n[output of tool 1, error]\n```\nout\n```" in first["m"] and "## Work (1 tool call)" in first["m"]
    assert '<output error="true">\nout\n</output>' in first["x"] and "<call>ls</call>" in first["x"]
    assert "_No tool calls._" in second["m"] and render.NO_REPLY in second["m"] and '<final_reply interrupted="true"/>' in second["x"]
    assert re.search(r"- \*\*turn-0001\.md\*\* \(2026-01-01 10:00, 1 calls\): do it → done", render.index(df.withColumn("t", F.lit(1)), "t").first()["content"])



def test_session_log_source(spark, tmp_path):
    rows = [
        {"type": "user", "message": {"role": "user", "content": "plain"}, "cwd": "/a b"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "i", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "isSidechain": True, "message": {"role": "user", "content": "side"}}, {"type": "user", "isCompactSummary": True, "message": {"role": "user", "content": "sum"}}, {"type": "system", "subtype": "compact_boundary"},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{bad\n")
    entries = logs.session_entries(logs.lines(spark, str(tmp_path)))
    assert entries.count() == 5
    got = logs.messages(entries).select("role", "blocks", logs.joined_text(F.col("blocks")).alias("t"), logs.folder_name(F.col("cwd")).alias("f")).collect()
    assert [(r["role"], r["t"]) for r in got] == [("user", "plain"), ("assistant", "x")] and got[0]["f"] == "-a-b" and got[1]["blocks"][1]["name"] == "Bash"
    names = spark.createDataFrame([("abc-1",), ("abd-2",), ("abc-1",)], "id string")
    assert [r["id"] for r in logs.by_prefix(names, "abc", "id").collect()] == ["abc-1"] and logs.by_prefix(names, "ab", "id").count() == 0


def test_dense_topk_answers_queries_of_all_blocks(spark, monkeypatch):
    from talkloom.operators import retrieval

    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(60)], "v long, e array<double>")
    queries = vectors.where("v % 2 = 0").toDF("q", "x")
    find = lambda: sorted(map(tuple, retrieval.dense_topk(queries, vectors, query_id="q", query_vec="x", key="v", vec="e", k=3).collect()))
    whole = find()
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 8)
    assert len(whole) == 90 and find() == whole
