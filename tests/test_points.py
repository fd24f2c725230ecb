"""Cut points and audits on small rows: nulls, ties, empty tables and clashing columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import audits, points


def test_context_cut_stops_at_a_boundary_and_needs_turns(spark):
    rows = [("a", i, i % 2 == 0, False, None if i % 2 == 0 else 100 * i) for i in range(10)] + [("b", 0, True, False, None), ("b", 1, False, True, 900), ("b", 2, True, False, 900)]
    entries = spark.createDataFrame(rows, "s string, n int, prompt boolean, boundary boolean, context long").withColumn("cut", F.lit("taken"))
    got = {r["s"]: (r["cut"], r["turns"], r["after"], r["last"]) for r in points.context_cuts(entries, session="s", seq="n", turns=2, least=300).collect()}
    assert got == {"a": (4, 3, 2, 900), "b": (None, 1, 0, 0)}
    assert points.context_cuts(entries.limit(0), session="s", seq="n").count() == 0


def test_points_of_one_session_or_signature_count_once(spark):
    schema = "kind string, session string, cwd string, before int, cut int, first_length int, place int, after int"
    rows = [("real", "a", "p", 30, 9, 5, 1, 4), ("synthetic", "a", "p", 31, 8, 5, 1, 9), ("real", "b", "p", 30, 9, 5, 2, 3), ("real", "c", "p", 10, 7, 5, 3, 5), ("synthetic", "d", "q", 3, 1, 1, 2, 2), ("real", "e", "q", 40, 2, 2, 4, 1)]
    got = points.chosen_points(spark.createDataFrame(rows, schema), total=2)
    assert sorted((r["kind"], r["session"]) for r in got.collect()) == [("real", "a"), ("synthetic", "d")]
    more = points.continuations(spark.createDataFrame(rows, schema), total=3)
    assert sorted((r["kind"], r["session"]) for r in more.collect()) == [("real", "c"), ("synthetic", "a"), ("synthetic", "d")]
    assert points.chosen_points(spark.createDataFrame([], schema), total=2).count() == 0


def test_next_turn_and_acts(spark):
    rows = [("a", 1, True, None, None), ("a", 2, False, "Read", None), ("a", 3, True, None, None), ("a", 4, False, "Bash", "cat x"), ("a", 5, False, "Edit", None), ("a", 6, False, "Read", None), ("a", 7, True, None, None)]
    frame = spark.createDataFrame(rows, "s string, n int, prompt boolean, tool string, command string")
    cuts = spark.createDataFrame([("a", 2), ("gone", 1)], "s string, cut int")
    turn = points.next_turn(frame, cuts, session="s", seq="n")
    assert [(r["n"], r["part"]) for r in turn.orderBy("n").collect()] == [(3, 0), (4, 1), (5, 1), (6, 1)]
    acts = points.acts(turn.where("part = 1"), session="s", seq="n", own=F.lit(True)).collect()
    assert [(r["calls"], r["reads_before"]) for r in acts] == [(3, 1)]


def test_real_prompts(spark):
    lines = ['{"type":"user","message":{"content":"fix it"}}', '{"type":"user","message":{"content":"[Request interrupted by user]"}}', '{"type":"user","message":{"content":"<command-name>x</command-name>"}}',
             '{"type":"user","isSidechain":true,"message":{"content":"look"}}', '{"type":"assistant","message":{"content":"ok"}}']
    frame = spark.createDataFrame([(f"f-{i}", i, line) for i, line in enumerate(lines)], "file string, line long, raw string").select(
        "line", F.get_json_object("raw", "$.type").alias("type"), F.coalesce(F.get_json_object("raw", "$.isSidechain") == "true", F.lit(False)).alias("side"),
        F.array(F.struct(F.lit("text").alias("type"), F.get_json_object("raw", "$.message.content").alias("text"))).alias("blocks"))
    got = frame.select("line", points.real_prompt(F.col("type"), F.lit(False), F.lit(False), F.col("side"), F.col("blocks")).alias("p")).orderBy("line").collect()
    assert [r["p"] for r in got] == [True, False, False, False, False]


def test_junk_revealed_and_ends(spark):
    frame = spark.createDataFrame([("test  ",), (None,), ("12\tx y z word",), ("rewrite the parser module today",)], "t string")
    assert [r[0] for r in frame.select(audits.is_junk(F.col("t"))).collect()] == [True, True, True, False]
    told = spark.range(1).select(audits.revealed(F.lit("Port 8,080 is `Open`"), F.array(F.lit("8080"), F.lit("open"), F.lit(None), F.lit(""), F.lit("shut"))).alias("v")).first()["v"]
    assert told == ["8080", "open"]
    for n in (0, 1, 4, 5, 9):
        lines = [str(i) for i in range(n)]
        got = spark.createDataFrame([(lines,)], "l array<string>").select(audits.both_ends(F.col("l"), 4).alias("x")).first()["x"]
        want = list(enumerate(lines)) if n <= 4 else list(enumerate(lines))[:2] + list(enumerate(lines))[-2:]
        assert [(r["i"], r["line"]) for r in got] == want


def test_audit_tables_without_rows_and_with_nulls(spark):
    runs = spark.createDataFrame([("a", 0, 1.0), ("a", 4, 2.0), ("a", 9, None), ("b", 0, None)], "arm string, size long, wall double")
    got = {r["arm"]: (r["size"], r["wall"]) for r in audits.cost_table(runs, arm="arm", size="size", means=["wall"]).collect()}
    assert got == {"a": (9, 1.5), "b": (0, None)}
    totals = audits.report_totals(runs.limit(0), sums=["size"], peaks=["wall"]).first()
    assert (totals["size"], totals["wall"]) == (0, 0)
    verdicts = spark.createDataFrame([("a", None), ("b", "correct"), ("b", "wrong")], "arm string, verdict string")
    assert {r["arm"]: (r["n"], r["accuracy"]) for r in audits.verdict_counts(verdicts, ["arm"]).collect()} == {"a": (0, None), "b": (2, 0.5)}
    plants = spark.createDataFrame([("s", "f", 1, "v1|v2"), ("s", "f", 2, "v2")], "s string, fact string, turn int, value string")
    turns = spark.createDataFrame([("s", 1, "v1 v2"), ("s", 2, "v1"), ("s", 3, None), ("t", 1, "v1")], "s string, turn int, text string")
    assert [tuple(r) for r in audits.leak_errors(plants, turns, session="s").collect()] == [("s", "f", "v1", 2)]
