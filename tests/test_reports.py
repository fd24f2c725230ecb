"""Reports and hand-offs: figures, cells, marks resolved once, views under shares, folds by hand."""

import random

from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import handoffs, reports, usage
from talkloom.sources import files


def test_figures(spark):
    def shown(values, kind, figure):
        return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(figure(F.col("v")).alias("x")).collect()]

    assert shown([0, 950, 951, 1000, 1250, 1450, 9_950, 12_499, 950_000, 950_001, 3_000_000_000], "long", T.token_figure) == ["0", "950", "1.0k", "1.0k", "1.3k", "1.4k", "9.9k", "12k", "950k", "1.0M", "3.0B"]
    assert shown([0.0, 0.125, 1.005, 99.99, 100.0, 1234.5], "double", T.dollar_figure) == ["$0.00", "$0.13", "$1.00", "$99.99", "$100", "$1,235"]
    assert shown([-5.0, 59.0, 60.0, 3_599.0, 5_400.0, 200_000.0], "double", T.ago_figure) == ["just now", "just now", "1m ago", "60m ago", "2h ago", "2d ago"]


def test_cells(spark):
    schema = ", ".join([f"{c} long" for c in reports.COUNTS] + [f"{c} double" for c in reports.AMOUNTS])

    def cells(**given):
        row = {c: 0 for c in reports.COUNTS} | {c: 0.0 for c in reports.AMOUNTS} | given
        rows = spark.createDataFrame([tuple(row.values())], schema)
        return tuple(rows.select(reports.cost_cell(), reports.avoided_cell(), reports.not_sent_cell(), reports.saved_cell(), reports.left_out()).first())

    assert cells() == ("", "–", "–", "–", "")
    assert cells(requests=2, unpriced=1, cost=1.5, handled=3, not_sent=-4, priced=1, saved=0.004) == ("$1.50*", "0", "±0", "±0", "2 to models without a price")
    assert cells(handled=9, avoided=1200, not_sent=25_000, folds=1, priced=4, saved=1.0, actual=3.0, unsized=2, unmatched=3) == ("", "1,200", "25k 1 fold", "$1.00 25%", "2 predate size logging and 3 aren't in session files")
    assert cells(handled=1210, priced=1, saved=-1.0, actual=3.0, unsized=1200, unmatched=1, not_sent=5, folds=2)[2:] == ("5 2 folds", "−$1.00 -50%", "1,200 predate size logging, 1 aren't in session files and 8 to models without a price")


def test_report_places_rows_in_buckets(spark):
    day = 86_400_000
    entries = spark.createDataFrame(
        [(1, 10 * day + 5, "m", 4, 2, 3, 0, 100, False), (2, 12 * day + 9, "none", 1, 1, 0, 0, 0, False), (3, 2 * day, "m", 9, 9, 9, 9, 9, False), (4, 99 * day, "m", 1, 0, 0, 0, 0, False)],
        "usage_id long, at long, model string, input long, output long, cache_write_5m long, cache_write_1h long, cache_read long, fast boolean",
    )
    log = spark.createDataFrame(
        [("t", 1, 10 * day, 50, 300, 100, 10, 100, 3, 4, True, 100), ("t", 2, 11 * day, 0, 300, 100, 10, 0, 0, 0, True, 100), ("t", 3, 12 * day, 50, None, 100, 10, 1, 1, 1, None, 100), ("t", 4, 1 * day, 50, 300, 100, 10, 1, 1, 1, True, 100)],
        "thread string, seq long, at long, input long, charsIn long, charsOut long, charsFixed long, cacheRead long, cacheWrite long, uncached long, compacted boolean, window long",
    )
    prices = spark.createDataFrame([(0, "m", 1.0, 5.0, 0.1)], "pos int, prefix string, p_input double, p_output double, p_read double")
    got = {r["label"]: r for r in reports.usage_report(entries, log, prices, now=12 * day + 10, count=3).collect()}
    assert sorted(got) == ["1970-01-11", "1970-01-12", "1970-01-13", "Total"]
    first, empty, last, total = (got[k] for k in sorted(got))
    assert (first["requests"], first["handled"], first["priced"], first["folds"], first["not_sent"], first["avoided"]) == (1, 1, 1, 1, 100, 1)  # 150 tokens pass 92 of 100
    assert abs(first["saved"] - (100 * 0.1 - 3 * (1.25 - 0.1)) / 1e6) < 1e-12
    assert (empty["requests"], empty["handled"], empty["folds"], empty["cost_cell"], empty["saved_cell"]) == (0, 0, 0, "", "–")
    assert (last["requests"], last["unpriced"], last["handled"], last["unsized"], last["unmatched"]) == (2, 1, 1, 1, 0)  # what is later counts in the last bucket
    assert (total["requests"], total["input"], total["handled"]) == (3, 6, 2)
    none = reports.usage_report(entries.where("false"), log.where("false"), prices, now=12 * day, unit="week", count=2).collect()
    assert [r["requests"] for r in none] == [0, 0, 0]


def test_the_nth_number_is_exact(spark):
    random.seed(3)
    groups = {"many": [random.choice([0, 1, 2, 1000, 10**6]) for _ in range(3_000)], "one": [5], "same": [7] * 500, None: [3, 1, 2], "wide": [random.randrange(10**9) for _ in range(4_000)]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v long").repartition(5)
    for share in (0.0, 0.5, 0.95, 1.0):
        for accuracy in (10, 10_000):  # a coarse sketch misses the place now and then; the answer stays
            got = {r["k"]: r["m"] for r in usage.nth_ascending(rows, ["k"], "v", share, "m", accuracy=accuracy).collect()}
            assert got == {k: sorted(vs)[min(int(share * len(vs)), len(vs) - 1)] for k, vs in groups.items()}
    assert usage.nth_ascending(rows.where("false"), ["k"], "v", 0.5, "m").count() == 0


def test_the_nth_number_needs_no_exchange_of_rows(spark):
    """Before, with many partitions, all rows of a group were sorted in one task."""
    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 9_973).alias("v"))
    held = {"spark.sql.shuffle.partitions": "100", "spark.sql.autoBroadcastJoinThreshold": "100k"}  # the rows are larger
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = usage.nth_ascending(rows, ["k"], "v", 0.95, "m")
        got = {r["k"]: r["m"] for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert got == {k: sorted(i * 7 % 9_973 for i in range(k, 20_000, 3))[int(0.95 * len(range(k, 20_000, 3)))] for k in range(3)}


def test_marks_resolve_once(spark):
    found = spark.createDataFrame([("abcdefgh-1", "one"), ("abcdefgh-2", None), ("abcdefgh-2", "two"), ("zzzzzzzz", ""), ("short", "s"), ("me-myself-1", "me"), ("me-myself-2", "other")], "id string, label string")
    say = lambda p: f"go on {{continue:{p}}}"
    prompts = spark.createDataFrame(
        [("t", 1, "a", say("abcdefgh-1")), ("t", 2, "b", say("abcdefgh")), ("t", 3, "c", say("abcdefgh-1")), ("t", 4, "d", say("nothing-here")), ("t", 5, "e", "no mark"), ("t", 6, "f", say("zzzzzzzz")), ("t", 7, "g", say("abcdefgh-2")),
         ("t", 8, None, say("zzzzzzzz")), ("u", 1, "a", say("zzzzzzzz")), ("u", 2, "a", say("abcdefgh-2")), ("me-myself-1", 1, "a", say("me-myself")), ("t", 9, "h", None)],
        "thread string, seq int, key string, text string",
    )
    known = spark.createDataFrame([("t", "f", None), ("t", "x", "abcdefgh-2")], "thread string, key string, source string")
    rows = handoffs.new_handoffs(prompts, known, found, thread="thread", seq="seq", key="key", text="text")
    got = {(r["thread"], r["key"]): (r["source"], r["label"]) for r in rows.collect()}
    assert got == {
        ("t", "a"): ("abcdefgh-1", "one"), ("t", "b"): (None, None), ("t", "c"): (None, None), ("t", "d"): (None, None), ("t", "g"): (None, None), ("u", "a"): ("zzzzzzzz", ""), ("me-myself-1", "a"): ("me-myself-2", "other"),
    }
    views = spark.createDataFrame([("abcdefgh-1", "seen")], "source string, text string")
    texts = {(r["thread"], r["key"]): r["text"] for r in handoffs.with_views(rows, views).collect()}
    assert texts[("t", "a")] == "seen" and texts[("u", "a")] == "" and texts[("t", "b")] is None
    again = rows.select("thread", "key", "source").union(known)
    assert handoffs.new_handoffs(prompts, again, found, thread="thread", seq="seq", key="key", text="text").count() == 0


def test_a_prefix_that_all_ids_share_makes_no_pairs(spark):
    found = spark.range(3_000).select(F.format_string("session-%05d", "id").alias("id"), F.lit("l").alias("label"))
    prompts = spark.range(3_000).select(F.col("id").cast("string").alias("thread"), F.lit(1).alias("seq"), F.lit("k").alias("key"), F.lit("{continue:session-}").alias("text"))
    known = spark.createDataFrame([], "thread string, key string, source string")
    rows = handoffs.new_handoffs(prompts, known, found, thread="thread", seq="seq", key="key", text="text")
    assert rows.where("source is null").count() == 3_000


def _turns(spark, *rows):
    return spark.createDataFrame(list(rows), "s string, turn int, user string, evidence string, reply string")


def test_views_share_a_cap(spark, tmp_path):
    turns = _turns(spark, ("a", 1, "first", "", "x" * 50), ("a", 2, "second", "", "done"), ("b", 1, "other", "", "y" * 50))
    view = handoffs.session_views(turns, session="s", cap=60)
    got = {r["s"]: r for r in view.collect()}
    assert got["a"]["text"] == "### Turn 1\n\n**You:** first\n\n### Turn 2\n\n**You:** second\n\n**Agent:** done" and got["a"]["lines"] == 9 and got["a"]["chars"] == len(got["a"]["text"])
    assert "y" not in got["b"]["text"].replace("You", "")
    chosen = spark.createDataFrame([("q", 1, "b", "B"), ("q", 2, "a", None), ("r", 1, "b", "B"), ("r", 2, "gone", "G")], "q string, place int, s string, title string")
    several = {r["q"]: r["text"] for r in handoffs.several_views(chosen, turns, query="q", session="s", cap=120).collect()}
    assert several["q"].startswith("## Session: B\n\n### Turn 1") and "\n\n## Session: \n\n### Turn 1" in several["q"] and several["r"].endswith("\n\n## Session: G\n\n")
    out, kept = f"file://{tmp_path}/out", f"file://{tmp_path}/manifest"
    assert files.write_changed(handoffs.loaded_files(view, session="s"), out, kept) == 2 and files.write_changed(handoffs.loaded_files(view, session="s"), out, kept) == 0
    assert (tmp_path / "out" / "a.md").read_text() == got["a"]["text"]


def test_folds_by_hand(spark):
    turns = spark.createDataFrame([("t", i, f"k{i}", [f"p{i}"]) for i in range(4)] + [("one", 0, "k0", ["p0"])], "thread string, turn int, key string, prints array<string>")
    state = spark.createDataFrame([("t", "k1", 5, 2, 1, None, ["k3"], {"p0": "a", "p2": "b", "p9": "c"}), ("idle", "x", 1, 1, 1, True, None, None)], "thread string, cut string, keep int, cleared int, stuck int, host boolean, pins array<string>, recalls map<string,string>")

    def after(thread, at, pin, unpin=None):
        asks = spark.createDataFrame([(thread, at, pin, unpin)], "thread string, at int, pin array<int>, unpin array<int>")
        return {r["thread"]: r for r in handoffs.folded_by_hand(state, turns, asks).collect()}

    got = after("t", 2, [0, 3])
    row = got["t"]
    assert (row["cut"], row["keep"], row["cleared"], row["stuck"], row["host"], row["pins"], row["recalls"], row["error"]) == ("k2", 1, None, None, True, ["k0", "k3"], {"p2": "b", "p9": "c"}, None)
    assert (got["idle"]["cut"], got["idle"]["error"], got["idle"]["host"]) == ("x", None, True)
    assert (after("t", None, None)["t"]["cut"], after("t", None, None)["t"]["keep"]) == ("k3", 2)
    pinned = after("t", -1, [1], [3])["t"]
    assert (pinned["cut"], pinned["keep"], pinned["cleared"], pinned["pins"], pinned["recalls"]) == ("k1", 5, 2, ["k1"], {"p0": "a", "p2": "b", "p9": "c"})
    assert after("t", -1, None, [3])["t"]["pins"] is None
    for thread, at, pin, error in (("t", 0, None, "no such turn"), ("t", 4, None, "no such turn"), ("t", 2, [4], "no such turn to pin"), ("one", None, None, "one turn only"), ("gone", None, None, "no turn")):
        row = after(thread, at, pin)[thread]
        assert row["error"] == error and (thread != "t" or (row["cut"], row["pins"]) == ("k1", ["k3"]))


def test_longest_and_lines(spark):
    peaks = spark.createDataFrame([("a-" + "0" * 24, 5_000, 10, 2, 1, "3"), ("b", 5_000, 10, None, 0, "2"), ("c", 1, 1, 1, 2, "1")], "thread string, plain long, sent long, turns int, compactions long, last_seen string")
    got = reports.longest(peaks, since=F.lit("2"), most=5).collect()
    assert [(r["session"], r["history"], r["avoided"], r["sent"]) for r in got] == [("a", "5.0k of history", "1 compaction avoided", "sent 10 · 2 turns"), ("b", "5.0k of history", "no compaction needed", "sent 10")]
    top = reports.top_saved(spark.createDataFrame([("x", 5, 9), ("y", 9, 5), ("z", 9, 5)], "s string, p long, e long"), session="s", plain="p", sent="e", most=2)
    assert [(r["s"], r["kept_out"]) for r in top.collect()] == [("y", 4), ("z", 4)]
    catalogue = spark.createDataFrame([("0123456789", None, ["a"], 0), ("s2", "named", ["a", "b"], 7_200_000)], "id string, label string, asks array<string>, mtime long")
    lines = reports.session_lines(catalogue, spark.createDataFrame([("s2", 36_000)], "id string, chars long"), now=F.lit(7_200_000))
    assert {r["title"]: r["meta"] for r in lines.collect()} == {"01234567": "1 turns · ~0 tokens · 2h ago", "named": "2 turns · ~10k tokens · just now"}
