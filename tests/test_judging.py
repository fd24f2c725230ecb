"""Judging helpers on hand-built rows."""

from pyspark.sql import functions as F

from talkloom.operators import judging as J


def test_grades(spark):
    rows = [("u", "x", 1, 0, 1, 2, "correct"), ("u", "x", 1, 0, 2, 1, "wrong"), ("u", "x", 2, 0, 1, 0, "unknown"), ("u", "x", 2, 0, 2, 0, "unknown"), ("u", "y", 1, 0, 1, 2, "correct"), ("u", "y", 2, 0, 1, 0, "unknown")]
    g = spark.createDataFrame(rows, "unit string, arm string, question int, replicate int, place int, score int, label string")
    assert {r["arm"]: r["pct"] for r in J.mean_grades(g, unit="unit", arm="arm").collect()} == {"x": 37.5, "y": 50.0}
    assert tuple(J.agreement(g, ["unit", "arm", "question"]).first()) == (2, 0.5, 1.0)
    assert tuple(J.question_shapes(g, ["unit", "question"]).first()) == (1, 0, 1)
    assert {(r["arm"], r["question"]): r["label"] for r in J.pooled_labels(g, ["arm", "question"]).collect()} == {("x", 1): "wrong", ("x", 2): "unknown", ("y", 1): "correct", ("y", 2): "unknown"}


def test_lookups(spark):
    calls = spark.createDataFrame([("a", "Bash", "cd x && rg foo | head"), ("a", "Bash", "make"), ("a", "Read", None), ("a", "Read", "")], "k string, name string, command string")
    assert {r["tool"]: r["n"] for r in J.lookups(calls, key="k").collect()} == {"rg": 1, "bash": 1, "Read": 2}
    qs = spark.createDataFrame([("a", 1, "recent", "Port 80"), ("a", 2, "recent", "ok"), ("a", 3, "decision", "port 80"), ("b", 4, "recent", "port 80")], "unit string, id int, type string, answer string")
    rs = spark.createDataFrame([("a", "it is  PORT\n80 and ok")], "unit string, text string")
    assert [r["id"] for r in J.lookup_hits(qs, rs, unit="unit").collect()] == [1]
    need = spark.createDataFrame([("reduced", "recent", 1, None), ("rolling", "recent", 3, None), ("rolling", "recent", 4, None), ("tail", "recent", 5, 5), ("tail", "recent", 5, None), ("whole", "recent", 9, None), ("reduced", "decision", 9, None)], "s string, t string, ago int, kept int")
    assert [r[0] for r in need.select(J.needs_lookup(F.col("s"), F.col("t"), F.col("ago"), F.col("kept"))).collect()] == [True, False, True, True, None, False, False]


def test_choices(spark):
    options = spark.createDataFrame([(0, "start"), (1, "stats"), (2, "stop")], "pos int, name string")
    assert J.closest(options, "stat", "name").first()["name"] == "start" and J.closest(options, "replay", "name").count() == 0
    got = spark.createDataFrame([("ab",), ("b",), ("",)], "t string").select(J.half(F.col("t"))).collect()
    assert [r[0] for r in got] == [((7 * 31 + 97) * 31 + 98) % 2, (7 * 31 + 98) % 2, 1]
    c = spark.createDataFrame([("q", 1, "a", None), ("q", 2, "b", 0.4), ("q", 3, "c", 0.4)], "q string, place int, i string, p double")
    assert [r["i"] for r in J.by_probability(c, query="q", place="place", p="p").orderBy("rank").collect()] == ["b", "c", "a"]
    ranked = c.withColumn("rank", F.col("place"))
    picks = spark.createDataFrame([("q", "c", 1)], "q string, i string, pick int")
    assert [r["i"] for r in J.picked_first(ranked, picks, query="q", item="i").orderBy("rank").collect()] == ["c", "a", "b"]
    pool = spark.createDataFrame([("q", "z", 1), ("r", "y", 1), ("r", "x", 2)], "q string, i string, place int")
    assert {r["q"]: r["i"] for r in J.last_or(ranked, pool, query="q", item="i").collect()} == {"q": "a", "r": "y"}
    judged = spark.createDataFrame([("q", 1, "a", 0.2), ("q", 2, "b", 0.8), ("q", 3, "c", 0.9)], "q string, message int, pick string, p double")
    assert tuple(J.deferred(judged, query="q", least=0.5).first()) == ("q", "b", 2)
    grid = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.1), (2, 0, 0.9), (2, 1, 0.4)], "k int, h int, v double")
    assert tuple(J.best_parameters(grid, parameters=["k"], half_="h", value="v").first()) == (2, 0.9, 0.4)
    points = spark.createDataFrame([(["a", "b"], ["a"]), (["c"], ["c"])], "e array<string>, k array<string>")
    assert J.retention(points, expected="e", kept="k").first()["have"] == 2
    assert sorted(J.shuffled(list(range(9)), 3, 42)) == list(range(9)) and J.shuffled(list(range(9)), 3, 42) == J.shuffled(list(range(9)), 3, 42)
