"""Budgets that cut inside a row, source lines, and resampling that equals one walk of the generator."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.operators import evals, material


def test_last_characters(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, "", "a", "bc" * rng.randint(0, 9), "é" * 5])) for g in [None, *range(30)] for i in range(rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "g int, i int, t string").repartition(3)
    for budget in (0, 1, 7, 20, 1000):
        got = {}
        for r in material.last_characters(df, group="g", order=["i"], text="t", budget=budget).collect():
            got.setdefault(r["g"], []).append((r["i"], r["t"], r["__whole"]))
        for g in {r[0] for r in rows}:
            whole = "\n".join(r[2] or "" for r in rows if r[0] == g)
            mine = sorted(got[g])
            assert "\n".join(t for _, t, _ in mine) == whole[max(0, len(whole) - budget) :] and {w for *_, w in mine} == {len(whole) <= budget}


def test_last_characters_of_a_large_group(spark):
    """A group a thousand times its budget in one partition, and one of one long row."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), "id", F.lpad(F.col("id").cast("string"), 9, "x").alias("t")).union(spark.createDataFrame([(2, 0, "y" * 300_000)], "g int, id long, t string"))
    got = material.last_characters(df, group="g", order=["id"], text="t", budget=2_000).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars")).collect()
    assert {r["g"]: (r["n"], r["chars"]) for r in got} == {1: (201, 2_000 - 200), 2: (1, 2_000)}


def test_source_lines_and_transcripts(spark):
    rows = [
        ("a", 0, 0, "said", None, "before all"), ("a", 1, 0, "prompt", None, "p" * 3000), ("a", 2, 0, "said", None, " \n"), ("a", 2, 1, "call", "Run", "ls   -l\n x"),
        ("a", 3, 0, "output", None, "one\n two"), ("a", 4, 0, "prompt", None, None), ("b", 0, 0, "said", None, "no prompt"),
    ]
    parts = spark.createDataFrame(rows, "thread string, seq int, n int, kind string, name string, text string")
    lines = [r["line"] for r in material.source_lines(parts, thread="thread", seq="seq").orderBy("seq", "n").collect()]
    assert lines == ["\n### Turn 1 (1 before the cut)\nUSER: " + "p" * 2500, "TOOL CALL Run: ls -l x", "TOOL OUTPUT: one two", "\n### Turn 2 (IN PROGRESS when the context filled)\nUSER: "]
    after = spark.createDataFrame([("a", 9, "z" * 2000), ("a", 8, "first"), ("a", 10, "third")], "thread string, seq int, text string")
    got = material.source_material(parts, after, thread="thread", seq="seq", budget=60).collect()
    assert len(got) == 1 and got[0]["text"] == f"{material.TRUNCATED}{chr(10).join(lines)[-60:]}\n\n{material.NEXT_HEAD}\nfirst\n---\n{'z' * 1200}"
    shown = [r["part"] for r in material.transcript_parts(parts, thread="thread", seq="seq").orderBy("seq", "n").collect()]
    assert shown == ["### Turn 1\n\n**You:** " + "p" * 3000, "[tool] ls   -l\n x", "```\none\n two\n```", "### Turn 2\n\n**You:** "]


def walk(seed):
    while True:
        seed = (seed * 1_664_525 + 1_013_904_223) % 2**32
        yield seed


def test_jumps_equal_steps():
    states, rand = [7], walk(7)
    states += [next(rand) for _ in range(300)]
    assert [evals.jumped(7, k) for k in range(301)] == states
    assert all(evals.stepped(states[k], n).tolist() == states[k + 1 : k + 1 + n] for k, n in ((0, 0), (0, 1), (3, 2), (5, 64), (10, 200)))


@pytest.mark.parametrize("block", [1, 50, 1 << 20])
def test_bootstrap_equals_one_walk(spark, monkeypatch, block):
    monkeypatch.setattr(evals, "STEP_BLOCK", block)
    rng = random.Random(3)
    rows = [(arm, p, 100 - p, rng.choice([None, rng.uniform(-1, 1)])) for arm, points in (("x", 9), ("y", 1), (None, 4)) for p in range(points) for _ in range(3)]
    got = {r["arm"]: tuple(r)[1:] for r in evals.bootstrap_points(spark.createDataFrame(rows, "arm string, point int, o int, diff double"), arm="arm", point="point", order="o", diff="diff", draws=80).collect()}
    for arm in {r[0] for r in rows}:
        per = {}
        for a, p, _, d in rows:
            if a == arm and d is not None:
                per.setdefault(p, []).append(d)
        xs = [sum(per[p]) / len(per[p]) for p in sorted(per, reverse=True)]
        rand, n = walk(evals.STEP_SEED), len(xs)
        means = sorted(sum(xs[int(next(rand) / 2**32 * n)] for _ in range(n)) / n for _ in range(80))
        want = (n, sum(xs) / n, means[2], means[78], sum(x > 0 for x in xs), sum(x < 0 for x in xs))
        assert got[arm] == pytest.approx(want, abs=1e-12)
