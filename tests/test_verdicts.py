"""Verdicts: what a text is compared with is worked out once for each row."""

from pyspark.sql import functions as F

from talkloom.operators import evals


def test_verdicts_normalise_once_for_each_row(spark):
    """Before, each place of a text normalised the whole text and the value again."""
    long = "word " * 4000
    rows = [("1", "alpha", "beta", long + "beta"), ("2", "alpha", "beta", long + "it was beta, now alpha"), ("3", "alpha", "beta", f"beta {long} alpha"), ("4", "alpha", None, "alpha"), ("5", "alpha", "beta", None), ("6", None, "beta", "beta")]
    rows += [("7", "alpha", "aa", "alpha aaa"), ("8", "alpha", "beta", long)]
    facts = spark.createDataFrame(rows, "k string, answer string, stale string, response string")
    got = facts.select("k", evals.verdict(F.lit("tool_value"), F.col("answer"), F.col("stale"), F.col("response")).alias("v"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 3
    assert {r["k"]: r["v"] for r in got.collect()} == {"1": "stale", "2": "correct", "3": "wrong", "4": "correct", "5": "unknown", "6": "stale", "7": "wrong", "8": "wrong"}
