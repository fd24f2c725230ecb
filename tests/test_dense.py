"""The dense search by blocks against a plain look at all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talkloom.operators import dense, retrieval


def brute(spark, queries, vectors, k):
    scored = queries.crossJoin(vectors).where("q <> v").select("q", "v", F.round(retrieval.dot(F.col("x"), F.col("e")), 5).alias("score"))
    return shown(retrieval.ranked(scored, "q", ["v"], k))


def shown(rows):
    return sorted((r["q"], r["rank"], r["v"], repr(r["score"])) for r in rows.select("q", "v", "rank", "score").collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_find_what_all_pairs_hold(spark, kind, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.000015, rng.random()]) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # copies: ties go by key
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [1.0]), (303, []), (304, [math.nan] * 6), (305, [math.inf] + [0.0] * 5), (306, []), (None, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, f"v long, e array<{kind}>")
    queries = vectors.where("v % 5 = 0 or v > 299").toDF("q", "x")
    monkeypatch.setattr(dense, "BLOCK", 32)
    monkeypatch.setattr(dense, "STRIP", 16)
    monkeypatch.setattr(dense, "PAIRS", 50)
    for k in (1, 10, 300):
        got = retrieval.dense_topk(queries, vectors, query_id="q", query_vec="x", key="v", vec="e", k=k)
        assert shown(got) == brute(spark, queries, vectors, k)


def test_names_as_keys(spark):
    vectors = spark.createDataFrame([(f"n{i}", [float(i % 5), 1.0]) for i in range(30)], "v string, e array<double>")
    queries = vectors.where("v < 'n2'").toDF("q", "x")
    assert shown(retrieval.dense_topk(queries, vectors, query_id="q", query_vec="x", key="v", vec="e", k=4)) == brute(spark, queries, vectors, 4)


def test_rows_meet_queries_by_blocks(spark):
    """Before, every pair of a row and a query was a row of the plan, and each partition of the input sent its own best k."""
    vectors = spark.range(3000).select(F.col("id").alias("v"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("e"))
    queries = vectors.where("v % 20 = 0").toDF("q", "x")
    plan = retrieval.dense_topk(queries, vectors, query_id="q", query_vec="x", key="v", vec="e", k=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "zip_with" not in plan


def test_rounding_is_sparks(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-3, 3) for _ in range(2000)] + [i / 200000 for i in range(-2001, 2001, 2)] + [1e20, -1e15, 123456789.000005, 0.0, math.inf]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 5)).collect()]
    import numpy as np

    assert dense.rounded(np.array(xs)).tolist() == want
