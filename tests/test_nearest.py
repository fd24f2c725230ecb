"""The nearest match in time against a look at all pairs."""

import random

import pytest

from talkloom.operators import usage

NAMES = {"key": ["k"], "left_id": "a", "right_id": "b", "left_at": "at", "right_at": "used"}


@pytest.mark.parametrize("within", [0, 3, 10])
def test_nearest_is_that_of_all_pairs(spark, within):
    rng = random.Random(3)
    key = lambda: rng.choice(["x", "y", None])
    left = [(i, key(), rng.choice([rng.randint(-300, 300), None] + [5] * (i % 3)), i * 7) for i in range(300)]
    right = [(i, key(), rng.choice([rng.randint(-300, 300), None] + [5, 7] * (i % 2))) for i in range(250)]
    want = []
    for a, k, at, other in left:
        close = [(abs(at - u), b, u) for b, q, u in right if k is not None and q == k and at is not None and u is not None and abs(at - u) <= within]
        if close:
            d, b, u = min(close)
            want.append((a, k, at, other, b, u, d))
    got = usage.nearest(spark.createDataFrame(left, "a long, k string, at long, other long"), spark.createDataFrame(right, "b long, k string, used long"), within=within, **NAMES)
    assert sorted(tuple(r[c] for c in ("a", "k", "at", "other", "b", "used", "distance")) for r in got.collect()) == sorted(want) and len(got.columns) == 7


def test_a_crowded_block_makes_no_pairs(spark):
    """Before, every left row met every right row of its time block and both neighbours."""
    left, right = (spark.range(2000).selectExpr(f"id as {i}", "0L as k", f"id % 50 as {at}") for i, at in (("a", "at"), ("b", "used")))
    got = usage.nearest(left, right, within=600, **NAMES)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and got.where("distance = 0 and b = at").count() == 2000
