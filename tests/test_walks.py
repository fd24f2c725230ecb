"""Ordered walks: state per key, keys over several batches, null keys, empty input."""

from pyspark.sql import functions as F

from talkloom.operators import fold, usage
from talkloom.operators.walks import walk


def test_walk_carries_state_over_batches(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), "id")

    def step(state, at, value):
        state[0] += value
        return (at, state[0]) if at >= 2997 else None

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        made = lambda df: walk(df, key="k", order="id", values={"v": F.col("id")}, start=lambda: [0], step=step, schema="at bigint, total bigint", finish=lambda s: [(-1, s[0])])
        got = sorted((r["k"] or "", r["at"], r["total"]) for r in made(rows).collect())
        sums = {k: sum(i for i in range(3000) if i % 3 == n) for k, n in (("", 0), ("k1", 1), ("k2", 2))}
        assert got == sorted([(k, -1, t) for k, t in sums.items()] + [("", 2997, sums[""]), ("k1", 2998, sums["k1"]), ("k2", 2999, sums["k2"])])
        assert made(rows.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_missing_sizes(spark):
    rows = spark.createDataFrame([("t", 1, None), ("t", 2, 100), ("t", 3, None), ("t", 4, 5)], "thread string, turn int, size int")
    cuts = fold.rolling_cut(rows, thread="thread", turn="turn", size="size", keep=1, budget=50).orderBy("turn").collect()
    assert [(r["cut"], r["rolled"]) for r in cuts] == [(0, False), (0, False), (0, False), (2, True)]
    swept = fold.budget_sweep(rows, spark.createDataFrame([(50,), (500,)], "budget long"), thread="thread", turn="turn", size="size", keep=1)
    assert sorted(map(tuple, swept.collect())) == [(50, "t", 1, 105, 3), (500, "t", 0, 105, 0)]
    sized = spark.createDataFrame([("t", 1, None, 1.0, 100.0), ("t", 2, 95.0, None, 100.0), ("t", 3, 95.0, 1.0, None)], "k string, n long, p double, f double, w double")
    hits = usage.resetting_offset(sized, key="k", order="n", plain="p", fixed="f", window=F.col("w"), summary=0).orderBy("n").collect()
    assert [r["hit"] for r in hits] == [False, True, False]
