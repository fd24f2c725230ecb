"""Streams agree with their batch twins."""

from pyspark.sql import functions as F

from talkloom.operators import usage
from talkloom.streaming import jobs


def test_compaction_state_matches_batch(spark, tmp_path):
    rows = [(f"t{i % 3}", i, float(i % 17 * 1000), None if i % 5 == 0 else 10.0, 9000.0) for i in range(120)]
    df = spark.createDataFrame(rows, "thread string, seq long, plain double, fixed double, window double")
    for k in range(3):
        df.where(f"seq >= {k * 40} and seq < {k * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.compaction_alerts(stream).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["thread"], r["seq"]): r["hit"] for r in spark.table("alerts").collect()}
    batch = usage.resetting_offset(df, key="thread", order="seq", plain="plain", fixed="fixed", window=F.col("window"))
    assert got == {(r["thread"], r["seq"]): r["hit"] for r in batch.collect()} and any(got.values())


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.write_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["id"], at="at").awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_watch(spark):
    rows = spark.createDataFrame([(0, False), (1, False), (2, False), (2, True), (0, True)], "m int, alive boolean")
    got = [tuple(r["w"]) for r in rows.select(jobs.next_watch(F.col("m"), F.col("alive")).alias("w")).collect()]
    assert got == [(1, "none"), (2, "pause"), (3, "none"), (0, "resume"), (0, "none")]
