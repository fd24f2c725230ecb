"""Batches of the stored index are sorted in many tasks."""

from pyspark.sql import functions as F

from talkloom.sources import index


def test_postings_of_some_megabytes_lie_in_several_files(spark, tmp_path):
    """Before, up to 64 MB of compressed postings were sorted and written by one task."""
    docs = spark.range(6000).select("id", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(100_000)))).alias("words"))
    index.append(docs, f"file://{tmp_path}/ix", key=["id"], terms=F.col("words"), batch="one", buckets=1)
    stored = spark.read.parquet(f"file://{tmp_path}/ix/postings")
    assert len(stored.inputFiles()) > 1 and stored.agg(F.sum("f")).first()[0] == 6000 * 300
