"""A stored inverted index: postings in buckets of terms, appended batch by batch, searched without reading a text again.

Layout under one folder, all Parquet:

    postings/batch=B/bucket=N   term, key columns, f (how often), len (terms of the document); sorted by term
    terms/batch=B/bucket=N      term, df (in how many documents of the batch)
    docs/batch=B                key columns, len
    commits/batch=B             docs, terms, buckets, replaces; written last, so a batch without it does not exist
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.operators import retrieval
from talkloom.sources.tables import written

#: Bytes of postings that one file should hold, as Catalyst estimates them; and of a first batch's documents for each bucket.
FILE_BYTES, BUCKET_BYTES = 8 << 20, 1 << 30
#: Buckets of an index whose first batch says nothing else.
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
#: Asked terms up to which they are broadcast and pushed to the scan as bounds.
FEW_TERMS = 100_000
COMMIT = "docs long, terms long, buckets int, replaces array<string>"
OWN = ("term", "f", "len", "bucket", "batch")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, docs, terms, buckets, replaces) of the batches that count: committed ones that no later merge replaces."""
    schema = f"{COMMIT}, batch string"
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema).select("batch", *[c.split()[0] for c in COMMIT.split(", ")])
    rows = spark.read.schema(schema).parquet(f"{path}/commits")
    gone = rows.select(F.explode("replaces").alias("batch"))
    return rows.join(gone, "batch", "left_anti").select("batch", "docs", "terms", "buckets", "replaces")


class _Live:
    """The batches that count, read once by the driver; merges keep them few."""

    def __init__(self, spark: SparkSession, path: str):
        found = commits(spark, path).collect()
        self.batches = sorted(r["batch"] for r in found)
        self.buckets = found[0]["buckets"] if found else None
        self.docs, self.terms = sum(r["docs"] for r in found), sum(r["terms"] for r in found)


def _read(spark: SparkSession, path: str, table: str, batches: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/batch={b}" for b in batches])


def bucket_of(term: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _put(postings: DataFrame, docs: DataFrame, path: str, batch: str, buckets: int, replaces: list[str], key: list[str]) -> None:
    """Write a batch, its commit last.  Frequent terms are spread over files by the key, rare ones share a file."""
    spark = postings.sparkSession
    parts = max(1, -(-_bytes(postings) // FILE_BYTES))
    placed = postings.withColumn("bucket", bucket_of("term", buckets)).repartitionByRange(parts, "bucket", "term", F.xxhash64(*key))
    placed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    counts = postings.groupBy(bucket_of("term", buckets).alias("bucket"), "term").agg(F.count(F.lit(1)).alias("df"))
    counts.repartitionByRange(max(1, parts // 16), "bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/batch={batch}")
    docs.write.mode("overwrite").parquet(f"{path}/docs/batch={batch}")
    held = _read(spark, path, "docs", [batch])
    totals = held.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("terms"))
    row = totals.select("docs", "terms", F.lit(buckets).cast("int").alias("buckets"), F.array(*[F.lit(b) for b in replaces]).cast("array<string>").alias("replaces"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")


def append(docs: DataFrame, path: str, *, key: list[str], terms: Column, batch: str | None = None, buckets: int | None = None) -> str:
    """Add documents to the index as one batch; the batch's name.

    Documents whose key the index holds are left out, so the same rows appended again change nothing; a batch
    whose name is committed is not looked at again.  A key that a batch repeats is an error.  Null keys are keys,
    null terms are no terms; documents without terms count among the documents.  An index keeps the number
    of buckets of its first batch, by default one for each gigabyte of it within bounds (folders, which a
    search lists, are few then; files of a bucket may be many).  A run that dies before its commit leaves files that nobody reads and
    that the next run of the batch overwrites.  One writer at a time.
    """
    spark = docs.sparkSession
    if taken := [c for c in key if c.lower() in OWN]:
        raise ValueError(f"key columns named like the index's own: {taken}")
    batch = batch or uuid.uuid4().hex
    if _exists(spark, f"{path}/commits/batch={batch}/_SUCCESS"):
        return batch
    live = _Live(spark, path)
    buckets = live.buckets or buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, _bytes(docs) // BUCKET_BYTES))
    fresh = docs
    if live.batches:
        held = _read(spark, path, "docs", live.batches).select(*[F.col(f"`{c}`").alias(f"__{c}") for c in key])
        fresh = docs.join(held, reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in key]), "left_anti")
    rows = fresh.select(*key, F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))
    sized = written(rows.withColumn("len", F.size("terms").cast("long")), "index-terms")
    if sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a key occurs twice in one batch")
    # the terms of a document are counted where it lies
    each = sized.withColumn("__row", F.monotonically_increasing_id()).select(*key, "len", "__row", F.explode("terms").alias("term"))
    each = retrieval.counted(each, "__row", term="term", drop=["__row"])
    _put(written(each.select("term", *key, F.col("f").cast("long").alias("f"), "len"), "index-postings"), sized.select(*key, "len"), path, batch, buckets, [], key)
    return batch


def merge(spark: SparkSession, path: str, *, key: list[str]) -> str | None:
    """Make one batch of all that count, without a look at the texts; its name, or None where there is at most one."""
    live = _Live(spark, path)
    if len(live.batches) < 2:
        return None
    batch = f"merged-{uuid.uuid4().hex}"
    postings, docs = (_read(spark, path, table, live.batches) for table in ("postings", "docs"))
    _put(postings.select("term", *key, "f", "len"), docs.select(*key, "len"), path, batch, live.buckets, live.batches, key)
    return batch


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the tables of batches that no search reads any more; how many folders went.  Searches begun before must be over."""
    live, removed = set(_Live(spark, path).batches), 0
    for table in ("postings", "terms", "docs"):
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in fs.listStatus(top) if fs.exists(top) else []:
            if found.getPath().getName().removeprefix("batch=") not in live:
                removed += bool(fs.delete(found.getPath(), True))
    return removed


class Asked:
    """Terms to look up (a column `term`, repeated or not), with the buckets and the range they lie in: one row for each bucket reaches the driver."""

    def __init__(self, rows: DataFrame, buckets: int):
        ends = rows.groupBy(bucket_of("term", buckets).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("lo"), F.max("term").alias("hi")).collect()
        self.rows, self.few = rows.select("term").distinct(), sum(r["n"] for r in ends) <= FEW_TERMS
        self.buckets = sorted(r["b"] for r in ends)
        self.least, self.most = (min(r["lo"] for r in ends), max(r["hi"] for r in ends)) if ends else (None, None)

    def of(self, stored: DataFrame) -> DataFrame:
        """The rows of `postings` or `terms` for the terms: only their buckets' folders are read, of those only the row groups in the terms' range."""
        if not self.buckets:
            return stored.where(F.lit(False))
        stored = stored.where(F.col("bucket").isin(self.buckets) & F.col("term").between(self.least, self.most))
        return stored.join(F.broadcast(self.rows) if self.few else self.rows, "term")


def search(spark: SparkSession, path: str, queries: DataFrame, *, query_id: str, query_terms: Column, key: list[str], min_terms: int = 2, members: DataFrame | None = None) -> DataFrame:
    """(query_id, *key, matched, score), as retrieval.bm25() over all documents of the index gives them.

    The query terms are looked up in the stored terms, which tells their frequencies; then their postings are
    read once.  members: keys of a part of the documents to search, as if only they were there (counts,
    lengths and frequencies are theirs, which reads the postings twice).  An empty index gives no rows.
    """
    live = _Live(spark, path)
    if not live.batches:
        empty = queries.select(query_id).where(F.lit(False))
        return empty.select(query_id, *[F.lit(None).cast("string").alias(c) for c in key], F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("score"))
    asked = written(queries.select(F.col(query_id), F.explode(F.array_distinct(query_terms)).alias("term")), "asked")
    wanted = Asked(asked, live.buckets)
    postings = _read(spark, path, "postings", live.batches).select("term", *key, "len", F.col("f").cast("double").alias("f"), "bucket")
    if members is not None:
        part = members.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in key]).distinct()
        same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in key])
        held = _read(spark, path, "docs", live.batches).join(part, same, "left_semi")
        stats = held.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("len").cast("double")).alias("avg"))
        tf = wanted.of(postings).join(part, same, "left_semi")
        return retrieval.scored(asked, tf, stats, query_id=query_id, doc_key=key, min_terms=min_terms, few=wanted.few)
    counts = wanted.of(_read(spark, path, "terms", live.batches)).groupBy("term").agg(F.sum("df").cast("double").alias("df"))
    known = written(asked.join(counts, "term"), "asked-known")
    stats = [F.lit(float(live.docs)).alias("n"), F.lit(live.terms / live.docs if live.docs else 0.0).alias("avg")]
    # the join with the known terms is the one that scores, so the postings need no other
    inside = postings.where(F.col("bucket").isin(wanted.buckets) & F.col("term").between(wanted.least, wanted.most)) if wanted.buckets else postings.where(F.lit(False))
    return retrieval.combined(known.select("*", *stats), inside.drop("bucket"), query_id=query_id, doc_key=key, min_terms=min_terms, few=wanted.few)
