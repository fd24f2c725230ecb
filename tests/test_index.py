"""The stored index against scores over the texts themselves: batches, repeated appends, merges, parts of it, pruning."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.operators import retrieval
from talkloom.sources import index

WORDS = [f"word{i}" for i in range(60)] + ["rare1", "rare2"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    docs = [(i if i % 9 else None, f"s{i % 4}" if i % 5 else None, rng.choices(WORDS[:60], k=rng.choice([0, 3, 40])) + (["rare1"] if i == 17 else [])) for i in range(90)]
    docs = list({(a, b): (a, b, c) for a, b, c in docs}.values())
    asked = [(q, rng.choices(WORDS, k=rng.randint(1, 6)) + ["unknown"]) for q in range(12)] + [(99, []), (98, ["unknown"])]
    return spark.createDataFrame(docs, "doc long, part string, words array<string>"), spark.createDataFrame(asked, "q long, terms array<string>")


def want_of(docs, asked, least=2):
    return shown(retrieval.bm25(asked, docs, query_id="q", query_terms=F.col("terms"), doc_key=["doc", "part"], doc_terms=F.col("words"), min_terms=least))


def shown(scored):
    return sorted((r["q"], repr(r["doc"]), repr(r["part"]), r["matched"], round(r["score"], 9)) for r in scored.collect())


def found(spark, path, asked, **more):
    return shown(index.search(spark, path, asked, query_id="q", query_terms=F.col("terms"), key=["doc", "part"], **more))


def test_batches_equal_one_look_at_all_texts(spark, rows, tmp_path):
    docs, asked = rows
    path, key = f"file://{tmp_path}/ix", ["doc", "part"]
    assert found(spark, path, asked) == []
    first, second = docs.where("part = 's1' or part is null"), docs.where("not (part <=> 's1' or part is null)")
    add = lambda df, **more: index.append(df, path, key=key, terms=F.col("words"), buckets=7, **more)
    add(first, batch="one")
    assert found(spark, path, asked) == want_of(first, asked)
    add(docs, batch="two")  # holds the first ones again
    for least in (1, 2):
        assert found(spark, path, asked, min_terms=least) == want_of(docs, asked, least)
    before = sorted(map(tuple, index.commits(spark, path).collect()))
    add(docs, batch="two")
    assert sorted(map(tuple, index.commits(spark, path).collect())) == before and sum(r[1] for r in before) == docs.count()
    add(docs)  # nothing is new
    part = docs.where("doc % 2 = 0").select("doc", "part")
    assert found(spark, path, asked, members=part) == want_of(docs.where("doc % 2 = 0"), asked)
    merged = index.merge(spark, path, key=key)
    assert [r["batch"] for r in index.commits(spark, path).collect()] == [merged] and found(spark, path, asked) == want_of(docs, asked)
    assert index.vacuum(spark, path) == 9 and found(spark, path, asked) == want_of(docs, asked) and index.merge(spark, path, key=key) is None
    add(second.limit(0), batch="none")
    assert found(spark, path, asked) == want_of(docs, asked)


def test_batch_without_commit_does_not_exist(spark, rows, tmp_path):
    docs, asked = rows
    path, key = f"file://{tmp_path}/ix", ["doc", "part"]
    index.append(docs, path, key=key, terms=F.col("words"), batch="one", buckets=5)
    good = found(spark, path, asked)
    spark.read.parquet(f"{path}/postings/batch=one").write.partitionBy("bucket").parquet(f"{path}/postings/batch=dead")
    assert found(spark, path, asked) == good and index.vacuum(spark, path) == 1


def test_only_buckets_that_are_asked_for_are_read(spark, rows, tmp_path):
    docs, _ = rows
    path = f"file://{tmp_path}/ix"
    index.append(docs, path, key=["doc", "part"], terms=F.col("words"), buckets=16)
    asked = spark.createDataFrame([("word3",), ("word8",)], "term string")
    want = {r[0] for r in asked.select(index.bucket_of("term", 16)).collect()}
    read = index.Asked(asked, 16).of(spark.read.parquet(f"{path}/postings"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket") or "bucket#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    files = {f.split("bucket=")[1].split("/")[0] for f in (r[0] for r in read.select(F.input_file_name()).distinct().collect())}
    assert {int(f) for f in files} <= want and {r["term"] for r in read.collect()} == {"word3", "word8"}
    assert "PushedFilters: [" in plan and "word3" in plan


def test_errors(spark, rows, tmp_path):
    docs, _ = rows
    with pytest.raises(ValueError, match="named like"):
        index.append(docs.withColumnRenamed("doc", "len"), f"{tmp_path}/x", key=["len"], terms=F.col("words"))
    with pytest.raises(ValueError, match="twice"):
        index.append(docs.union(docs), f"{tmp_path}/y", key=["doc", "part"], terms=F.col("words"))


def test_many_query_terms_take_the_other_way(spark, rows, tmp_path, monkeypatch):
    docs, asked = rows
    path = f"file://{tmp_path}/ix"
    index.append(docs, path, key=["doc", "part"], terms=F.col("words"), buckets=5)
    want = want_of(docs, asked)
    monkeypatch.setattr(index, "FEW_TERMS", 3)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    assert found(spark, path, asked) == want == want_of(docs, asked)
