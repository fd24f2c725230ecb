"""Exact deduplication by content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.llm.common import body, cut, partitions_for

#: Leading bytes of a content in the splitters; what the driver samples has a fixed size per row.
HEAD_BYTES = 32
#: Sampled rows for each output partition, on average, from which hot contents are told.
SAMPLED = 64
#: A content is split where it fills about this part of an output partition or more.
HOT = 0.5


def hot_contents(keyed: DataFrame, rows: int, parts: int) -> DataFrame:
    """(mark, salts) of the contents that fill HOT of an output partition or more, as a sample tells.

    There are 2 * parts / HOT of them at most, each of which holds that share of the sample, so the table
    may be broadcast.  A content that the sample misses is not split, which costs balance, not rows.
    """
    share = min(1.0, SAMPLED * parts / max(rows, 1))
    least = max(2.0, HOT * share * rows / parts)
    drawn = keyed.select("mark") if share == 1.0 else keyed.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("mark")
    found = drawn.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(least / 2))
    return found.select(F.col("mark").alias("hot"), F.ceil(F.col("n") / F.lit(least / 2)).cast("long").alias("salts"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Sampled splitters range-partition the contents by leading bytes and hash, an external sort places equal
    contents next to each other, and a run ends where the full content of two neighbours differs; its best
    identifier stays.  Only contents that the sample shows to fill half a partition or more are spread over
    several partitions by a salt from the identifier; the leaders of their runs, one for each salt, meet
    again by their full contents.

    Null texts count as empty; the empty text is a text like others.  Null identifiers lose against all
    others, so a group of null identifiers only has a null keep_id and keeps them.  Rows that repeat an
    identifier and a text share the answer, and one partition.  A text of any length is compared whole.
    An empty table gives an empty table.  Other columns are not looked at.
    """
    best, first = {"smallest": (F.min, F.asc_nulls_last), "largest": (F.max, F.desc_nulls_last)}[keep]
    text = body(text_col) if normalise is None else normalise
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(text, "UTF-8").alias("content")).withColumn("mark", F.xxhash64("content"))
    parts = partitions_for(docs)
    hot = cut(hot_contents(rows, docs.select(id_col).count(), parts), "exact-hot")
    salts = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(0)
    keyed = rows.join(F.broadcast(hot), F.col("mark") == F.col("hot"), "left").withColumns({"head": F.substring("content", 1, HEAD_BYTES), "salt": salts})
    place = ["head", "mark", "salt"]
    run = W.partitionBy(*place, "content")
    ranked = run.orderBy(first("doc_id"))
    runs = keyed.repartitionByRange(parts, *place).select(
        "doc_id", F.col("hot").isNotNull().alias("split"), "salt", F.first("doc_id").over(ranked).alias("keep_id"), F.count(F.lit(1)).over(run).alias("group_size"),
        F.sha2("content", 256).alias("sha"), F.when(F.col("hot").isNotNull() & (F.row_number().over(ranked) == 1), F.col("content")).alias("leader"),
    )
    runs = cut(runs, "exact-runs")
    leaders = runs.where("leader is not null")
    merged = leaders.groupBy("leader").agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.first("sha").alias("sha"))
    merged = cut(merged.select(F.col("sha").alias("of"), F.col("keep_id").alias("best_id"), F.col("group_size").alias("rows")), "exact-merged")
    answers = runs.drop("leader").join(F.broadcast(merged), F.col("split") & (F.col("sha") == F.col("of")), "left")
    keep_id, size = (F.when(F.col("split"), F.col(a)).otherwise(F.col(b)) for a, b in (("best_id", "keep_id"), ("rows", "group_size")))
    return answers.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))
