"""Salient lines of tool output, chosen per turn under a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T

# Tools whose output can be read again.
REREADABLE = ["Read", "Grep", "Glob", "LS", "NotebookRead", "WebFetch", "WebSearch", "TodoWrite", "Edit", "Write", "MultiEdit", "NotebookEdit"]
LINES, CHARS, TURN_CHARS, LEAST, FLOOR = 12, 220, 4000, 2, 2


def scored_lines(outputs: DataFrame, key: list[str], text: str, *, least: int = LEAST, labels: bool = True) -> DataFrame:
    """(key, pos, line, score, nth): salient lines, clipped, each once per output (the best), nth by score and position."""
    rows = outputs.select(*key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "__raw")).withColumn("__line", T.trimmed(F.col("__raw")))
    rows = rows.withColumn("score", T.salience(F.col("__line"), labels)).where(F.col("score") >= least)
    rows = rows.select(*key, "pos", T.clip(F.col("__line"), CHARS).alias("line"), "score")
    once = F.row_number().over(W.partitionBy(*key, "line").orderBy(F.desc("score"), "pos"))
    rows = rows.withColumn("__once", once).where("__once = 1").drop("__once")
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "pos")))


def salient_lines(outputs: DataFrame, key: list[str], text: str, lines: int = LINES) -> DataFrame:
    """The best lines of each output; callers order by pos."""
    return scored_lines(outputs, key, text).where(F.col("nth") <= lines).drop("nth")


def turn_evidence(outputs: DataFrame, *, turn: list[str], call: str, head: Column, text: str, turn_chars: int = TURN_CHARS, per_call: int = LINES, floor: int = FLOOR) -> DataFrame:
    """(turn, evidence, used): two passes over the lines of a turn's calls under its budget.

    First the best `floor` lines of each call in order of calls, then the rest by score, call and position.
    A line costs its length and 5, the first of a call also its head and 4; a line that does not fit, or
    that is one too many for its call, is skipped.  The fold runs inside the rows of one turn.
    """
    heads = outputs.select(*turn, call, head.alias("head"))
    lines = scored_lines(outputs, [*turn, call], text).join(heads, [*turn, call])
    first = F.col("nth") <= floor
    order = F.struct(
        F.when(first, 0).otherwise(1).alias("pass"), F.when(first, 0).otherwise(-F.col("score")).alias("by_score"), F.col(call).cast("bigint").alias("call"),
        F.when(first, F.col("nth")).otherwise(F.col("pos")).alias("place"), F.col("pos").cast("bigint").alias("pos"), "line", "head",
    )
    kind = "struct<used:bigint,counts:map<bigint,int>,taken:array<struct<call:bigint,pos:bigint,line:string,head:string>>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.create_map().cast("map<bigint,int>").alias("counts"), F.array().cast("array<struct<call:bigint,pos:bigint,line:string,head:string>>").alias("taken")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        had = F.coalesce(F.try_element_at(acc["counts"], x["call"]), F.lit(0))
        cost = F.length(x["line"]) + 5 + F.when(had > 0, 0).otherwise(F.length(x["head"]) + 4)
        one = F.map_from_arrays(F.array(x["call"]), F.array((had + 1).cast("int")))
        others = F.map_filter(acc["counts"], lambda k, _: k != x["call"])
        entry = F.struct(x["call"].alias("call"), x["pos"].alias("pos"), x["line"].alias("line"), x["head"].alias("head"))
        more = F.struct((acc["used"] + cost).cast("bigint").alias("used"), F.map_concat(others, one).alias("counts"), F.concat(acc["taken"], F.array(entry)).alias("taken")).cast(kind)
        return F.when((had >= per_call) | (acc["used"] + cost > turn_chars), acc).otherwise(more)

    walked = lines.groupBy(*turn).agg(F.aggregate(F.array_sort(F.collect_list(order)), start, step).alias("w"))
    taken = walked.select(*turn, "w.used", F.explode("w.taken").alias("x")).select(*turn, "used", "x.*")
    calls = taken.groupBy(*turn, "used", "call", "head").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    block = F.concat(F.lit("- "), "head", F.lit(":\n"), F.array_join(F.transform("ls", lambda l: F.concat(F.lit("    "), l["line"])), "\n"))
    joined = calls.select(*turn, "used", "call", block.alias("block")).groupBy(*turn, "used").agg(F.array_sort(F.collect_list(F.struct("call", "block"))).alias("bs"))
    return joined.select(*turn, F.array_join(F.transform("bs", lambda b: b["block"]), "\n").alias("evidence"), "used")


def in_call_order(outputs: DataFrame, *, turn: list[str], call: str, head: Column, text: str, turn_chars: int = TURN_CHARS) -> DataFrame:
    """The older rule: (turn, taken calls, used), calls whole or not at all, in order."""
    from talkloom.operators.retrieval import fitted

    best = salient_lines(outputs, [*turn, call], text).groupBy(*turn, call).agg(F.sum(F.length("line") + 5).alias("__size"), F.count(F.lit(1)).alias("n"))
    sized = best.join(outputs.select(*turn, call, head.alias("__head")), [*turn, call])
    rows = sized.select(F.struct(*turn).alias("t"), F.col(call).cast("bigint").alias("c"), (F.col("__size") + F.length("__head") + 4).alias("size"))
    packed = fitted(rows, "t", ["c"], F.col("size"), turn_chars, F.col("c").cast("string"))
    return packed.select("t.*", "taken", "used")
