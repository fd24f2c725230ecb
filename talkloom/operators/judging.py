"""Grades by several judges, lookups, samples and small choices used when strategies are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.operators.evals import mixing


def mean_grades(grades: DataFrame, *, unit: str, arm: str, most: float = 2.0) -> DataFrame:
    """(unit, arm, pct): mean over questions of the mean over judges and replicates, in per cent of the highest grade."""
    per = grades.groupBy(unit, arm, "question", "replicate").agg(F.avg("score").alias("s")).groupBy(unit, arm, "question").agg(F.avg("s").alias("s"))
    return per.groupBy(unit, arm).agg((F.avg("s") * F.lit(100.0 / most)).alias("pct"))


def pooled_labels(grades: DataFrame, key: list[str]) -> DataFrame:
    """One label for each answer: any "wrong" wins, "unknown" needs all judges, else the best."""
    n = F.count(F.lit(1))
    return grades.groupBy(*key).agg(F.when(F.count_if(F.col("label") == "wrong") > 0, "wrong").when(F.count_if(F.col("label") == "unknown") == n, "unknown").otherwise("correct").alias("label"))


def agreement(grades: DataFrame, key: list[str]) -> DataFrame:
    """(pairs, exact, within_one): shares over answers that the first two judges (by place) both graded."""
    pair = grades.where("place <= 2").groupBy(*key).agg(F.max(F.when(F.col("place") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("b")).where("a is not null and b is not null")
    gap = F.abs(F.col("a") - F.col("b"))
    return pair.agg(F.count(F.lit(1)).alias("pairs"), F.avg((gap == 0).cast("int")).alias("exact"), F.avg((gap <= 1).cast("int")).alias("within_one"))


def question_shapes(scores: DataFrame, key: list[str]) -> DataFrame:
    """(dead, aced, separating): questions that every arm fails, every arm solves, or that tell arms apart."""
    per = scores.groupBy(*key).agg(F.max("score").alias("hi"), F.min("score").alias("lo"))
    dead, aced = F.col("hi") == 0, F.col("lo") == 2
    return per.agg(F.count_if(dead).alias("dead"), F.count_if(aced).alias("aced"), F.count_if(~dead & ~aced).alias("separating"))


def needs_lookup(strategy: Column, kind: Column, ago: Column, kept: Column) -> Column:
    """Whether an answer lies outside what a strategy keeps; null where that is not known.

    Strategies: reduced (no output kept), rolling (three turns kept), tail (`kept` turns kept), whole.
    """
    asked = kind.isin("tool_evidence", "recent") & (F.coalesce(ago, F.lit(0)) != 0)
    return F.when(~asked, F.lit(False)).when(strategy == "reduced", F.lit(True)).when(strategy == "rolling", ago > 3).when((strategy == "tail") & (kept > 0), ago >= kept).when(strategy == "whole", F.lit(False))


def tool_key(name: Column, command: Column) -> Column:
    """A call's tool; a shell call's first known reading command."""
    first = F.regexp_extract(command, r"\b(rg|grep|jq|sed|awk|cat|head|tail|ls)\b", 1)
    return F.when(name == "Bash", F.when(first != "", first).otherwise("bash")).otherwise(name)


def lookups(calls: DataFrame, *, key: str) -> DataFrame:
    return calls.groupBy(key, tool_key(F.col("name"), F.col("command")).alias("tool")).agg(F.count(F.lit(1)).alias("n"))


def lookup_hits(questions: DataFrame, results: DataFrame, *, unit: str) -> DataFrame:
    """Questions whose answer (three characters and more) stands in a later result of their unit.

    Results are tested one by one and met by their unit; they are never joined to one long text.
    """
    flat = lambda c: T.collapse(F.lower(F.col(c)))
    asked = questions.where(F.col("type").isin("tool_evidence", "recent")).withColumn("__a", flat("answer")).where(F.length("__a") >= 3)
    return asked.join(results.withColumn("__r", flat("text")).select(unit, "__r"), (asked[unit] == results[unit]) & F.contains("__r", F.col("__a")), "left_semi").drop("__a")


def retention(points: DataFrame, *, expected: str, kept: str) -> DataFrame:
    """(have, total, share) of expected items that are kept, over all points; both are arrays."""
    rows = points.select(F.explode(F.array_distinct(expected)).alias("i"), F.col(kept).alias("k")).withColumn("has", F.array_contains("k", F.col("i")).cast("int"))
    return rows.agg(F.sum("has").alias("have"), F.count(F.lit(1)).alias("total"), F.avg("has").alias("share"))


def best_parameters(scored: DataFrame, *, parameters: list[str], half_: str, value: str) -> DataFrame:
    """The parameters with the highest mean on half 0 (the first listed on ties), and their mean on half 1."""
    mean = scored.groupBy(*parameters).agg(F.avg(F.when(F.col(half_) == 0, F.col(value))).alias("tuned"), F.avg(F.when(F.col(half_) == 1, F.col(value))).alias("checked"))
    return mean.orderBy(F.desc("tuned"), *parameters).limit(1)


def half(text: Column) -> Column:
    """0 or 1 from a 32-bit hash with multiplier 31 over the characters, from 7."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return (F.aggregate(codes, F.lit(7).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32))) % 2).cast("int")


def closest(options: DataFrame, given: str, name: str, most: int = 2) -> DataFrame:
    """The option with the fewest edits, first in the list on ties, if there are `most` at most."""
    edits = F.levenshtein(F.lit(given), F.col(name))
    return options.withColumn("edits", edits).orderBy("edits", "pos").limit(1).where(F.col("edits") <= most).select(name, "edits")


def by_probability(candidates: DataFrame, *, query: str, place: str, p: str) -> DataFrame:
    """Candidates by falling probability, missing ones as 0, ties in their old order."""
    order = W.partitionBy(query).orderBy(F.coalesce(p, F.lit(0.0)).desc(), place)
    return candidates.withColumn("rank", F.row_number().over(order))


def picked_first(ranked: DataFrame, picks: DataFrame, *, query: str, item: str) -> DataFrame:
    """A base ranking with picked items in front, in the order of the picks; the rest keeps its order."""
    both = ranked.join(picks.select(query, item, F.col("pick").alias("__pick")), [query, item], "left")
    order = W.partitionBy(query).orderBy(F.col("__pick").asc_nulls_last(), "rank")
    return both.withColumn("rank", F.row_number().over(order)).drop("__pick")


def last_or(ranked: DataFrame, pool: DataFrame, *, query: str, item: str) -> DataFrame:
    """Each query's best ranked item, else the first of its pool."""
    best = ranked.where("rank = 1").select(query, F.col(item).alias("__best"))
    first = pool.groupBy(query).agg(F.min_by(item, "place").alias("__first"))
    return first.join(best, query, "left").select(query, F.coalesce("__best", "__first").alias(item))


def deferred(judged: DataFrame, *, query: str, least: float) -> DataFrame:
    """The pick of the first message whose judge is sure enough; no row where none is."""
    return judged.where(F.col("p") >= least).groupBy(query).agg(F.min_by("pick", "message").alias("pick"), F.min("message").alias("message"))


def shuffled(items: list, index: int, seed: int) -> list:
    """A seeded order of a short list (the labels of one page of answers), swapping from the end."""
    rand, out = mixing((seed + index * 7919) & 0xFFFFFFFF), list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(next(rand) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out
