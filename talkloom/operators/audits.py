"""Checks of planted facts and their questions, tables of verdicts, costs and retrieval arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.functions import text as T
from talkloom.operators import usage

JUNK = r"^\s*(\[Request interrupted|⟩|\[kn\]|Type help|test\s*$)|^\s*\d+\s*\t"  # fixed value


def is_junk(prompt: Column) -> Column:
    """A prompt that starts no work: marks of interruptions and pasted output, or less than three different terms. Null is junk."""
    return F.coalesce(prompt.rlike(JUNK) | (F.size(F.array_distinct(T.terms(prompt))) < 3), F.lit(True))


def revealed(text: Column, values: Column) -> Column:
    """Those values that the text holds, both normalised; each once, nulls and empty ones never."""
    told = T.normalised(text)
    return F.array_distinct(F.filter(values, lambda v: F.coalesce((T.normalised(v) != "") & F.contains(told, T.normalised(v)), F.lit(False))))


def plant_errors(plants: DataFrame) -> DataFrame:
    """plants with errors, the broken rules of a fact's type, in order.

    plants: type, value, and of the turn that should hold the value the texts outputs, failed (output of failed steps), prose, user, reply
    and spoken. The value of a decision or promise lists parts with a bar between; each must be spoken. A null text counts as empty.
    """
    has = lambda name: F.contains(F.coalesce(F.col(name), F.lit("")), F.col("value"))
    of = lambda *types: F.col("type").isin(*types)
    silent = F.exists(F.split("value", r"\|", -1), lambda part: ~F.contains(F.coalesce(F.col("spoken"), F.lit("")), part))
    rules = [
        (of("tool_value", "prose_value", "superseded") & ~has("outputs"), "not in output"),
        (of("error") & ~has("failed"), "not in failed output"),
        (of("tool_value", "error") & has("prose"), "in prose"),
        (of("prose_value") & ~has("reply"), "not in reply"),
        (of("instruction", "revised") & ~has("user"), "not in prompt"),
        (of("decision", "promise") & silent, "not spoken"),
    ]
    return plants.withColumn("errors", F.array_compact(F.array(*(F.when(broken, F.lit(name)) for broken, name in rules))))


def leak_errors(plants: DataFrame, turns: DataFrame, *, session: str) -> DataFrame:
    """(session, fact, value, turn): turns that hold a part of a planted value and are not among the turns it was planted in.

    plants: fact, turn, value; turns: turn, text. Facts meet the turns of their own session only; a fact's turns come from its few plants.
    """
    parts = plants.select(session, "fact", F.col("turn").alias("__turn"), F.explode(F.split("value", r"\|", -1)).alias("value")).where("value <> ''")
    parts = parts.groupBy(session, "fact", "value").agg(F.collect_set("__turn").alias("__turns"))
    found = turns.join(parts, session).where(F.contains("text", F.col("value")) & ~F.array_contains("__turns", F.col("turn")))
    return found.select(session, "fact", "value", "turn").distinct()


def question_errors(questions: DataFrame) -> DataFrame:
    """questions (question, task, answer, stale, implicit) with errors: what is missing or tells the answer."""
    empty = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    asked = F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("task", F.lit("")))
    told = F.coalesce(F.contains(asked, F.col("answer")), F.lit(False)) | F.coalesce((F.col("stale") != "") & F.contains(asked, F.col("stale")), F.lit(False))
    rules = [(empty("question"), "no question"), (told, "tells the value"), (F.coalesce("implicit", F.lit(False)) & empty("task"), "no task")]
    return questions.withColumn("errors", F.array_compact(F.array(*(F.when(broken, F.lit(name)) for broken, name in rules))))


def answered(results: DataFrame, *, answers: Column) -> DataFrame:
    """Runs that answered anything; a run without answers is no result."""
    return results.where(F.coalesce(F.size(answers), F.lit(0)) > 0)


def verdict_counts(verdicts: DataFrame, key: list[str], *, verdict: str = "verdict") -> DataFrame:
    """(key, n, correct, stale, wrong, unknown, accuracy); a null verdict does not count, and without any the accuracy is null."""
    each = [F.count_if(F.col(verdict) == v).alias(v) for v in ("correct", "stale", "wrong", "unknown")]
    found = verdicts.groupBy(*key).agg(F.count(verdict).alias("n"), *each)
    return found.withColumn("accuracy", F.try_divide(F.col("correct"), F.col("n")))


def cost_table(runs: DataFrame, *, arm: str, size: str, means: list[str]) -> DataFrame:
    """(arm, size, means): the middle of the sizes that are not zero (upper one of two, 0 without any) and plain means."""
    middle = usage.nth_ascending(runs.where(F.col(size) != 0), [arm], size, 0.5, size)
    plain = runs.groupBy(arm).agg(*(F.avg(name).alias(name) for name in means))
    return plain.join(middle, arm, "left").withColumn(size, F.coalesce(size, F.lit(0)))


def retrieval_report(asked: DataFrame, *, arm: str, rank: str, hit: str, ms: str, tops: tuple[int, int] = (12, 30)) -> DataFrame:
    """(arm, asked, hits, within, among, middle_ms, p95_ms) of one row per question: rank of the first chunk with the answer (null: none),
    whether the rendered context held it, and the time taken."""
    near, far = tops
    counts = asked.groupBy(arm).agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.col(hit)).alias("hits"), F.count_if(F.col(rank) <= near).alias("within"), F.count_if(F.col(rank) <= far).alias("among")
    )
    for name, share in (("middle_ms", 0.5), ("p95_ms", 0.95)):
        counts = counts.join(usage.nth_ascending(asked, [arm], ms, share, name), arm, "left")
    return counts


def report_totals(runs: DataFrame, *, sums: list[str], peaks: list[str]) -> DataFrame:
    """One row: sums of counters and peaks over all runs, zeros where there are none."""
    return runs.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums), *(F.coalesce(F.max(n), F.lit(0)).alias(n) for n in peaks))


def both_ends(lines: Column, most: int = 400) -> Column:
    """Structs (i, line) of the first and the last most / 2 lines, or of all where there are no more than most."""
    n, half = F.size(lines), most // 2
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return F.when(n <= most, numbered).otherwise(F.concat(F.slice(numbered, 1, half), F.slice(numbered, -half, half)))


def chunk_text(call: Column, lines: Column, most: int = 1_200) -> Column:
    """What a ranker sees of a chunk."""
    return F.substring(F.concat_ws("\n", call, F.array_join(lines, "\n")), 1, most)
