"""Messages to turns with window functions; calls to results; run launches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T

# Notes that are not prompts.
IMAGE_NOTE = r"^\s*\[Image: original \d+x\d+, displayed at \d+x\d+\.[^\]]*\]\s*$"
STALE_NOTE = r"changed on disk since you last read it|was modified, either by the user or by a linter"


def is_prompt(role: Column, blocks: Column) -> Column:
    """A user message with text, image or document, no tool result, and not only image notes."""
    kinds = F.transform(blocks, lambda b: b["type"])
    notes = (F.size(blocks) > 0) & F.forall(blocks, lambda b: (b["type"] == "text") & b["text"].rlike(IMAGE_NOTE))
    return (role == "user") & ~notes & ~F.array_contains(kinds, "tool_result") & F.arrays_overlap(kinds, F.array(F.lit("text"), F.lit("image"), F.lit("document")))


def split_turns(messages: DataFrame, *, thread: str, seq: str, role: str, prompt: Column, out: str = "turn") -> DataFrame:
    """Adds the turn number: 0 for the preamble, then counted from 1.

    A prompt opens a turn unless only user messages have come since the last prompt.  Three window
    functions over one partitioning and order, so one shuffle and one sort.
    """
    order = W.partitionBy(thread).orderBy(seq)
    rows = messages.withColumn("__p", prompt).withColumn("__others", F.sum(F.when(F.col(role) != "user", 1).otherwise(0)).over(order))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__at", F.max(F.when(F.col("__p"), F.col("__others"))).over(before))
    opens = F.col("__p") & (F.col("__at").isNull() | (F.col("__others") > F.col("__at")))
    return rows.withColumn(out, F.sum(F.when(opens, 1).otherwise(0)).over(order).cast("int")).drop("__p", "__others", "__at")


def turn_keys(turns: DataFrame, *, thread: str, seq: str, opening: Column, turn: str = "turn") -> DataFrame:
    """(thread, turn, key): 24 hex digits of the opening message's hash; the nth repeat in a thread has ~n."""
    first = turns.where(F.col(turn) > 0).groupBy(thread, turn).agg(F.min_by(T.short_hash(opening, 24), F.col(seq)).alias("print"))
    again = F.row_number().over(W.partitionBy(thread, "print").orderBy(turn)) - 1
    return first.withColumn("key", F.when(again == 0, F.col("print")).otherwise(F.concat_ws("~", "print", again.cast("string")))).select(thread, turn, "key")


def live_prompt(turns: DataFrame, *, thread: str, seq: str, text: str, turn: str = "turn") -> DataFrame:
    """(thread, turn, prompt): the opening prompt of the last turn without tags."""
    first = turns.where(F.col(turn) > 0).groupBy(thread, turn).agg(F.min_by(F.col(text), F.col(seq)).alias("prompt"))
    return first.groupBy(thread).agg(F.max(turn).alias(turn), F.max_by(T.without_tags(F.col("prompt")), F.col(turn)).alias("prompt"))


def call_results(calls: DataFrame, results: DataFrame, *, scope: list[str], call_id: str, seq: str, result_seq: str, last: bool = True, how: str = "inner") -> DataFrame:
    """Calls joined with one result each: the last (within a turn) or the first (over a log) of their id."""
    order = F.col(result_seq).desc() if last else F.col(result_seq).asc()
    one = results.withColumn("__rank", F.row_number().over(W.partitionBy(*scope, call_id).orderBy(order))).where("__rank = 1").drop("__rank")
    return calls.join(one, [*scope, call_id], how)


def without_kept(pairs: DataFrame, kept: DataFrame, *, call_id: str, text: str) -> DataFrame:
    """Pairs whose output does not stand in the context unchanged."""
    return pairs.join(kept.select(call_id, text).distinct(), [call_id, text], "left_anti")


def launch_turns(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """runs (run_id, tool_use_id, prompt) with the turn that launched them, 0 if none.

    By call id where the run names one, else by the prompt of an agent call; the first match counts.
    """
    by_id = calls.groupBy(F.col("call_id").alias("tool_use_id")).agg(F.min("turn").alias("t_id"))
    agents = calls.where(F.col("name").isin("Agent", "Task"))
    by_prompt = agents.groupBy("prompt").agg(F.min("turn").alias("t_prompt"))
    found = runs.join(by_id, "tool_use_id", "left").join(by_prompt, "prompt", "left")
    turn = F.when(F.col("tool_use_id").isNotNull(), F.col("t_id")).otherwise(F.col("t_prompt"))
    return found.select("run_id", F.coalesce(turn, F.lit(0)).alias("turn"))


def narration(rows: DataFrame, *, thread: str, seq: str) -> DataFrame:
    """Assistant rows (thread, turn, seq, text, is_call) with part: "say" where a call follows in the turn, "final" for the last text, else null; and call_no."""
    order = W.partitionBy(thread, "turn").orderBy(seq)
    ahead = order.rowsBetween(1, W.unboundedFollowing)
    calls_ahead = F.coalesce(F.sum(F.col("is_call").cast("int")).over(ahead), F.lit(0))
    texts_ahead = F.coalesce(F.sum(F.when(F.col("text") != "", 1).otherwise(0)).over(ahead), F.lit(0))
    part = F.when(F.col("is_call"), "tool").when(calls_ahead > 0, F.when(F.coalesce("text", F.lit("")) != "", "say")).when((texts_ahead == 0) & (F.coalesce("text", F.lit("")) != ""), "final")
    call_no = F.when(F.col("is_call"), F.sum(F.col("is_call").cast("int")).over(order))
    return rows.withColumns({"part": part, "call_no": call_no})
