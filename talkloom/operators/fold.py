"""Folding of finished turns: whole views under a cap, carried notes, the rolling cut."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.operators.walks import walk

#: Budgets that one sweep may compare.
MOST_BUDGETS = 1_000


def folded_view(turns: DataFrame, *, thread: str, turn: str, full: Column, short: Column, cap: int | Column) -> DataFrame:
    """(thread, turn, is_full, text): newest turns in full until the first that would pass the cap, then user text only."""
    rows = turns.select(thread, turn, full.alias("__full"), short.alias("__short"), (F.lit(cap) if isinstance(cap, int) else cap).alias("__cap"))
    newest = W.partitionBy(thread).orderBy(F.desc(turn))
    used = F.sum(F.length("__full")).over(newest.rowsBetween(W.unboundedPreceding, 0))
    # sizes are never negative, so the running sum passes the cap once and stays there
    is_full = used <= F.col("__cap")
    return rows.select(thread, turn, is_full.alias("is_full"), F.when(is_full, F.col("__full")).otherwise(F.col("__short")).alias("text"))


def folded_turns(messages: DataFrame, *, thread: str, seq: str, role: str, text: str, evidence: DataFrame | None = None) -> DataFrame:
    """(thread, turn, user, evidence, reply) of turns: user text without injected blocks, evidence if given, last assistant text."""
    rows = messages.where("turn > 0").withColumn("__said", T.spoken(F.col(text)))
    own = F.when((F.col(role) == "user") & (F.col("__said") != ""), F.struct(F.col(seq).alias("s"), F.col("__said").alias("t")))
    user = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["t"]), "\n\n")
    reply = F.max_by(F.when(F.col(role) == "assistant", F.col("__said")), F.when(F.col(role) == "assistant", F.col(seq)))
    out = rows.groupBy(thread, "turn").agg(user.alias("user"), F.coalesce(reply, F.lit("")).alias("reply"))
    out = out.withColumn("evidence", F.lit("")) if evidence is None else out.join(evidence.select(thread, "turn", "evidence"), [thread, "turn"], "left").fillna("", ["evidence"])
    return out.select(thread, "turn", "user", "evidence", "reply")


def rendered(full: bool) -> Column:
    """A folded turn as text, with evidence and reply if full."""
    parts = [F.concat(F.lit("### Turn "), F.col("turn").cast("string")), F.concat(F.lit("**You:** "), F.col("user"))]
    if full:
        parts += [F.when(F.col("evidence") != "", F.col("evidence")), F.when(F.col("reply") != "", F.concat(F.lit("**Agent:** "), F.col("reply")))]
    return F.concat_ws("\n\n", *parts)


def carried(notes: DataFrame, *, thread: str, seq: str, text: str, most: int = 80_000) -> DataFrame:
    """(thread, taken, used): distinct notes, newest first, each that still fits; one too large is skipped, not the rest."""
    from talkloom.operators.retrieval import fitted

    newest = notes.groupBy(thread, text).agg(F.max(seq).alias("__at")).withColumn("__order", -F.col("__at"))
    return fitted(newest, thread, ["__order", text], F.length(text), most, F.col(text))


def capped_turns(turns: DataFrame, *, thread: str, cap: int, size: str = "size") -> DataFrame:
    """Adds reduced: middle turns larger than the cap; the first and the last turn stay whole."""
    last = F.max("turn").over(W.partitionBy(thread))
    return turns.withColumn("reduced", (F.col(size) > cap) & (F.col("turn") > 1) & (F.col("turn") < last))


def cleared_results(blocks: DataFrame, *, thread: str, seq: str, first: int, count: int) -> DataFrame:
    """Adds cleared: the next `count` tool results from the one numbered `first` on (from 0)."""
    nth = F.sum(F.col("is_result").cast("int")).over(W.partitionBy(thread).orderBy(seq)) - 1
    return blocks.withColumn("cleared", F.col("is_result") & (nth >= first) & (nth < first + count))


def rolling_cut(turns: DataFrame, *, thread: str, turn: str, size: str, keep: int = 3, budget: int = 100_000, interrupted: str | None = None) -> DataFrame:
    """(thread, turn, cut, rolled): how many turns stand in front of the cut when each turn is the open one.

    The open turn and `keep` turns before it are never folded.  Once the turns between the cut and those weigh
    more than the budget, the cut moves up to them, so the kept prefix changes in steps.  A cut in front of an
    interrupted turn (a flag column) settles further down, at a turn that is not, or behind the first turn.
    The rule feeds back into itself: a walk along each thread carries the last keep + 1 places where a cut
    could fall, with the sizes in front of them.  Null sizes count as 0, null flags as false.
    """
    broken = F.lit(False) if interrupted is None else F.coalesce(F.col(interrupted), F.lit(False))

    def start() -> list:
        return [deque(), 0, 0, (0, 0)]  # places (turns, their size) of possible cuts, turns seen, their size, the cut's place

    def step(state: list, at: int, size: int, broken: bool) -> tuple:
        places, seen, total, cut = state
        places.append((seen, total) if seen <= 1 or not broken else places[-1])
        if len(places) > keep + 1:
            places.popleft()
        due = places[0]
        rolled = len(places) == keep + 1 and due[0] > cut[0] and due[1] - cut[1] > budget
        state[1:] = [seen + 1, total + size, due if rolled else cut]
        return at, state[3][0], rolled

    return walk(turns, key=thread, order=turn, values={"size": _size(size), "broken": broken}, start=start, step=step, schema="turn bigint, cut bigint, rolled boolean")


def shrink_steps(threads: DataFrame, *, limit: str = "target") -> DataFrame:
    """Threads over their target: keep falls by one to 0, then half of the clearable results go at a time.

    In: thread, keep, results, protected, turn_size, result_size, size, target.  Out: thread, keep, cleared,
    size, stuck.  A narrow per-row state machine; batches of rows, no shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                keep, cleared, size, target = r.keep, 0, r.size, getattr(r, limit)
                while size > target and keep > 0:
                    keep, size = keep - 1, size - r.turn_size
                while size > target and r.results - r.protected - cleared > 0:
                    more = (r.results - r.protected - cleared + 1) // 2
                    cleared, size = cleared + more, size - more * r.result_size
                out.append((r.thread, keep, cleared, size, size > target))
            yield pd.DataFrame(out, columns=["thread", "keep", "cleared", "size", "stuck"])

    return threads.mapInPandas(run, "thread string, keep long, cleared long, size long, stuck boolean")


def budget_sweep(turns: DataFrame, budgets: DataFrame, *, thread: str, turn: str, size: str, keep: int = 3) -> DataFrame:
    """(budget, thread, steps, peak, last): folds, largest unfolded size and the turn (from 0) of the last fold, for each budget.

    As in rolling_cut() the open turn and `keep` before it stay, without settling; peak looks at requests that
    have something to fold, from turn keep + 2 on, and is 0 where there is none.  At most MOST_BUDGETS budgets,
    a larger set is an error.  Null sizes count as 0.
    """
    asked = sorted({r["budget"] for r in budgets.select("budget").limit(MOST_BUDGETS + 1).collect()})
    if len(asked) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")

    def start() -> list:
        return [deque(), 0, 0, *[[b, 0, 0, 0, 0] for b in asked]]  # sizes in front of the last turns, turns seen, their size; budget, size in front of the cut, folds, peak, last fold

    def step(state: list, at: int, size: int) -> None:
        places, seen, total = state[:3]
        places.append(total)
        total += size
        state[1:3] = [seen + 1, total]
        if len(places) <= keep + 1:
            return
        places.popleft()
        for per in state[3:]:
            per[3] = max(per[3], total - per[1])
            if places[0] - per[1] > per[0]:
                per[1:3], per[4] = [places[0], per[2] + 1], seen

    found = walk(
        turns, key=thread, order=turn, values={"size": _size(size)}, start=start, step=step, schema="budget bigint, steps bigint, peak bigint, last bigint",
        finish=lambda state: [(b, n, peak, last) for b, _, n, peak, last in state[3:]],
    )
    return found.select("budget", thread, "steps", "peak", "last")


def _size(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))
