"""Where a session could be cut and continued: compaction points, cuts by context size, choices under quotas, what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.operators import transcripts

# fixed values
NOT_ASKED = ["[Request interrupted", "<local-command", "<command-"]
EDITING = ["Edit", "Write", "MultiEdit"]
READING = ["Read", "Grep", "Glob"]
READING_COMMAND = r"^(cat|grep|rg|head|tail|sed -n|ls|find|jq|qmd)\b"
DAY_MS = 86_400_000


def real_prompt(entry_type: Column, is_meta: Column, is_summary: Column, is_sidechain: Column, blocks: Column) -> Column:
    """A prompt with words of its own: no interruption, no slash command."""
    said = transcripts.prompt_text(blocks)
    told = F.lit(False)
    for start in NOT_ASKED:
        told = told | said.startswith(start)
    return F.coalesce(transcripts.opens_turn(entry_type, is_meta, is_summary, blocks) & ~is_sidechain & (said != "") & ~told, F.lit(False))


def compaction_points(entries: DataFrame, files: DataFrame, *, session: str, seq: str, now_ms: Column, least_bytes: int = 1_000_000, days: int = 60, before: int = 8) -> DataFrame:
    """(session, boundary, before, modified): sessions whose first compaction was automatic, with enough prompts before it and one after.

    entries: prompt, boundary (booleans), trigger; files: size, modified (ms). Files are filtered first, so only their entries are shuffled.
    """
    fresh = files.where((F.col("size") >= least_bytes) & (now_ms - F.col("modified") <= days * DAY_MS)).select(session, "modified")
    rows = entries.join(fresh, session).withColumn("__first", F.min(F.when(F.col("boundary"), F.col(seq))).over(W.partitionBy(session)))
    told = F.max(F.when(F.col(seq) == F.col("__first"), F.col("trigger")))
    earlier, later = (F.count_if(F.col("prompt") & side) for side in (F.col(seq) < F.col("__first"), F.col(seq) >= F.col("__first")))
    found = rows.groupBy(session).agg(F.first("__first").alias("boundary"), earlier.alias("before"), F.first("modified").alias("modified"), told.alias("__told"), later.alias("__later"))
    return found.where((F.col("__told") == "auto") & (F.col("before") >= before) & (F.col("__later") > 0)).drop("__told", "__later")


def context_cuts(entries: DataFrame, *, session: str, seq: str, turns: int = 20, least: int = 350_000) -> DataFrame:
    """(session, cut, turns, after, last): the first prompt behind so many turns with a context of that size; null if there is none.

    entries: prompt, boundary (booleans), context (tokens of an assistant entry, else null or 0). Entries from the first boundary on do
    not count. All windows share one partitioning and order, so a session is shuffled and sorted once.
    """
    order = W.partitionBy(session).orderBy(seq)
    ended = F.max(F.col("boundary").cast("int")).over(order)
    rows = entries.withColumn("__ended", ended).where(F.coalesce(F.col("__ended"), F.lit(0)) == 0)
    context = F.last(F.when(F.col("context") > 0, F.col("context")), ignorenulls=True).over(order)
    rows = rows.withColumns({"__context": F.coalesce(context, F.lit(0)), "__n": F.sum(F.col("prompt").cast("int")).over(order)})
    fits = F.col("prompt") & (F.col("__n") > turns) & (F.col("__context") >= least)
    found = rows.groupBy(session).agg(
        F.min(F.when(fits, F.col(seq))).alias("cut"), F.min(F.when(fits, F.col("__n"))).alias("__at"), F.max("__n").alias("__all"), F.max_by("__context", seq).alias("last")
    )
    n = F.coalesce("__at", "__all")
    return found.select(session, "cut", n.alias("turns"), F.when(F.col("cut").isNull(), 0).otherwise(F.col("__all") - n).alias("after"), "last")


def chosen_points(points: DataFrame, *, total: int, least: int = 20, per_project: int = 3) -> DataFrame:
    """Points of both kinds under quotas, at most so many of a project, real ones first; half go to synthetic ones where there are enough.

    points: kind, session, cwd, before, cut, first_length, place (order within its kind). Of a session and of a signature (project, turns,
    cut, length of the first line) the first point counts: sessions are thinned first, then signatures.
    """
    real = F.col("kind") == "real"
    order = [F.when(real, 0).otherwise(1), F.col("place")]
    for key in (["session"], ["cwd", "before", "cut", "first_length"]):
        points = points.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1")
    points = points.where(~real | (F.col("before") >= least))
    points = points.withColumn("__n", F.row_number().over(W.partitionBy("cwd").orderBy(*order))).where(F.col("__n") <= per_project)
    return _halves(points, total, F.col("place"))


def continuations(points: DataFrame, *, total: int) -> DataFrame:
    """Points with at least two later prompts (column after), those with most first, half of each kind where there are enough."""
    return _halves(points.where("after >= 2"), total, F.desc("after"), F.col("place"))


def _halves(points: DataFrame, total: int, *order: Column) -> DataFrame:
    """The first (total + 1) // 2 synthetic points, then real ones up to total; each side is a top-k."""
    synthetic = points.where("kind <> 'real'").orderBy(*order).limit((total + 1) // 2)
    real = points.where("kind = 'real'").orderBy(*order).limit(total)
    n = synthetic.agg(F.count(F.lit(1)).alias("__taken"))
    kept = real.withColumn("__n", F.row_number().over(W.partitionBy("kind").orderBy(*order))).join(F.broadcast(n), F.col("__n") <= total - F.col("__taken"))
    return kept.drop("__n", "__taken").unionByName(synthetic.drop("__n"))


def next_turn(rows: DataFrame, cuts: DataFrame, *, session: str, seq: str) -> DataFrame:
    """Rows of the first turn at or after a cut: the prompt (part 0) and what follows it up to the next one (part 1).

    rows: prompt (boolean) and anything else; cuts: session, cut. Rows stay rows, so a turn of any length fits.
    """
    order = W.partitionBy(session).orderBy(seq)
    after = rows.join(cuts, session).where(F.col(seq) >= F.col("cut"))
    after = after.withColumn("__n", F.sum(F.col("prompt").cast("int")).over(order)).where("__n = 1")
    return after.withColumn("part", F.when(F.col("prompt"), 0).otherwise(1)).drop("__n", "cut")


def edited(rows: DataFrame, *, session: str) -> DataFrame:
    """(session, path): files that editing calls name, each once. rows: tool, path."""
    return rows.where(F.col("tool").isin(EDITING) & F.col("path").isNotNull()).select(session, "path").distinct()


def acts(calls: DataFrame, *, session: str, seq: str, own: Column) -> DataFrame:
    """(session, calls, reads_before): all calls, and those that read the session's own transcript (own) before anything but reading happened.

    calls: tool, command.
    """
    reads = F.coalesce(F.col("tool").isin(READING) | F.coalesce(F.col("command"), F.lit("")).rlike(READING_COMMAND), F.lit(False))
    order = W.partitionBy(session).orderBy(seq)
    rows = calls.withColumns({"__own": own, "__reads": reads}).withColumn("__acted", F.max((~F.col("__reads")).cast("int")).over(order))
    return rows.groupBy(session).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("__own") & (F.col("__acted") == 0)).alias("reads_before"))


def marked_names(lines: DataFrame, *, session: str, text: str, marker: str) -> DataFrame:
    """(session, name): distinct last path segments that follow a marker (a regular expression without groups)."""
    paths = F.regexp_extract_all(F.col(text), F.lit(marker + r'([^\s"\\]+)'), 1)
    return lines.select(session, F.explode(paths).alias("name")).select(session, F.substring_index("name", "/", -1).alias("name")).distinct()
