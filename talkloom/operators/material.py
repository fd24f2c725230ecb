"""What a session's readers get to see of it: labelled lines up to a cut, the last of them within a budget; whole transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T

# Labels of the lines, what stands for a cut beginning, and the most characters of each kind of line.
IN_PROGRESS, BEFORE = "IN PROGRESS when the context filled", " before the cut"
TRUNCATED = "[earliest turns truncated]\n"
NEXT_HEAD = "=== WHAT THE USER ASKED NEXT, AFTER THE CUT (only for the continuation reference answers) ==="
MOST_PROMPT, MOST_SAID, MOST_CALL, MOST_OUTPUT, MOST_NEXT = 2_500, 2_000, 400, 1_500, 1_200
BUDGET, NEXT_PROMPTS, MOST_RESULT = 420_000, 2, 20_000


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def last_characters(rows: DataFrame, *, group: str, order: list[str], text: str, budget: int, joiner: str = "\n") -> DataFrame:
    """The rows whose texts, joined in order, make up the last `budget` characters of each group, the first of them cut where the budget begins.

    Adds __whole, false where something of the group was left out.  Sums run from the end of a group over sorted
    rows, so nothing is gathered and a group of any size needs no more memory; it is one task.  Null texts
    are empty.  The budget counts joiners of one character exactly.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    falling = W.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    wide = len(joiner)
    # characters behind this row, with the joiners in between
    behind = F.coalesce(F.sum(F.length(body) + wide).over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.length(body) + wide).over(W.partitionBy(group)) - wide
    room = F.lit(budget) - F.col("__behind")
    seen = rows.withColumns({"__behind": behind, "__total": total}).where(room >= 0)
    kept = F.when(F.length(body) <= room, body).otherwise(F.substring(body, F.length(body) - room.cast("int") + 1, room.cast("int")))
    return seen.withColumn(text, kept).withColumn("__whole", F.col("__total") <= budget).drop("__behind", "__total")


def source_lines(parts: DataFrame, *, thread: str, seq: str) -> DataFrame:
    """(thread, seq, line) of parts (kind: prompt, said, call or output; name, text) of the entries before a cut.

    A prompt opens a numbered turn and says how many prompts follow; what stands before the first prompt and
    blank texts are left out.  Orders of equal entries follow the column n of parts.
    """
    order = W.partitionBy(thread).orderBy(seq, "n")
    turn = F.sum(F.when(F.col("kind") == "prompt", 1).otherwise(0)).over(order)
    turns = F.count(F.when(F.col("kind") == "prompt", 1)).over(W.partitionBy(thread))
    ago = F.col("__turns") - F.col("__turn")
    when = F.when(ago == 0, IN_PROGRESS).otherwise(F.concat(ago.cast("string"), F.lit(BEFORE)))
    head = F.concat(F.lit("\n### Turn "), F.col("__turn").cast("string"), F.lit(" ("), when, F.lit(")\nUSER: "), F.substring("text", 1, MOST_PROMPT))
    line = (
        F.when(F.col("kind") == "prompt", head)
        .when(F.col("kind") == "said", F.concat(F.lit("AGENT: "), F.substring("text", 1, MOST_SAID)))
        .when(F.col("kind") == "call", F.concat(F.lit("TOOL CALL "), "name", F.lit(": "), F.substring(_one_line(F.col("text")), 1, MOST_CALL)))
        .otherwise(F.concat(F.lit("TOOL OUTPUT: "), F.substring(_one_line(F.col("text")), 1, MOST_OUTPUT)))
    )
    rows = parts.withColumns({"text": F.coalesce("text", F.lit("")), "__turn": turn, "__turns": turns}).where("__turn > 0")
    return rows.where(F.col("kind").isin("prompt", "call") | (T.trimmed(F.col("text")) != "")).select(thread, seq, "n", line.alias("line"))


def source_material(parts: DataFrame, following: DataFrame, *, thread: str, seq: str, budget: int = BUDGET) -> DataFrame:
    """(thread, text): the last `budget` characters of the lines before the cut, then the first prompts behind it.

    parts: as in source_lines(); following: (thread, seq, text), the prompts behind the cut.  Threads without a
    prompt before the cut have no row.  A text is gathered within its budget only.
    """
    lines = last_characters(source_lines(parts, thread=thread, seq=seq), group=thread, order=[seq, "n"], text="line", budget=budget)
    gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "n", "line"))), lambda x: x["line"]), "\n")
    before = lines.groupBy(thread).agg(gathered.alias("__before"), F.min("__whole").alias("__whole"))
    asked = following.withColumn("__k", F.row_number().over(W.partitionBy(thread).orderBy(seq))).where(F.col("__k") <= NEXT_PROMPTS)
    cut = F.struct("__k", F.substring(F.coalesce("text", F.lit("")), 1, MOST_NEXT).alias("t"))
    nexts = asked.groupBy(F.col(thread).alias("__of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cut)), lambda x: x["t"]), "\n---\n").alias("__next"))
    both = before.join(nexts, F.col(thread).eqNullSafe(F.col("__of")), "left")
    text = F.concat(F.when(F.col("__whole"), "").otherwise(TRUNCATED), "__before", F.lit(f"\n\n{NEXT_HEAD}\n"), F.coalesce("__next", F.lit("")))
    return both.select(thread, text.alias("text"))


def transcript_parts(parts: DataFrame, *, thread: str, seq: str) -> DataFrame:
    """(thread, seq, n, part): a whole transcript as parts that stand a blank line apart, in order; nothing is gathered.

    parts: as in source_lines(), a call's text being its label.  Turns are numbered by their prompts.
    """
    turn = F.sum(F.when(F.col("kind") == "prompt", 1).otherwise(0)).over(W.partitionBy(thread).orderBy(seq, "n"))
    text = F.coalesce("text", F.lit(""))
    part = (
        F.when(F.col("kind") == "prompt", F.concat(F.lit("### Turn "), F.col("__turn").cast("string"), F.lit("\n\n**You:** "), text))
        .when(F.col("kind") == "said", F.concat(F.lit("**Agent:** "), T.trimmed(text)))
        .when(F.col("kind") == "call", F.concat(F.lit("[tool] "), text))
        .otherwise(F.concat(F.lit("```\n"), F.substring(text, 1, MOST_RESULT), F.lit("\n```")))
    )
    rows = parts.withColumn("__turn", turn).where((F.col("__turn") > 0) & ((F.col("kind") != "said") | (T.trimmed(text) != "")))
    return rows.select(thread, seq, "n", part.alias("part"))
