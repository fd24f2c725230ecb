"""Sizes and estimates of requests, labels of calls, and the assembly of a folded request."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T

RATIO = 1 / 3.6
MEDIA_CHARS, MEDIA_LEAST = 5_800, 2_000
OUTPUT_CAP = 40_000

#: Patterns of a table of model families, which is broadcast.
MOST_FAMILIES = 10_000


def size_of(raw_json: Column) -> Column:
    """Characters of a request's JSON; embedded data of more than 2,000 characters counts as 5,800."""
    media = rf'"data":"[A-Za-z0-9+/=]{{{MEDIA_LEAST + 1},}}+"'
    return F.length(F.regexp_replace(raw_json, media, '"data":""')) + F.regexp_count(raw_json, F.lit(media)) * MEDIA_CHARS


def estimate(chars: Column, ratio: Column | None = None) -> Column:
    return T.js_round(chars * (F.lit(RATIO) if ratio is None else F.coalesce(ratio, F.lit(RATIO))))


def target_size(fixed: Column, window: Column) -> Column:
    return fixed + F.lit(0.3) * F.greatest(F.lit(0), window - fixed)


def input_tokens(usage: Column) -> Column:
    n = lambda k: F.coalesce(usage[k], F.lit(0))
    return n("input_tokens") + n("cache_read_input_tokens") + n("cache_creation_input_tokens")


def overflow(error: Column) -> Column:
    """(tokens, maximum) of a "prompt is too long" error; null for other texts."""
    part = lambda i: F.try_to_number(F.regexp_extract(error, r"(?i)prompt is too long[^0-9]*(\d+)\s*tokens?\s*>\s*(\d+)", i), F.lit("999999999999")).cast("long")
    return F.when(part(1) > 0, F.struct(part(1).alias("tokens"), F.when(part(2) > 0, part(2)).alias("maximum")))


def learned(feedback: DataFrame) -> DataFrame:
    """(thread, model, ratio, limit) after a thread's usage and overflow rows in order.

    feedback: thread, model, seq, chars, tokens, error.  The ratio is the thread's, a limit holds for the model
    that gave it; a model without an overflow has none.  Usage sets the ratio; an overflow raises it to at least
    tokens / chars and by a tenth, and lowers the limit.
    """
    rows = feedback.withColumn("o", overflow(F.col("error")))
    entry = F.struct("seq", F.col("chars").cast("double").alias("chars"), F.coalesce(F.col("o.tokens"), "tokens").cast("double").alias("tokens"), F.col("o").isNotNull().alias("over"))

    def step(acc: Column, x: Column) -> Column:
        now = x["tokens"] / x["chars"]
        return F.when((x["tokens"] > 0) & (x["chars"] > 0), F.when(x["over"], F.greatest(F.coalesce(acc, F.lit(0.0)), now) * F.lit(1.1)).otherwise(now)).otherwise(acc)

    ratio = F.aggregate(F.array_sort(F.collect_list(entry)), F.lit(None).cast("double"), step)
    ratios = rows.groupBy("thread").agg(ratio.alias("ratio"))
    return rows.groupBy("thread", "model").agg(F.min("o.maximum").alias("limit")).join(ratios, "thread").select("thread", "model", "ratio", "limit")


def effective_window(window: Column, limit: Column) -> Column:
    return F.least(window, limit)


def model_window(models: DataFrame, families: DataFrame, *, name: str) -> DataFrame:
    """Window of each model by the first matching family pattern (pos, pattern, window), a table the caller gives."""
    if families.count() > MOST_FAMILIES:
        raise ValueError(f"more than {MOST_FAMILIES} family patterns")
    distinct = models.select(name).distinct()
    met = distinct.join(F.broadcast(families), F.expr(f"{name} rlike pattern"))
    best = met.withColumn("__rank", F.row_number().over(W.partitionBy(name).orderBy("pos"))).where("__rank = 1").select(name, "window")
    return models.join(best, name, "left")


def _text(path: str, of: Column) -> Column:
    return F.get_json_object(of, f"$.{path}")


def call_label(name: Column, input_: Column) -> Column:
    """Short label of a call from its JSON input: command, file, pattern, else the input."""
    quoted = F.concat(name, F.lit(" `"), T.clip(_text("command", input_), 100), F.lit("`"))
    return (
        F.when(_text("command", input_).isNotNull(), quoted).when(_text("file_path", input_).isNotNull(), F.concat_ws(" ", name, _text("file_path", input_)))
        .when(_text("pattern", input_).isNotNull(), F.concat(name, F.lit(' "'), T.clip(_text("pattern", input_), 60), F.lit('"'))).otherwise(F.concat_ws(" ", name, T.clip(input_, 60)))
    )


def call_description(input_: Column) -> Column:
    """Longer description of a call for transcripts."""
    where = F.when(_text("path", input_).isNotNull(), F.concat(F.lit(" in "), _text("path", input_))).otherwise("")
    return (
        F.when(_text("command", input_).isNotNull(), F.concat(F.lit("`"), F.substring(F.regexp_replace(_text("command", input_), r"\s+", " "), 1, 300), F.lit("`")))
        .when(_text("file_path", input_).isNotNull(), _text("file_path", input_))
        .when(_text("pattern", input_).isNotNull(), F.concat(F.lit('"'), F.substring(_text("pattern", input_), 1, 120), F.lit('"'), where))
        .when(_text("url", input_).isNotNull(), _text("url", input_)).when(_text("description", input_).isNotNull(), F.substring(_text("description", input_), 1, 160)).otherwise(F.substring(input_, 1, 200))
    )


def call_body(name: Column, input_: Column) -> Column:
    """An edit as replaced and new text, a written file as its content, else nothing."""
    fence = lambda x: F.concat(F.lit("```\n"), x, F.lit("\n```"))
    edit = F.concat(F.lit("Replaced:\n"), fence(F.coalesce(_text("old_string", input_), F.lit(""))), F.lit("\nWith:\n"), fence(_text("new_string", input_)))
    return F.when(_text("new_string", input_).isNotNull(), edit).when((name == "Write") & _text("content", input_).isNotNull(), fence(F.substring(_text("content", input_), 1, OUTPUT_CAP))).otherwise("")


def capped_output(text: Column) -> Column:
    more = F.concat(F.substring(text, 1, OUTPUT_CAP), F.lit("\n… ["), (F.length(text) - OUTPUT_CAP).cast("string"), F.lit(" more characters]"))
    return F.when(F.length(text) > OUTPUT_CAP, more).otherwise(text)


def _short(value, most: int = 2_000, keep: int = 500):
    if isinstance(value, str):
        return value if len(value) <= most else f"{value[:keep]}… [{len(value) - keep} more characters cleared]"
    if isinstance(value, list):
        return [_short(v, most, keep) for v in value]
    return {k: _short(v, most, keep) for k, v in value.items()} if isinstance(value, dict) else value


def shortened_input(input_: Column) -> Column:
    """JSON with long strings cut at any depth; recursion is what columns cannot express, so Arrow batches do it."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else json.dumps(_short(json.loads(v)), ensure_ascii=False))

    return F.pandas_udf(run, "string")(input_)


def compacted(messages: DataFrame, reduced: DataFrame, cuts: DataFrame, pins: DataFrame, *, thread: str, seq: str, turn: str) -> DataFrame:
    """The rows of a folded request with the kind of each: head, notice, pinned, reduced, whole; place gives the order.

    messages: thread, turn, seq, text; reduced: thread, turn, seq, text of reduced turns; cuts: thread, cut;
    pins: thread, turn.  Turns below the cut give way to their reduced rows unless pinned; the first message
    stays; a thread without a cut stays whole.
    """
    placed = messages.join(cuts, thread, "left").join(pins.withColumn("__pin", F.lit(True)), [thread, turn], "left")
    folded = (F.col(turn) > 0) & (F.col(turn) < F.coalesce("cut", F.lit(0)))
    first = F.row_number().over(W.partitionBy(thread).orderBy(seq)) == 1
    kind = F.when(first, "head").when(~folded, "whole").when(F.col("__pin"), "pinned")
    kept = placed.withColumn("kind", kind).where("kind is not null").select(thread, turn, seq, "text", "kind")
    gone = placed.where(folded & F.col("__pin").isNull()).groupBy(thread, turn).agg(F.count(F.lit(1)).alias("__n"))
    short = reduced.join(gone, [thread, turn], "left_semi").select(thread, turn, seq, "text", F.lit("reduced").alias("kind"))
    counts = gone.groupBy(thread).agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " earlier turn is").otherwise(" earlier turns are"), F.lit(" shown in short form."))
    notice = counts.select(thread, F.lit(0).cast("int").alias(turn), F.lit(0).cast("long").alias(seq), text.alias("text"), F.lit("notice").alias("kind"))
    rows = kept.unionByName(short).unionByName(notice)
    order = F.when(F.col("kind") == "head", 0).when(F.col("kind") == "notice", 1).otherwise(2)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(thread).orderBy(order, turn, seq))).drop(seq)


def recall_budget(own: int, total: int, window: Column, in_use: Column) -> Column:
    """Characters a recall may take: its own limit, the total's rest, and a quarter of the context but 6,000 at least."""
    share = F.greatest(F.lit(6_000), F.floor(window * F.lit(0.25 / RATIO)).cast("long"))
    return F.greatest(F.lit(0), F.least(F.lit(own), F.least(F.lit(total), share) - in_use))


def context_prints(bodies: DataFrame, *, key: str, system: str, tools: str) -> DataFrame:
    """12 hex digits of the system prompt and the tool list of each request."""
    return bodies.select(key, T.short_hash(F.col(system), 12).alias("system_print"), T.short_hash(F.col(tools), 12).alias("tools_print"))


def canonical(requests: DataFrame, *, group: str, seq: str, fields: list[str]) -> DataFrame:
    """Requests with the named fields of their group's first request."""
    first = W.partitionBy(group).orderBy(seq)
    return requests.withColumns({f: F.first(f).over(first) for f in fields})
