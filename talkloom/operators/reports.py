"""The usage report: calendar rows with a total, what folding kept out, longest threads, lines of a session list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.functions import text as T
from talkloom.operators import usage
from talkloom.operators.context import RATIO

NONE, EVEN = "–", "±0"
LONGEST = 5
DAYS = {"day": 1, "week": 7}
COUNTS = ["requests", "input", "output", "cache_write", "cache_read", "unpriced", "handled", "priced", "unsized", "unmatched", "folds", "not_sent", "avoided"]
AMOUNTS = ["cost", "actual", "saved"]


def usage_report(entries: DataFrame, log: DataFrame, prices: DataFrame, *, now: int, unit: str = "day", count: int = 7, within_ms: int = 600_000) -> DataFrame:
    """One row for each of the last `count` days or weeks up to now (epoch milliseconds), empty ones too, and one for all of them (label Total).

    entries: usage rows (usage_id, at, model and tokens); log: the request log, whose sizes before the first
    bucket still decide when a thread would have been compacted.  Weeks begin on Monday, days are the session's;
    what is later than now counts in the last bucket.  Sums meet per bucket first; the total adds up `count` rows.
    """
    days = DAYS[unit]
    bucket = lambda c: F.date_trunc(unit, F.timestamp_millis(c)).cast("date")
    last = bucket(F.lit(now))
    first = F.date_sub(last, days * (count - 1))
    placed = lambda rows: rows.where(bucket(F.col("at")) >= first).withColumn("bucket", F.least(bucket(F.col("at")), last))
    spine = log.sparkSession.range(count).select(F.date_add(first, (F.col("id") * days).cast("int")).alias("bucket"))

    recent, logged = placed(entries), placed(log)
    spent = usage.summarize(usage.priced(recent, prices, name="model").withColumn("dollars", usage.cost()), "bucket")
    worth = placed(usage.savings_rows(logged, recent, prices, within_ms))
    kept = worth.groupBy("bucket").agg(*usage.saving_sums(), F.sum("saved_tokens").alias("not_sent"))
    folds = logged.where("input > 0").groupBy("bucket").agg(F.count_if(F.coalesce("compacted", F.lit(False))).alias("folds"))
    hits = usage.native_compactions(log).where("hit").select("seq")
    avoided = logged.select("seq", "bucket").join(hits, "seq", "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("avoided"))
    for part in (spent, kept, folds, avoided):
        spine = spine.join(part, "bucket", "left")
    rows = spine.select(F.col("bucket").cast("string").alias("label"), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS], *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in AMOUNTS])
    total = rows.agg(*[F.sum(c).alias(c) for c in [*COUNTS, *AMOUNTS]]).select(F.lit("Total").alias("label"), *COUNTS, *AMOUNTS)
    return rows.union(total).withColumns({"cost_cell": cost_cell(), "avoided_cell": avoided_cell(), "not_sent_cell": not_sent_cell(), "saved_cell": saved_cell()})


def cost_cell() -> Column:
    """Dollars, with a star where some requests have no price; empty without requests."""
    return F.when(F.col("requests") == 0, "").otherwise(F.concat(T.dollar_figure(F.col("cost")), F.when(F.col("unpriced") > 0, "*").otherwise("")))


def avoided_cell() -> Column:
    return F.when(F.col("handled") == 0, NONE).otherwise(F.format_number("avoided", 0))


def not_sent_cell() -> Column:
    """Tokens kept out and the folds that did it."""
    figure = F.concat(T.token_figure(F.col("not_sent")), F.lit(" "), T.counted(F.col("folds"), "fold"))
    return F.when(F.col("handled") == 0, NONE).when(F.col("not_sent") <= 0, EVEN).otherwise(figure)


def saved_cell() -> Column:
    """Dollars saved, less than half a cent aside, and their share of what would have been paid."""
    saved = F.col("saved")
    share = F.coalesce(T.percent_figure(F.try_divide(saved, F.col("actual") + saved)), F.lit(NONE))
    money = F.concat(F.when(saved < 0, "−").otherwise(""), T.dollar_figure(F.abs(saved)))
    return F.when(F.col("priced") == 0, NONE).when(F.abs(saved) < 0.005, EVEN).otherwise(F.concat(money, F.lit(" "), share))


def left_out() -> Column:
    """Why requests have no place in the savings, as a sentence part; empty where all have."""
    rest = F.col("handled") - F.col("priced") - F.col("unsized") - F.col("unmatched")
    reasons = [
        F.when(F.col("unsized") > 0, F.concat(F.format_number("unsized", 0), F.lit(" predate size logging"))),
        F.when(F.col("unmatched") > 0, F.concat(F.format_number("unmatched", 0), F.lit(" aren't in session files"))),
        F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" to models without a price"))),
    ]
    listed = F.array_compact(F.array(*reasons))
    several = F.concat(F.array_join(F.slice(listed, 1, F.greatest(F.size(listed) - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(listed, -1))
    return F.when(F.size(listed) > 1, several).otherwise(F.array_join(listed, ""))


def longest(peaks: DataFrame, *, since: Column | None = None, most: int = LONGEST) -> DataFrame:
    """The threads with the longest history of their own, seen since, with their cells; a top-k, ties by thread."""
    rows = peaks if since is None else peaks.where(F.col("last_seen") >= since)
    top = rows.orderBy(F.desc("plain"), "thread").limit(most)
    turns = F.when(F.col("turns") > 0, F.concat(F.lit(" · "), T.counted(F.col("turns"), "turn"))).otherwise("")
    return top.select(
        "thread", F.regexp_replace("thread", "-[0-9a-f]{24}$", "").alias("session"), "plain", F.concat(T.token_figure(F.col("plain")), F.lit(" of history")).alias("history"),
        F.when(F.col("compactions") > 0, F.concat(T.counted(F.col("compactions"), "compaction"), F.lit(" avoided"))).otherwise("no compaction needed").alias("avoided"),
        F.concat(F.lit("sent "), T.token_figure(F.col("sent")), turns).alias("sent"),
    )


def top_saved(sessions: DataFrame, *, session: str, plain: str, sent: str, most: int = 10) -> DataFrame:
    """The sessions for which most tokens were kept out; a top-k, ties by session."""
    return sessions.withColumn("kept_out", F.col(plain) - F.col(sent)).orderBy(F.desc("kept_out"), session).limit(most)


def session_lines(catalogue: DataFrame, views: DataFrame, *, now: Column) -> DataFrame:
    """(id, title, meta) of listed sessions: label or first characters of the id; turns, tokens of the folded view, age.

    catalogue: id, label, asks, mtime (epoch milliseconds); views: id, chars of the folded view.  Sessions without a view have 0.
    """
    rows = catalogue.join(views.select("id", "chars"), "id", "left")
    size = T.js_round(F.coalesce("chars", F.lit(0)) * F.lit(RATIO))
    title = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.substring("id", 1, 8))
    # the list says turns for any number
    meta = F.concat(F.coalesce(F.size("asks"), F.lit(0)).cast("string"), F.lit(" turns · ~"), T.token_figure(size), F.lit(" tokens · "), T.ago_figure((now - F.col("mtime")) / 1000))
    return rows.select("id", title.alias("title"), meta.alias("meta"))
