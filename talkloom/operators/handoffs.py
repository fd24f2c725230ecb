"""Earlier sessions handed to a new one: marks in prompts resolved once, folded views, several sources under one cap, calls for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.operators import fold, sessions
from talkloom.operators.usage import best_per_key

#: Characters of a prefix that a mark has at least, and of a folded view that is handed over.
LEAST_PREFIX, VIEW_CHARS = 8, 400_000


def by_prefixes(wanted: DataFrame, found: DataFrame, *, key: list[str], prefix: str, own: Column) -> DataFrame:
    """(key, id, label): the one session whose id begins with the prefix, the asker's own (`own`) aside; null without any or with several.

    Ids give all their prefixes, only asked ones stay, and each asked prefix counts its ids before it meets
    the askers: the join is by equality, so a prefix that all ids share makes no more pairs than askers.
    """
    ids = found.where(F.length("id") >= LEAST_PREFIX).groupBy("id").agg(F.min("label").alias("label"))
    cuts = ids.select("id", "label", F.explode(F.sequence(F.lit(LEAST_PREFIX), F.length("id"))).alias("__n")).withColumn("__prefix", F.substring("id", F.lit(1), F.col("__n")))
    asked = wanted.select(F.col(prefix).alias("__prefix")).distinct()
    entry = F.struct("id", "label")
    ends = cuts.join(asked, "__prefix", "left_semi").groupBy("__prefix").agg(F.count(F.lit(1)).alias("__ids"), F.min(entry).alias("__a"), F.max(entry).alias("__z"))
    met = wanted.withColumns({"__prefix": F.col(prefix), "__own": own}).join(ends, "__prefix", "left")
    first = F.col("__a.id").eqNullSafe(F.col("__own"))
    last = F.col("__z.id").eqNullSafe(F.col("__own"))
    inside = F.coalesce(F.startswith("__own", "__prefix"), F.lit(False)) & (first | last)
    one = F.when((F.col("__ids") == 1) & ~first, F.col("__a")).when((F.col("__ids") == 2) & inside, F.when(first, F.col("__z")).otherwise(F.col("__a")))
    return met.select(*key, one["id"].alias("id"), one["label"].alias("label"))


def new_handoffs(prompts: DataFrame, known: DataFrame, found: DataFrame, *, thread: str, seq: str, key: str, text: str, session: Column | None = None) -> DataFrame:
    """(thread, key, wanted, source, label): prompts that ask to continue a session and are not known yet, with what they resolve to.

    known: thread, key, source (null: resolved to nothing).  found: id, label.  A source that a thread has, or
    that an earlier prompt of these takes, is not handed over again; such prompts resolve to nothing, which is
    kept as well, so that no prompt is looked up twice.  session: the asker's own id, the thread if not given.
    Prompts without a mark or key are left out; of a key that a thread repeats the first prompt counts.
    """
    asked = prompts.select(thread, seq, key, sessions.continue_id(F.col(text)).alias("wanted"), (F.col(thread) if session is None else session).cast("string").alias("__me"))
    asked = best_per_key(asked.where(F.col("wanted").isNotNull() & F.col(key).isNotNull()), [thread, key], [F.asc(seq)])
    open_ = asked.join(known.select(thread, key), [thread, key], "left_anti")
    got = by_prefixes(open_, found, key=[thread, seq, key, "wanted"], prefix="wanted", own=F.col("__me"))
    held = known.where("source is not null").select(thread, F.col("source").alias("id")).distinct().withColumn("__held", F.lit(True))
    again = F.row_number().over(W.partitionBy(thread, "id").orderBy(seq, key)) > 1
    rows = got.join(held, [thread, "id"], "left").withColumn("__again", again | F.col("__held").isNotNull())
    fresh = F.col("id").isNotNull() & ~F.col("__again")
    return rows.select(thread, key, "wanted", F.when(fresh, F.col("id")).alias("source"), F.when(fresh, F.coalesce("label", "wanted")).alias("label"))


def view_texts(view: DataFrame, *, key: list[str], turn: str = "turn", text: str = "text") -> DataFrame:
    """(key, text, chars, lines): the turns of a folded view as one text; a row is one session's view."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), F.col(text).alias("t")))), lambda x: x["t"]), "\n\n")
    made = view.groupBy(*key).agg(body.alias("text"))
    return made.select(*key, "text", F.length("text").cast("bigint").alias("chars"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("lines"))


def session_views(turns: DataFrame, *, session: str, cap: int = VIEW_CHARS) -> DataFrame:
    """(session, text, chars, lines): folded turns (as fold.folded_turns() gives them) of each session under a cap."""
    view = fold.folded_view(turns, thread=session, turn="turn", full=fold.rendered(True), short=fold.rendered(False), cap=cap)
    return view_texts(view, key=[session])


def with_views(new: DataFrame, views: DataFrame) -> DataFrame:
    """New hand-offs with the view (views: source, text) of their source; null text where they resolve to nothing, empty where it has no turns."""
    rows = new.join(views.select("source", "text"), "source", "left")
    return rows.withColumn("text", F.when(F.col("source").isNotNull(), F.coalesce("text", F.lit(""))))


def loaded_files(views: DataFrame, *, session: str) -> DataFrame:
    """(file, content) of sessions written out to be read, for files.write_changed()."""
    return views.select(F.concat(F.col(session).cast("string"), F.lit(".md")).alias("file"), F.col("text").alias("content"))


def several_views(chosen: DataFrame, turns: DataFrame, *, query: str, session: str, cap: int = 120_000) -> DataFrame:
    """(query, text, chars, lines): the folded views of the chosen sessions in order of place, each under an equal share of the cap.

    chosen: query, place, session, title; a session that several queries choose is viewed for each of them.
    A chosen session without turns keeps its heading.
    """
    shares = chosen.groupBy(query).agg(F.floor(F.lit(cap) / F.count(F.lit(1))).alias("__share"))
    asked = chosen.join(shares, query).withColumn("__view", F.struct(F.col(query), F.col("place")))
    rows = asked.select("__view", session, "__share").join(turns, session)
    view = fold.folded_view(rows, thread="__view", turn="turn", full=fold.rendered(True), short=fold.rendered(False), cap=F.col("__share"))
    texts = view_texts(view, key=["__view"]).select("__view", "text")
    heading = F.concat(F.lit("## Session: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    parts = asked.join(texts, "__view", "left").select(query, F.col("place").alias("turn"), heading.alias("text"))
    return view_texts(parts, key=[query])


def agent_calls(calls: DataFrame, *, program: str, tool: str = "Bash", source: str = "[A-Za-z0-9-]+") -> DataFrame:
    """Shell calls that run a program, with kind (its load or peek command, else other) and the source that one names.

    calls: tool, command and any other columns; program and source are regular expressions.
    """
    command = F.coalesce("command", F.lit(""))
    runs = (F.col("tool") == tool) & command.rlike(rf"(^|[;&|\s])(?:{program})\s")
    verb, named = (F.regexp_extract(command, rf"(?:{program})\s+(load|peek)\b" + rest, i) for rest, i in (("", 1), (rf'\s+"?({source})', 2)))
    return calls.where(runs).withColumns({"kind": F.when(verb != "", verb).otherwise("other"), "source": F.when(named != "", named)})


def folded_by_hand(state: DataFrame, turns: DataFrame, asks: DataFrame) -> DataFrame:
    """The state of threads after a fold at a turn the user names, with pins; error says why a thread keeps its state.

    state: thread, cut, keep, cleared, stuck, host, pins (keys), recalls (prompt print to text); turns: thread, turn
    from 0, key, prints (of the prompts in it); asks: thread, at (null: the last turn), pin, unpin (turn numbers).
    With at below 0 the cut stays and only pins change.  A cut at a turn drops what an earlier one had cleared
    or held, keeps the turns in front of it but the first as they are and forgets the recalls of prompts in front.
    Threads that are not asked for stay; asked ones without state begin with none, without turns are an error.
    """
    met = turns.join(asks.select("thread", "at", "pin", "unpin"), "thread")
    named = lambda c: F.coalesce(F.array_contains(c, F.col("turn")), F.lit(False))
    per = met.withColumn("__at", F.coalesce("at", F.max("turn").over(W.partitionBy("thread")))).groupBy("thread").agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.when(F.col("turn") == F.col("__at"), F.col("key"))).alias("__key"),
        F.collect_set(F.when(named("pin"), F.col("key"))).alias("__pin"), F.collect_set(F.when(named("unpin"), F.col("key"))).alias("__unpin"),
        F.flatten(F.collect_list(F.when(F.col("turn") < F.col("__at"), F.col("prints")))).alias("__gone"),
    )
    rows = asks.select("thread", "at", "pin", "unpin", F.lit(True).alias("__asked")).join(per, "thread", "left").join(state, "thread", "full")
    n = F.coalesce("__n", F.lit(0))
    at = F.coalesce("at", n - 1)
    outside = F.exists(F.concat(*[F.coalesce(c, F.array().cast("array<int>")) for c in ("pin", "unpin")]), lambda i: (i < 0) | (i >= n))
    asked = F.col("__asked").isNotNull()
    cuts = asked & (at >= 0)
    error = F.when(asked & (n == 0), "no turn").when(cuts & (n <= 1), "one turn only").when(cuts & ((at < 1) | (at >= n)), "no such turn").when(asked & outside, "no such turn to pin")
    fine, folds = error.isNull() & asked, error.isNull() & cuts
    none = F.array().cast("array<string>")
    pins = F.array_sort(F.array_except(F.array_union(F.coalesce("pins", none), F.coalesce("__pin", none)), F.coalesce("__unpin", none)))
    recalls = F.map_filter("recalls", lambda k, _: ~F.array_contains("__gone", k))
    kinds = dict(state.dtypes)
    new = {"cut": F.col("__key"), "keep": at - 1, "cleared": F.lit(None), "stuck": F.lit(None), "host": F.lit(True), "recalls": recalls}
    out = [F.when(folds, v.cast(kinds[c])).otherwise(F.col(c)).alias(c) for c, v in new.items()]
    return rows.select("thread", *out, F.when(fine, F.when(F.size(pins) > 0, pins)).otherwise(F.col("pins")).alias("pins"), error.alias("error"))
