"""Finished turns in short form, dropped output as chunks for recall, and where the fold stands; over one row a content block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.operators.context import call_label
from talkloom.operators.turns import IMAGE_NOTE, STALE_NOTE, call_results
from talkloom.sources import logs

# What stands for a turn without a final reply, and the mark of an interrupted request.
INTERRUPTED = "[This turn was interrupted before a final reply.]"
LAST_WORDS, IN_TRANSCRIPT = "Last thing you said: ", "Their output is in the full transcript."
REQUEST_INTERRUPTED = "[Request interrupted"
ONLY_REMINDERS = r"(?s)^\s*(?:<system-reminder>.*?</system-reminder>\s*)+$"
WORDS_CAP, CALLS_SHOWN = 600, 20


def filled(text: Column) -> Column:
    return T.trimmed(F.coalesce(text, F.lit(""))) != ""


def block_rows(messages: DataFrame, *, blocks: str = "blocks") -> DataFrame:
    """One row a content block in place of `blocks`: pos, type, text (of a result: its text), call_id, label, said, has_content.

    A message without blocks stays as one row of null type.  `said`, the whole text of a message, stands
    on its first row only.
    """
    many = F.col(blocks)
    has = F.exists(many, lambda b: (b["type"] != "text") | filled(b["text"]))
    rows = messages.select("*", has.alias("has_content"), logs.joined_text(many).alias("__said"), F.posexplode_outer(blocks).alias("pos", "__b")).drop(blocks)
    b = F.col("__b")
    result = logs.joined_text(logs.blocks(b["content"]))
    return rows.select(
        *[c for c in rows.columns if c not in ("__said", "__b", "pos")], F.coalesce("pos", F.lit(0)).alias("pos"), b["type"].alias("type"),
        F.when(b["type"] == "tool_result", result).otherwise(b["text"]).alias("text"), F.coalesce(b["id"], b["tool_use_id"]).alias("call_id"),
        F.when(b["type"] == "tool_use", call_label(b["name"], F.to_json(b["input"]))).alias("label"), F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("__said")).alias("said"),
    )


def interrupted_reply(words: Column, n_calls: Column, labels: Column) -> Column:
    """The stand-in for a missing final reply; labels holds the last calls only, n_calls counts all."""
    cut = F.when(F.length(words) > WORDS_CAP, F.concat(F.substring(words, 1, WORDS_CAP), F.lit("…"))).otherwise(words)
    shown = F.when(n_calls > F.size(labels), F.concat(F.lit(", last "), F.size(labels).cast("string"), F.lit(" shown"))).otherwise("")
    calls = F.concat(F.lit("Tool calls ("), n_calls.cast("string"), shown, F.lit("): "), F.array_join(labels, "; "))
    return F.concat_ws("\n", F.lit(INTERRUPTED), F.when(filled(words), F.concat(F.lit(LAST_WORDS), cut)), F.when(n_calls > 0, calls), F.lit(IN_TRANSCRIPT))


def reduced_turns(rows: DataFrame, *, thread: str, seq: str = "seq", evidence: DataFrame | None = None) -> DataFrame:
    """(thread, turn, part, seq, pos, role, type, text): every turn as its prompt, what came in later, notes and the final reply.

    rows: thread, turn, seq, role and the columns of block_rows.  Parts: 0 opening user messages, 1 later
    user text without image notes and reminders, 2 evidence where given (thread, turn, evidence), 3 distinct
    notes of the host that are not stale, 4 the last message's text, or where that calls a tool or says
    nothing a stand-in.  All windows share the partitioning by turn: one shuffle, nothing gathered but the
    last calls' labels.  The preamble (turn 0) is left out; null text is blank.
    """
    turn, role, kind, text = W.partitionBy(thread, "turn"), F.col("role"), F.col("type"), F.col("text")
    backwards = turn.orderBy(F.desc(seq), F.desc("pos"))
    is_call = (role == "assistant") & F.coalesce(kind == "tool_use", F.lit(False))
    is_text = F.coalesce(kind == "text", F.lit(False)) & filled(text)
    marked = rows.where("turn > 0").withColumns({
        "__reply": F.min(F.when(role == "assistant", F.col(seq))).over(turn), "__last": F.max(F.when(role != "system", F.col(seq))).over(turn),
        "__calls": F.sum(is_call.cast("int")).over(turn), "__ago": F.sum(is_call.cast("int")).over(backwards), "__row": F.row_number().over(backwards),
        "__words": F.max_by(T.trimmed(F.col("said")), F.when((role == "assistant") & filled(F.col("said")), F.col(seq))).over(turn),
        "__copy": F.row_number().over(W.partitionBy(thread, "turn", "role", "type", "text").orderBy(seq, "pos")),
    })
    ends = (F.col(seq) == F.col("__last")) & (role == "assistant")
    label = F.when(is_call & (F.col("__ago") <= CALLS_SHOWN), F.struct(F.col(seq).alias("s"), "pos", "label"))
    marked = marked.withColumns({
        "__whole": F.max((ends & is_text).cast("int")).over(turn) > F.max((ends & is_call).cast("int")).over(turn),
        "__labels": F.transform(F.array_sort(F.collect_list(label).over(turn)), lambda x: x["label"]),
    })
    early = F.col("__reply").isNull() | (F.col(seq) < F.col("__reply"))
    note = (role == "system") & F.col("has_content") & (~F.coalesce(kind == "text", F.lit(False)) | (~F.coalesce(text, F.lit("")).rlike(STALE_NOTE) & (F.col("__copy") == 1)))
    part = (
        F.when((role == "user") & early, 0).when((role == "user") & is_text & ~text.rlike(IMAGE_NOTE) & ~text.rlike(ONLY_REMINDERS), 1)
        .when(note, 3).when(ends & is_text & F.col("__whole"), 4)
    )
    own = F.when(part.isNotNull(), F.struct(part.alias("part"), F.col(seq).alias("seq"), "pos", "role", "type", "text"))
    stand_in = interrupted_reply(F.col("__words"), F.col("__calls"), F.col("__labels"))
    made = F.struct(F.lit(4).alias("part"), F.col(seq).alias("seq"), "pos", F.lit("assistant").alias("role"), F.lit("text").alias("type"), stand_in.alias("text"))
    out = marked.select(thread, "turn", F.explode(F.array_compact(F.array(own, F.when((F.col("__row") == 1) & ~F.col("__whole"), made)))).alias("x")).select(thread, "turn", "x.*")
    if evidence is None:
        return out
    shown = evidence.select(thread, "turn", F.lit(2).alias("part"), F.lit(None).cast(out.schema["seq"].dataType).alias("seq"), F.lit(0).alias("pos"), F.lit("user").alias("role"), F.lit("text").alias("type"), F.col("evidence").alias("text"))
    return out.unionByName(shown.where("text is not null"))


def trimmed_threads(messages: DataFrame, *, thread: str) -> DataFrame:
    """Message rows with `reduce`: whether the row's turn gives way to its short form, which is all turns but the last."""
    last = messages.groupBy(thread).agg(F.max("turn").alias("__last"))
    return messages.join(last, thread).withColumn("reduce", (F.col("turn") > 0) & (F.col("turn") < F.col("__last"))).drop("__last")


def tail(messages: DataFrame, starts: DataFrame, *, thread: str, seq: str, notice: Callable[[Column, Column], Column]) -> DataFrame:
    """(thread, place, seq, role, text) of threads that keep the turns behind the first `start` ones (thread, start).

    The preamble and the very first prompt stay in front; a notice of the turns left out and kept follows.
    A thread without turns, without a start or with one of at most 1 stays whole; place orders the three parts.
    """
    first = messages.where("turn > 0").groupBy(thread).agg(F.min(seq).alias("__first"), F.max("turn").alias("__n"))
    rows = messages.join(first.join(starts, thread, "left"), thread, "left")
    whole = F.coalesce(F.col("start") <= 1, F.lit(True)) | F.col("__n").isNull()
    place = F.when(whole | (F.col("turn") == 0) | (F.col(seq) == F.col("__first")), 0).when(F.col("turn") > F.col("start"), 2)
    told = F.when(~whole & (F.col(seq) == F.col("__first")), F.struct(F.lit(1).alias("place"), F.col(seq).alias("seq"), F.lit("user").alias("role"), notice(F.col("start") - 1, F.col("__n") - F.col("start")).alias("text")))
    own = F.when(place.isNotNull(), F.struct(place.alias("place"), F.col(seq).alias("seq"), "role", "text"))
    return rows.select(thread, F.explode(F.array_compact(F.array(own, told))).alias("x")).select(thread, "x.*")


def _windows(rows: DataFrame, size: int) -> DataFrame:
    """Rows with chunk and lines in place of text: its windows of `size` lines."""
    keep = [c for c in rows.columns if c != "text"]
    split = rows.withColumn("text", F.split("text", "\n", -1))
    starts = F.sequence(F.lit(0), F.floor((F.size("text") - 1) / size).cast("int"))
    return split.select("*", F.explode(starts).alias("chunk")).select(*keep, "chunk", F.slice("text", F.col("chunk") * size + 1, F.lit(size)).alias("lines"))


def recall_chunks(rows: DataFrame, kept: DataFrame, *, thread: str, seq: str = "seq", size: int = 6, weight: int = 1, narrative: bool = True, closed: bool = False) -> DataFrame:
    """(thread, turn, call, seq, pos, chunk, lines, terms) of what finished turns printed and said on the way.

    rows as for reduced_turns.  A call's output is its last result in the turn; blank ones and those that
    still stand in the context (kept: thread, call_id, text) are left out.  Terms of the call's label come in
    front of each chunk's own, `weight` times.  Narration is the assistant text between a turn's first and
    last message, numbered by line, so no turn is gathered.  The last turn counts as open unless `closed`.
    """
    live = rows.where("turn > 0")
    if not closed:
        last = live.groupBy(thread).agg(F.max("turn").alias("__last"))
        live = live.join(last, thread).where("turn < __last").drop("__last")
    calls = live.where("role = 'assistant' and type = 'tool_use'").select(thread, "turn", "call_id", F.col(seq).alias("seq"), "pos", F.col("label").alias("call"))
    results = live.where("role = 'user' and type = 'tool_result'").select(thread, "turn", "call_id", "text", F.struct(seq, "pos").alias("__at"))
    pairs = call_results(calls, results, scope=[thread, "turn"], call_id="call_id", seq="seq", result_seq="__at").where(filled(F.col("text"))).drop("__at")
    known = kept.select(thread, "call_id", F.sha2("text", 256).alias("__sha")).distinct()
    pairs = pairs.withColumn("__sha", F.sha2("text", 256)).join(known, [thread, "call_id", "__sha"], "left_anti").drop("__sha", "call_id")
    head = F.flatten(F.array_repeat(T.terms(F.col("call")), max(1, weight)))
    own = T.terms(F.array_join("lines", "\n"))
    columns = [thread, "turn", "call", "seq", "pos", "chunk", "lines"]
    printed = _windows(pairs, size).select(*columns, F.concat(head, own).alias("terms"))
    if not narrative:
        return printed
    turn = W.partitionBy(thread, "turn")
    inner = live.withColumns({"__a": F.min(seq).over(turn), "__z": F.max(seq).over(turn)}).where((F.col(seq) > F.col("__a")) & (F.col(seq) < F.col("__z")))
    said = inner.where((F.col("role") == "assistant") & (F.col("type") == "text") & filled(F.col("text")))
    lines = said.select(thread, "turn", F.col(seq).alias("seq"), "pos", F.posexplode(F.split(T.trimmed(F.col("text")), "\n", -1)).alias("__l", "line"))
    numbered = lines.withColumn("__n", F.row_number().over(turn.orderBy("seq", "pos", "__l")) - 1).withColumn("chunk", F.floor(F.col("__n") / size).cast("int"))
    inside = numbered.groupBy(thread, "turn", "chunk").agg(F.array_sort(F.collect_list(F.struct("__n", "seq", "pos", "line"))).alias("x"))  # at most `size` lines
    spoken = inside.select(thread, "turn", F.lit("agent").alias("call"), F.col("x")[0]["seq"].alias("seq"), F.col("x")[0]["pos"].alias("pos"), "chunk", F.transform("x", lambda l: l["line"]).alias("lines"))
    return printed.unionByName(spoken.withColumn("terms", own))


def source_chunks(rows: DataFrame, *, thread: str, origin: Column, seq: str = "seq", users: bool = False, size: int = 6) -> DataFrame:
    """Chunks of other sessions with `origin`, all turns finished; with users, each opening prompt is one more chunk."""
    none = rows.select(thread, "call_id", "text").limit(0)
    chunks = recall_chunks(rows, none, thread=thread, seq=seq, size=size, closed=True)
    if users:
        opening = rows.where("turn > 0 and said is not null").groupBy(thread, "turn").agg(F.min(seq).alias("seq"), T.spoken(F.min_by("said", seq)).alias("text"))
        asked = opening.where("text <> ''").select(thread, "turn", F.lit("you").alias("call"), "seq", F.lit(-1).alias("pos"), F.lit(0).alias("chunk"), F.split("text", "\n", -1).alias("lines"), T.terms(F.col("text")).alias("terms"))
        chunks = chunks.unionByName(asked)
    return chunks.withColumn("origin", origin)


def run_chunks(chunks: DataFrame, runs: DataFrame, *, thread: str) -> DataFrame:
    """Chunks of side runs (thread: run_id) as chunks of the turn that launched them: runs (run_id, description, turn)."""
    label = F.concat(F.lit('subagent "'), F.col("description"), F.lit('"'))
    return chunks.drop("turn").join(runs.select(F.col("run_id").alias(thread), "description", "turn"), thread).withColumn("origin", label).drop("description")


def recall_corpus(own: DataFrame, history: DataFrame, more: list[DataFrame], *, thread: str) -> DataFrame:
    """All chunks a thread may recall: its own, its log's only where it has none of its own, and those of other sources."""
    out = own.unionByName(history.join(own.select(thread).distinct(), thread, "left_anti"), allowMissingColumns=True)
    for part in more:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def settled(turns: DataFrame, *, thread: str, opening: Column, turn: str = "turn") -> DataFrame:
    """Adds settled: the turn where a cut at this one really falls, as no cut falls on an interrupted request (but from turn 2 down)."""
    free = ~F.contains(opening, F.lit(REQUEST_INTERRUPTED)) | (F.col(turn) <= 2)
    return turns.withColumn("settled", F.max(F.when(free, F.col(turn))).over(W.partitionBy(thread).orderBy(turn)))


def resolved_cuts(keys: DataFrame, saved: DataFrame, *, thread: str, forced_keep: int | None = None) -> DataFrame:
    """(thread, cut, reset, forced): turns in front of the saved cut, -1 for none; a saved key that no turn has any more is reset.

    keys: thread, turn, key, settled; saved: thread, key.  With forced_keep a thread of three turns or more
    without a cut is cut in front of its last 1 + forced_keep turns.
    """
    found = saved.select(thread, F.col("key").alias("saved")).dropDuplicates([thread])
    per = keys.join(found, thread, "left").groupBy(thread, "saved").agg(F.max("turn").alias("n"), F.min(F.when(F.col("key") == F.col("saved"), F.col("turn"))).alias("at"))
    out = per.select(thread, F.coalesce(F.col("at") - 1, F.lit(-1)).alias("cut"), (F.col("saved").isNotNull() & F.col("at").isNull()).alias("reset"), "n")
    if forced_keep is None:
        return out.select(thread, "cut", "reset", F.lit(False).alias("forced"))
    want = out.withColumn("turn", F.greatest(F.lit(2), F.col("n") - forced_keep)).join(keys.select(thread, "turn", "settled"), [thread, "turn"], "left")
    forced = (F.col("cut") <= 0) & (F.col("n") >= 3)
    return want.select(thread, F.when(forced, F.col("settled") - 1).otherwise(F.col("cut")).alias("cut"), "reset", forced.alias("forced"))


def cut_notes(turns: DataFrame, state: DataFrame, *, thread: str) -> DataFrame:
    """(thread, action, omitted, folded, pinned): what a cut leaves out, shows in short and keeps whole.

    turns: thread, turn, pinned, messages; state: thread, cut (turns in front of it), keep.
    """
    i, cut, pinned = F.col("turn") - 1, F.col("cut"), F.col("pinned")
    start = F.when(cut > 0, F.greatest(F.lit(1), cut - F.col("keep"))).otherwise(0)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    rows = turns.where("turn > 0").join(state, thread).withColumn("__start", start)
    first = F.col("__start")
    return rows.groupBy(thread).agg(
        F.when(F.max(cut) > 0, "compact").otherwise("full").alias("action"), count((cut > 0) & ~pinned & (i >= 1) & (i < first)).alias("omitted"),
        count((cut > 0) & ~pinned & (((i >= first) & (i < cut)) | ((i == 0) & (first == 1) & (F.col("messages") > 1)))).alias("folded"), count((i < cut) & pinned).alias("pinned"),
    )


def open_results(rows: DataFrame, starts: DataFrame, *, thread: str, seq: str = "seq") -> DataFrame:
    """(thread, n): tool results in user messages from each thread's start (thread, start) on."""
    hit = (F.col("role") == "user") & (F.col("type") == "tool_result") & (F.col(seq) >= F.col("start"))
    return rows.join(starts, thread).groupBy(thread).agg(F.count(F.when(hit, 1)).alias("n"))


def request_sizes(messages: DataFrame, bounds: DataFrame, *, thread: str, seq: str, size: Column) -> DataFrame:
    """(thread, head, folded, live): sizes in front of the head's end, up to where the live part begins, and from there; bounds: thread, head_end, live_from."""
    at = F.col(seq)
    total = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0)).cast("long")
    return messages.join(bounds, thread).groupBy(thread).agg(
        total(at < F.col("head_end")).alias("head"), total((at >= F.col("head_end")) & (at < F.col("live_from"))).alias("folded"), total(at >= F.col("live_from")).alias("live")
    )
