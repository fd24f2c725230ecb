"""Session log entries to the turns that transcripts are rendered from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.operators.context import call_body, call_description, capped_output
from talkloom.operators.turns import call_results
from talkloom.sources import logs

#: What stands where the host compacted its context.
BOUNDARY = "(The context was compacted here.)"
PART = "struct<kind:string,n:bigint,name:string,call:string,body:string,output:string,error:boolean,text:string>"


def prompt_text(blocks: Column) -> Column:
    """Text of an entry without reminders and system messages, trimmed."""
    return T.trimmed(F.regexp_replace(logs.joined_text(blocks), r"(?s)<(system-reminder|system-message)>.*?</\1>", ""))


def opens_turn(entry_type: Column, is_meta: Column, is_summary: Column, blocks: Column) -> Column:
    """The log's own prompt rule: a user entry, neither meta nor a summary, without results, that says something or shows an image."""
    has = lambda kind: F.exists(blocks, lambda b: F.coalesce(b["type"] == kind, F.lit(False)))
    return (entry_type == "user") & ~is_meta & ~is_summary & ~has("tool_result") & ((prompt_text(blocks) != "") | has("image"))


def numbered(entries: DataFrame, *, thread: str, seq: str = "line", sidechain: bool | None = False) -> DataFrame:
    """Entries with opens and turn (0 in front of the first prompt); side chains as asked for (None: all)."""
    rows = entries if sidechain is None else entries.where(F.col("is_sidechain") == sidechain)
    rows = rows.withColumn("opens", F.coalesce(opens_turn(F.col("type"), F.col("is_meta"), F.col("is_summary"), F.col("blocks")), F.lit(False)))
    return rows.withColumn("turn", F.sum(F.col("opens").cast("int")).over(W.partitionBy(thread).orderBy(seq)))


def output_text(content: Column) -> Column:
    """A result's text: text blocks as they are, others by their kind in brackets; long ones cut."""
    parts = F.transform(logs.blocks(content), lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).otherwise(F.concat(F.lit("["), b["type"], F.lit("]"))))
    return capped_output(F.array_join(parts, "\n"))


def narrated(rows: DataFrame, *, thread: str, turn: str = "turn", seq: list[str]) -> DataFrame:
    """Assistant rows (text or is_call) with call_no, say and final.

    say, on a call: the last text since the call before it, even one of an earlier turn; final, on a text:
    whether it is the turn's last and no call follows it.
    """
    order, per = W.partitionBy(thread).orderBy(*seq), W.partitionBy(thread, turn)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    words = F.when(~F.col("is_call") & (T.trimmed(F.coalesce("text", F.lit(""))) != ""), T.trimmed(F.col("text")))
    rows = rows.withColumns({"__n": F.row_number().over(order), "__w": words})
    said = F.when(F.col("__w").isNotNull(), F.col("__n"))
    called = F.when(F.col("is_call"), F.col("__n"))
    open_ = F.max(said).over(before) > F.coalesce(F.max(called).over(before), F.lit(0))
    rows = rows.withColumns({
        "say": F.when(F.col("is_call") & open_, F.last("__w", ignorenulls=True).over(before)),
        "call_no": F.when(F.col("is_call"), F.sum(F.col("is_call").cast("bigint")).over(per.orderBy(*seq))),
        "final": F.coalesce((F.max(said).over(per) == F.col("__n")) & (F.col("__n") > F.coalesce(F.max(called).over(per), F.lit(0))), F.lit(False)),
    })
    return rows.drop("__n", "__w")


def turns(entries: DataFrame, *, thread: str = "file", seq: str = "line", sidechain: bool | None = False) -> DataFrame:
    """(thread, number, time, prompt, parts, final, calls) for render.markdown and render.xml.

    A call carries its first result of the log; what was said in front of it and compaction marks are parts
    of their own.  A turn is one rendered file, so its parts are gathered; nothing larger is.
    """
    rows = numbered(entries, thread=thread, seq=seq, sidechain=sidechain).where("turn > 0")
    prompt = F.when(prompt_text(F.col("blocks")) != "", prompt_text(F.col("blocks"))).otherwise("[image]")
    time = F.replace(F.substring(F.coalesce("ts", F.lit("")), 1, 16), F.lit("T"), F.lit(" "))
    heads = rows.where("opens").select(thread, F.col("turn").alias("number"), time.alias("time"), prompt.alias("prompt"))
    rest = rows.where("not opens")
    flat = rest.where("type in ('assistant', 'user')").select(thread, "turn", seq, F.col("type").alias("by"), F.posexplode("blocks").alias("pos", "b"))
    is_call = F.coalesce(F.col("b.type") == "tool_use", F.lit(False))
    input_ = F.coalesce(F.to_json(F.col("b.input")), F.lit("{}"))
    said = flat.where((F.col("by") == "assistant") & F.col("b.type").isin("text", "tool_use")).select(
        thread, "turn", seq, "pos", is_call.alias("is_call"), F.col("b.text").alias("text"), F.col("b.id").alias("call_id"), F.col("b.name").alias("name"),
        F.when(is_call, call_description(input_)).alias("call"), F.when(is_call, call_body(F.col("b.name"), input_)).alias("body"),
    )
    spoken = narrated(said, thread=thread, seq=[seq, "pos"])
    results = flat.where("by = 'user' and b.type = 'tool_result'").select(
        thread, F.col("b.tool_use_id").alias("call_id"), F.struct(seq, "pos").alias("__at"), T.trimmed(output_text(F.col("b.content"))).alias("output"), F.coalesce("b.is_error", F.lit(False)).alias("error")
    )
    calls = call_results(spoken.where("is_call"), results, scope=[thread], call_id="call_id", seq=seq, result_seq="__at", last=False, how="left")
    part = lambda **have: F.struct(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split(":") for x in PART[7:-1].split(","))])
    at = lambda pos, step: F.struct(F.col(seq).alias("s"), pos.alias("p"), F.lit(step).alias("t"))
    tool = part(kind=F.lit("tool"), n=F.col("call_no"), name=F.col("name"), call=F.col("call"), body=F.col("body"), output=F.coalesce("output", F.lit("")), error=F.coalesce("error", F.lit(False)))
    words = F.when(F.col("say").isNotNull(), F.struct(at(F.col("pos"), 0).alias("at"), part(kind=F.lit("say"), text=F.col("say"), error=F.lit(False)).alias("part")))
    work = calls.select(thread, "turn", F.explode(F.array_compact(F.array(words, F.struct(at(F.col("pos"), 1).alias("at"), tool.alias("part"))))).alias("x"), F.lit(None).cast("string").alias("final"))
    marks = rest.where("type = 'system' and subtype = 'compact_boundary'").select(
        thread, "turn", F.struct(at(F.lit(0), 0).alias("at"), part(kind=F.lit("say"), text=F.lit(BOUNDARY), error=F.lit(False)).alias("part")).alias("x"), F.lit(None).cast("string").alias("final")
    )
    finals = spoken.where("final").select(thread, "turn", F.lit(None).cast(work.schema["x"].dataType).alias("x"), T.trimmed(F.col("text")).alias("final"))
    per = work.unionByName(marks).unionByName(finals).groupBy(thread, F.col("turn").alias("number")).agg(F.array_sort(F.collect_list("x")).alias("x"), F.max("final").alias("final"))
    per = per.select(thread, "number", F.transform("x", lambda p: p["part"]).alias("parts"), F.coalesce("final", F.lit("")).alias("final"))
    out = heads.join(per, [thread, "number"], "left")
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    return out.select(thread, "number", "time", "prompt", parts.alias("parts"), F.coalesce("final", F.lit("")).alias("final"), F.size(F.filter(parts, lambda p: p["kind"] == "tool")).cast("long").alias("calls"))


def ask_line(text: Column, most: int = 80) -> Column:
    """A prompt on one line, cut at the last space before `most`, or at half of it where that is further."""
    flat = T.collapse(F.coalesce(text, F.lit("")))
    head = F.substring(flat, 1, most)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    end = F.greatest(F.when(F.instr(head, " ") > 0, space).otherwise(-1), F.lit(most // 2))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(head, F.lit(1), end.cast("int")), F.lit("…")))
