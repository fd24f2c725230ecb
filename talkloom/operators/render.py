"""Turns as Markdown, XML and an index, all as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T

# Sentences of the rendered files.
NO_REPLY = "_No final reply: the turn was interrupted or is still running._"
NO_FINAL = "_(no final reply)_"
INDEX_TITLE, INDEX_HEAD = "# Session index", "One line per turn: what the user asked → how the turn ended. Open turn-NNNN.{extension} for everything that happened in it."

NO_RUN_REPLY = "_No final reply: the run was interrupted or is still going._"
RUN_HEAD = "This is the full record of a subagent launched from turn %s; that turn only holds its final report."
RUN_NOTE = (
    " Indented lines are subagents the agent launched in that turn; turn-NNNN-subagent-K.{extension} holds the subagent's whole run, "
    "which the turn itself only has the report of."
)


def turn_file(number: Column, extension: str = "md") -> Column:
    return F.format_string(f"turn-%04d.{extension}", number)


def run_file(parent: Column, k: Column, extension: str = "md") -> Column:
    return F.format_string(f"turn-%04d-subagent-%d.{extension}", parent, k)


def calls(n: Column) -> Column:
    return F.when(n == 1, "1 tool call").otherwise(F.concat(n.cast("string"), F.lit(" tool calls")))


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def tool_markdown(p: Column, total: Column) -> Column:
    head = F.concat(F.lit("### [tool "), p["n"].cast("string"), F.lit("/"), total.cast("string"), F.lit("] "), p["name"], F.lit(": "), p["call"])
    fence = F.concat(F.lit("[output of tool "), p["n"].cast("string"), F.when(p["error"], ", error").otherwise(""), F.lit("]\n```\n"), p["output"], F.lit("\n```"))
    output = F.when(p["output"] != "", fence).otherwise(F.concat(F.lit("[tool "), p["n"].cast("string"), F.lit(": no output]")))
    return F.concat_ws("\n\n", head, F.when(p["body"] != "", p["body"]), output)


def tool_xml(p: Column, total: Column) -> Column:
    head = F.concat(F.lit('<tool n="'), p["n"].cast("string"), F.lit('" of="'), total.cast("string"), F.lit('" name="'), T.xml_attribute(p["name"]), F.lit('">'))
    call = F.concat(F.lit("<call>"), F.regexp_replace(p["call"], "^`|`$", ""), F.lit("</call>"))
    body = F.when(p["body"] != "", F.concat(F.lit("<input>\n"), p["body"], F.lit("\n</input>")))
    output = F.when(p["output"] != "", F.concat(F.lit("<output"), F.when(p["error"], ' error="true"').otherwise(""), F.lit(">\n"), p["output"], F.lit("\n</output>"))).otherwise("<output/>")
    return F.concat_ws("\n", head, call, body, output, F.lit("</tool>"))


def work_markdown() -> Column:
    one = lambda p: F.when(p["kind"] == "say", F.concat(F.lit("> "), F.replace(p["text"], F.lit("\n"), F.lit("\n> ")))).otherwise(tool_markdown(p, F.col("calls")))
    return F.when(F.size("parts") > 0, F.array_join(F.transform("parts", one), "\n\n")).otherwise("_No tool calls._")


def markdown() -> Column:
    """A turn (number, time, prompt, parts, final, calls) as Markdown; parts are (kind, n, name, call, body, output, error, text) in order."""
    total, work = F.col("calls"), work_markdown()
    title = F.concat(F.lit("# Turn "), F.col("number").cast("string"), F.when(F.col("time") != "", F.concat(F.lit(" · "), F.col("time"))).otherwise(""))
    final = F.when(F.col("final") != "", F.col("final")).otherwise(NO_REPLY)
    return _lines(title, "", "## User", "", F.col("prompt"), "", F.concat(F.lit("## Work ("), calls(total), F.lit(")")), "", work, "", "## Final reply", "", final, "")


def xml() -> Column:
    total = F.col("calls")
    one = lambda p: F.when(p["kind"] == "say", F.concat(F.lit("<said>\n"), p["text"], F.lit("\n</said>"))).otherwise(tool_xml(p, total))
    head = F.concat(F.lit('<turn n="'), F.col("number").cast("string"), F.lit('"'), F.when(F.col("time") != "", F.concat(F.lit(' time="'), F.col("time"), F.lit('"'))).otherwise(""), F.lit(' tool_calls="'), total.cast("string"), F.lit('">'))
    final = F.when(F.col("final") != "", F.concat(F.lit("<final_reply>\n"), F.col("final"), F.lit("\n</final_reply>"))).otherwise('<final_reply interrupted="true"/>')
    work = F.when(F.size("parts") > 0, F.array_join(F.transform("parts", one), "\n"))
    return _lines(head, F.concat(F.lit("<user>\n"), F.col("prompt"), F.lit("\n</user>")), work, final, "</turn>", "")


def _final(text: Column) -> Column:
    return F.when(text != "", T.clip(text, 160)).otherwise(NO_FINAL)


def run_lines(records: DataFrame, thread: str, extension: str = "md") -> DataFrame:
    """(thread, turn, k, line): index lines of side runs (thread, turn, k, description, calls, final)."""
    file = run_file(F.col("turn"), F.col("k"), extension)
    about = F.concat(F.lit('**: subagent "'), T.clip(F.col("description"), 140), F.lit('" ('), F.col("calls").cast("string"), F.lit(" calls) → "), _final(F.coalesce("final", F.lit(""))))
    return records.select(thread, "turn", "k", F.concat(F.lit("  - **"), file, about).alias("line"))


def index(turns: DataFrame, thread: str, extension: str = "md", records: DataFrame | None = None) -> DataFrame:
    """(thread, content): one line per turn, in order; side runs below the turn that launched them, those of no turn last."""
    line = F.concat(F.lit("- **"), turn_file(F.col("number"), extension), F.lit("** ("), F.col("time"), F.lit(", "), F.col("calls").cast("string"), F.lit(" calls): "), T.clip(F.col("prompt"), 140), F.lit(" → "), _final(F.col("final")))
    rows = turns.select(thread, F.struct(F.col("number").cast("long").alias("a"), F.lit(0).cast("long").alias("k"), line.alias("line")).alias("l"))
    if records is not None:
        last = F.when(F.col("turn") > 0, F.col("turn")).otherwise(F.lit(2**62)).cast("long")
        rows = rows.union(run_lines(records, thread, extension).select(thread, F.struct(last.alias("a"), F.col("k").cast("long").alias("k"), "line").alias("l")))
    per = rows.groupBy(thread).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    note = F.when(F.exists("ls", lambda l: l["k"] > 0), RUN_NOTE.format(extension=extension)).otherwise("")
    return per.select(thread, _lines(INDEX_TITLE, "", F.concat(F.lit(INDEX_HEAD.format(extension=extension)), note), "", F.array_join(F.transform("ls", lambda l: l["line"]), "\n"), "").alias("content"))


def run_files(turns: DataFrame, records: DataFrame, *, as_xml: bool = False) -> DataFrame:
    """(run_id, file, content): the whole record of each side run, from its turns (run_id and the columns of markdown()) and records (run_id, turn, k, description)."""
    alone = F.count(F.lit(1)).over(W.partitionBy("run_id")) == 1
    head = F.when(F.col("__alone"), "## Task").otherwise(F.concat(F.lit("## Message "), F.col("number").cast("string")))
    final = F.when(F.col("final") != "", F.col("final")).otherwise(NO_RUN_REPLY)
    text = xml() if as_xml else _lines(head, "", F.col("prompt"), "", F.concat(F.lit("## Work ("), calls(F.col("calls")), F.lit(")")), "", work_markdown(), "", "## Final reply", "", final, "")
    rows = turns.withColumn("__alone", alone).select("run_id", F.struct("number", text.alias("text")).alias("x"))
    bodies = rows.groupBy("run_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["text"]), "\n")
    found = records.join(bodies, "run_id", "left")
    if as_xml:
        open_ = F.concat(F.lit('<subagent parent_turn="'), F.col("turn").cast("string"), F.lit('" description="'), T.xml_attribute(F.col("description")), F.lit('">'))
        content = _lines(open_, body, "</subagent>", "")
    else:
        parent = F.when(F.col("turn") > 0, F.col("turn").cast("string")).otherwise("?")
        content = _lines(F.concat(F.lit("# Subagent of turn "), parent, F.lit(' · "'), F.col("description"), F.lit('"')), F.format_string(RUN_HEAD, parent), "", body)
    return found.select("run_id", run_file(F.col("turn"), F.col("k"), "xml" if as_xml else "md").alias("file"), content.alias("content"))
