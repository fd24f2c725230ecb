"""Queries through stored tables and sources of the library's own: the inverted index, growing log files, kept state."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.operators import compaction, evals, material, retrieval as R
from talkloom.plans.common import table
from talkloom.plans.conversations import split
from talkloom.plans.retrieval import bm25_sql, terms_sql
from talkloom.sources import index, logs, tail
from talkloom.sources.tables import shared_folder


def stored_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the index over the documents of a table directory, appended in two batches if this application has none yet."""
    of = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()[:16]
    path = f"{shared_folder(spark)}/index-{of}"
    docs = table(spark, sf_dir, "documents")
    for batch, rows in (("even", docs.where("doc_id % 2 = 0")), ("rest", docs)):  # what the first batch holds is left out of the second
        index.append(rows, path, key=["doc_id"], terms=T.terms(F.col("text")), batch=batch)
    return path


def index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and terms of each batch of the stored index."""
    return index.commits(spark, stored_index(spark, sf_dir)).select("batch", "docs", "terms")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return index.search(spark, stored_index(spark, sf_dir), items, query_id="item_id", query_terms=T.terms(F.col("text")), key=["doc_id"])


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best documents of each benchmark item through the stored index."""
    return R.ranked(_search(spark, sf_dir), "item_id", ["doc_id"], 12).select("item_id", "rank", "doc_id", "matched", F.round("score", 6).alias("score"))


def reranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty candidates of each item, reordered by a hook that puts greater ids first, leaves out multiples of 3 and fails on every fifth item."""

    def newest(item: int, found: list) -> list:
        if item % 5 == 0:
            raise RuntimeError("no answer")
        return sorted((d for d in found if d % 3), reverse=True)

    hits = R.ranked(_search(spark, sf_dir), "item_id", ["doc_id"], 30)
    return R.reranked(hits, newest, query_id="item_id", key=["doc_id"])


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as session logs, one folder for each part, and read back through the source of growing files."""
    rows = table(spark, sf_dir, "conversations")
    message = F.struct("role", F.col("text").alias("content"))
    line = F.to_json(F.struct(F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.col("conv_id").cast("string").alias("agentId"), message.alias("message")))
    of = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()[:16]
    path = f"{shared_folder(spark)}/session-logs-{of}"
    rows.select(line.alias("value")).write.mode("overwrite").option("compression", "none").text(path)
    spark.dataSource.register(tail.GrowingLines)
    read = spark.read.format("growing_lines").option("path", path).option("suffix", ".txt").load()
    entries = logs.messages(logs.session_entries(read.selectExpr("file", "start as line", "value")), None)
    text = logs.joined_text(F.col("blocks"))
    per = entries.select(F.col("agent_id").alias("conv_id"), "role", "type", F.length(text).alias("chars"), F.sha2(text, 256).alias("sha"))
    return per.groupBy("conv_id", "role", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("sha").alias("least"), F.max("sha").alias("most"))


def compaction_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as requests under a window of 400 tokens: assistant texts stand in for tool results, prompts for what stays of a turn."""
    rows = split(spark, sf_dir).where("turn_no > 0").groupBy(F.col("conv_id").cast("string").alias("thread"), F.col("turn_no").alias("n"))
    of = lambda role: F.when(F.col("role") == role, F.length("text"))
    prompt, results = F.coalesce(F.sum(of("user")), F.lit(0)), F.array_sort(F.collect_list(of("assistant").cast("long")))
    sized = rows.agg(F.sum(F.length("text")).cast("long").alias("chars"), prompt.cast("long").alias("short"), F.count(F.lit(1)).cast("int").alias("messages"), results.alias("results"))
    requests = sized.select(
        "thread", F.col("n").cast("long").alias("seq"), (F.col("n") - 1).cast("int").alias("turn"), F.concat(F.lit("k"), "n").alias("key"), "chars", "short", F.col("short").alias("opening"), "messages",
        F.lit(None).cast("array<struct<id:string,chars:long>>").alias("notes"), "results", F.lit(False).alias("interrupted"), F.lit(False).alias("pinned"), F.lit(400).cast("long").alias("fixed"), F.lit(400).cast("long").alias("window"),
        F.lit(True).alias("may"), F.lit(None).cast("string").alias("recall"),
    )
    rules = compaction.Rules(keep_turns=2, keep=1, budget=150, turn_cap=None, notice=40, stub=20)
    return compaction.compacted(requests, rules)


def source_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was said in the first half of each conversation, its last 700 characters, and the next prompts; assistant texts of odd rows stand in for tool output."""
    rows = table(spark, sf_dir, "conversations").withColumn("half", F.floor((F.max("turn").over(W.partitionBy("conv_id")) + 1) / 2))
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("turn") % 4 == 1, "output").otherwise("said")
    parts = rows.where("turn <= half").select("conv_id", "turn", F.lit(0).alias("n"), kind.alias("kind"), F.lit(None).cast("string").alias("name"), "text")
    following = rows.where("turn > half and role = 'user'").select("conv_id", "turn", "text")
    made = material.source_material(parts, following, thread="conv_id", seq="turn", budget=700)
    return made.select("conv_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


def transcript_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole transcripts of conversations as parts: how many, how long, and the first and last digest of each."""
    rows = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("turn") % 4 == 1, "output").otherwise("said")
    parts = material.transcript_parts(rows.select("conv_id", "turn", F.lit(0).alias("n"), kind.alias("kind"), F.lit(None).cast("string").alias("name"), "text"), thread="conv_id", seq="turn")
    return parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("part")).alias("chars"), F.sha2(F.min_by("part", "turn"), 256).alias("first"), F.sha2(F.max_by("part", "turn"), 256).alias("last"))


def point_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts and taxes of lines as two arms against a baseline of quantities, paired by the supplier's nation: 400 resampled means."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    arm = lambda name, c: F.struct(F.lit(name).alias("arm"), (F.col(c) - F.col("l_quantity") / 500).alias("diff"))
    rows = lines.select("s_nationkey", F.explode(F.array(arm("discount", "l_discount"), arm("tax", "l_tax"))).alias("x")).select("s_nationkey", "x.*")
    made = evals.bootstrap_points(rows, arm="arm", point="s_nationkey", order="s_nationkey", diff="diff", draws=400)
    return made.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "above", "below")


_DOCS = f"SELECT doc_id, {terms_sql('text')} AS terms FROM documents"
_ITEMS = f"SELECT item_id AS q, {terms_sql('text')} AS terms FROM benchmark"
_RANKED = f"WITH {bm25_sql(_ITEMS, _DOCS, 'doc_id', 2)}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"

QUERIES = {f.__name__: f for f in (index_batches, indexed_topk, reranked_topk, log_entries, compaction_notes, source_material, transcript_lengths, point_bootstrap)}
_PARTS = """
    h AS (SELECT *, (max(turn) OVER (PARTITION BY conv_id) + 1) // 2 AS half, CASE WHEN role = 'user' THEN 'prompt' WHEN turn % 4 = 1 THEN 'output' ELSE 'said' END AS kind FROM conversations)"""
ORACLE_SQL = {
    "source_material": f"""
        WITH {_PARTS},
        t AS (SELECT *, count(*) FILTER (kind = 'prompt') OVER (PARTITION BY conv_id ORDER BY turn) AS no, count(*) FILTER (kind = 'prompt') OVER (PARTITION BY conv_id) AS total FROM h WHERE turn <= half),
        l AS (SELECT conv_id, turn, CASE kind WHEN 'prompt' THEN chr(10) || '### Turn ' || no || ' (' || CASE WHEN no = total THEN 'IN PROGRESS when the context filled' ELSE (total - no) || ' before the cut' END || ')' || chr(10) || 'USER: ' || left(text, 2500)
                     WHEN 'said' THEN 'AGENT: ' || left(text, 2000) ELSE 'TOOL OUTPUT: ' || left(regexp_replace(text, '\\s+', ' ', 'g'), 1500) END AS line FROM t WHERE no > 0 AND (kind = 'prompt' OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')),
        j AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS s FROM l GROUP BY conv_id),
        a AS (SELECT conv_id, string_agg(left(text, 1200), chr(10) || '---' || chr(10) ORDER BY turn) AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM h WHERE turn > half AND role = 'user') WHERE k <= 2 GROUP BY conv_id),
        o AS (SELECT conv_id, CASE WHEN length(j.s) > 700 THEN '[earliest turns truncated]' || chr(10) || right(j.s, 700) ELSE j.s END || chr(10) || chr(10)
                     || '=== WHAT THE USER ASKED NEXT, AFTER THE CUT (only for the continuation reference answers) ===' || chr(10) || coalesce(a.s, '') AS text FROM j LEFT JOIN a USING (conv_id))
        SELECT conv_id, length(text)::INT AS chars, sha256(text) AS sha FROM o""",
    "transcript_lengths": f"""
        WITH {_PARTS}, t AS (SELECT *, count(*) FILTER (kind = 'prompt') OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM h),
        p AS (SELECT conv_id, turn, CASE kind WHEN 'prompt' THEN '### Turn ' || no || chr(10) || chr(10) || '**You:** ' || text WHEN 'said' THEN '**Agent:** ' || trim(text, ' ' || chr(9) || chr(10) || chr(13))
                     ELSE '```' || chr(10) || left(text, 20000) || chr(10) || '```' END AS part FROM t WHERE no > 0 AND (kind <> 'said' OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''))
        SELECT conv_id, count(*) AS parts, sum(length(part))::BIGINT AS chars, sha256(arg_min(part, turn)) AS first, sha256(arg_max(part, turn)) AS last FROM p GROUP BY conv_id""",
    "point_bootstrap": """
        WITH RECURSIVE q AS (SELECT unnest(['discount', 'tax']) AS arm, unnest([l_discount, l_tax]) - l_quantity / 500 AS diff, s_nationkey AS point FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
        per AS (SELECT arm, point, avg(diff) AS d FROM q GROUP BY ALL), xs AS (SELECT arm, list(d ORDER BY point) AS ds, count(*) AS n FROM per GROUP BY arm),
        g(k, s) AS (SELECT 0::BIGINT, (20261008::BIGINT * 1664525 + 1013904223) % 4294967296 UNION ALL SELECT k + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g WHERE k + 1 < 400 * (SELECT max(n) FROM xs)),
        m AS (SELECT arm, k // n AS draw, avg(ds[floor(s / 4294967296 * n)::BIGINT + 1]) AS m FROM xs, g WHERE k < 400 * n GROUP BY ALL),
        r AS (SELECT arm, m, row_number() OVER (PARTITION BY arm ORDER BY m) - 1 AS i FROM m)
        SELECT arm, any_value(n) AS n, round(any_value(list_avg(ds)), 6) AS mean, round(min(m) FILTER (i = 10), 6) AS low, round(min(m) FILTER (i = 390), 6) AS high,
               any_value(len(list_filter(ds, lambda x: x > 0))) AS above, any_value(len(list_filter(ds, lambda x: x < 0))) AS below FROM r JOIN xs USING (arm) GROUP BY arm""",
    "index_batches": f"""
        WITH d AS ({_DOCS}) SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'rest' END AS batch, count(*) AS docs, coalesce(sum(len(terms)), 0)::BIGINT AS terms FROM d GROUP BY 1""",
    "indexed_topk": f"{_RANKED} SELECT q AS item_id, rank, doc_id, matched, round(score, 6) AS score FROM r WHERE rank <= 12",
    "reranked_topk": f"""
        {_RANKED}, c AS (SELECT *, q % 5 <> 0 AS told, q % 5 <> 0 AND doc_id % 3 <> 0 AS named FROM r WHERE rank <= 30),
        o AS (SELECT q AS item_id, doc_id, told AS reranked, row_number() OVER (PARTITION BY q ORDER BY named DESC, CASE WHEN named THEN -doc_id ELSE rank END) AS rank FROM c)
        SELECT * FROM o WHERE rank <= 12""",
    "log_entries": """
        SELECT conv_id::VARCHAR AS conv_id, role, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS type, count(*) AS n, sum(length(text))::BIGINT AS chars,
               min(sha256(text)) AS least, max(sha256(text)) AS most FROM conversations GROUP BY ALL""",
}
