"""Cut points, continuations and audits over events (stand-in log entries), orders, lineitem and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.operators import audits, points
from talkloom.plans.common import table
from talkloom.plans.retrieval import terms_sql

DAY_MS = points.DAY_MS
TYPES = ["tool_value", "prose_value", "error", "instruction", "revised", "superseded", "decision"]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries: every third a prompt, some compactions, half of them automatic."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", (k % 3 == 0).alias("prompt"), (k % 97 == 0).alias("boundary"), F.when(k % 2 == 0, "auto").otherwise("manual").alias("trigger"),
        F.when(k % 3 == 1, F.floor(F.col("value") * 100)).alias("context"), F.when(k % 3 == 2, F.element_at(F.array(*map(F.lit, ["Edit", "Read", "Bash", "Write"])), (k % 4 + 1).cast("int"))).alias("tool"),
        F.concat(F.lit("/p/"), k % 7).alias("path"), F.when(k % 8 == 2, "cat notes").otherwise("make").alias("command"),
    )


ENTRIES_SQL = """
    e AS (SELECT user_id, event_id, event_id % 3 = 0 AS prompt, event_id % 97 = 0 AS boundary, event_id % 2 = 0 AS auto, CASE WHEN event_id % 3 = 1 THEN floor(value * 100)::BIGINT END AS context,
                 CASE WHEN event_id % 3 = 2 THEN ['Edit', 'Read', 'Bash', 'Write'][event_id % 4 + 1] END AS tool, '/p/' || (event_id % 7) AS path, CASE WHEN event_id % 8 = 2 THEN 'cat notes' ELSE 'make' END AS command FROM events)"""


def compaction_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    files = rows.select("user_id").distinct().withColumns({"size": F.col("user_id") * 50_000, "modified": F.col("user_id") % 80 * DAY_MS})
    return points.compaction_points(rows, files, session="user_id", seq="event_id", now_ms=F.lit(80 * DAY_MS), before=5)


def context_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.context_cuts(entries(spark, sf_dir), session="user_id", seq="event_id", turns=3, least=3_000)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "real").otherwise("synthetic").alias("kind"), k.alias("session"), (F.col("o_custkey") % 9).alias("cwd"), (k % 50).cast("int").alias("before"), (k % 1000).alias("cut"),
        F.length("o_orderstatus").alias("first_length"), k.alias("place"), (k % 11).alias("after"),
    )


POINTS_SQL = """
    p AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'real' ELSE 'synthetic' END AS kind, o_orderkey AS session, o_custkey % 9 AS cwd, o_orderkey % 50 AS before, o_orderkey % 1000 AS cut, o_orderkey AS place, o_orderkey % 11 AS after FROM orders)"""


def chosen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.chosen_points(_points(spark, sf_dir), total=40, per_project=5).select("kind", "session", "cwd")


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.continuations(_points(spark, sf_dir), total=21).select("kind", "session", "after")


def next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    cuts = rows.groupBy("user_id").agg((F.min("event_id") + 500).alias("cut"))
    return points.next_turn(rows, cuts, session="user_id", seq="event_id").select("user_id", "event_id", "part")


def edited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.edited(entries(spark, sf_dir), session="user_id")


def turn_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = entries(spark, sf_dir).where("tool is not null and tool <> 'Edit'").withColumn("h", F.floor(F.col("event_id") / 1000))
    calls = calls.withColumn("session", F.concat_ws("-", "user_id", "h"))
    return points.acts(calls, session="session", seq="event_id", own=F.col("path") != "/p/0")


def marked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("at Base: /a/"), F.col("event_type"), F.lit('" and Base: b/'), F.col("event_id") % 5).alias("line"))
    return points.marked_names(lines, session="user_id", text="line", marker="Base: ")


def junk_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, with every third text taken for one that was interrupted and every seventh cut to one letter."""
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" [Request interrupted by user] "), "text")).when(F.col("conv_id") % 7 == 0, F.substring("text", 1, 1)).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", audits.is_junk(text).alias("junk"))


def revealed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.substring("text", 3, 6), F.lit("no such value"), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(audits.revealed(F.col("text"), values)).alias("n"))


def _plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k, F.element_at(F.array(*map(F.lit, TYPES)), (k % 7 + 1).cast("int")).alias("type"), F.concat(F.lit("v"), k % 4, F.lit("|w")).alias("value"), F.concat(F.lit("v"), k % 3, F.lit("|w")).alias("outputs"),
        F.when(k % 2 == 0, F.concat(F.lit("v"), k % 4, F.lit("|w"))).alias("failed"), F.concat(F.lit("v"), k % 5, F.lit("|w")).alias("prose"), F.concat(F.lit("v"), k % 6, F.lit("|w")).alias("reply"),
        F.concat(F.lit("v"), k % 8, F.lit("|w")).alias("user"), F.concat(F.lit("w v"), k % 9).alias("spoken"),
    )


def plant_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.plant_errors(_plants(spark, sf_dir)).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


def leak_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of every user message is a fact of its turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    plants = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("fact"), "turn", F.split("text", " ")[0].alias("value"))
    return audits.leak_errors(plants, turns.drop("role"), session="conv_id")


def question_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(k, F.when(k % 3 != 0, "what was v1?").alias("question"), F.when(k % 4 == 0, "use v2").alias("task"), F.concat(F.lit("v"), k % 7).alias("answer"),
                                                  F.when(k % 2 == 0, F.concat(F.lit("v"), k % 5)).alias("stale"), (k % 5 == 0).alias("implicit"))
    return audits.question_errors(asked).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.map_from_arrays(F.array(*map(F.lit, "ANR")), F.array(*map(F.lit, ["correct", "stale", "wrong"]))), F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") == 7, "unknown").when(F.col("l_linenumber") < 6, said).alias("verdict"))
    return audits.verdict_counts(rows, ["l_suppkey"]).withColumn("accuracy", F.round("accuracy", 9))


def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(0.0).alias("size"), "l_discount", "l_tax")
    return audits.cost_table(runs, arm="l_suppkey", size="size", means=["l_discount", "l_tax"]).withColumns({"l_discount": F.round("l_discount", 9), "l_tax": F.round("l_tax", 9)})


def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(k % 5 != 0, k % 40 + 1).alias("rank"), (k % 4 == 0).alias("hit"), (F.col("o_custkey") % 100).alias("ms"))
    return audits.retrieval_report(asked, arm="o_orderpriority", rank="rank", hit="hit", ms="ms")


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.report_totals(table(spark, sf_dir, "orders"), sums=["o_orderkey", "o_custkey"], peaks=["o_totalprice"])


def both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ", -1)
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(audits.both_ends(words, 10)).alias("x"))
    return rows.select("doc_id", F.col("x.i").alias("i"), F.col("x.line").alias("word"))


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(audits.chunk_text(F.lit("cat file"), F.split("text", "\n", -1)), 256).alias("sha"))


QUERIES = {
    f.__name__: f
    for f in (compaction_points, context_cuts, chosen_points, continuations, next_turns, edited_files, turn_acts, marked_names, junk_prompts, revealed_values, plant_errors, leak_errors, question_errors,
              verdict_counts, cost_table, retrieval_report, report_totals, both_ends, chunk_texts)
}
MIDDLE = "list_sort(list({0}))[least(floor({1} * count({0}))::BIGINT, count({0}) - 1) + 1]"
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[`''\"“”‘’]', '', 'g'), '(\\d),(\\d{{3}})', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "compaction_points": f"""
        WITH {ENTRIES_SQL}, f AS (SELECT *, min(event_id) FILTER (boundary) OVER (PARTITION BY user_id) AS b, user_id % 80 * {DAY_MS} AS modified FROM e WHERE user_id * 50000 >= 1000000 AND user_id % 80 >= 20)
        SELECT user_id, min(b) AS boundary, count(*) FILTER (prompt AND event_id < b) AS before, min(modified) AS modified FROM f GROUP BY user_id
        HAVING bool_or(event_id = b AND auto) AND before >= 5 AND count(*) FILTER (prompt AND event_id >= b) > 0""",
    "context_cuts": f"""
        WITH {ENTRIES_SQL}, f AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.boundary AND x.event_id <= e.event_id)),
        c AS (SELECT *, coalesce(last_value(CASE WHEN context > 0 THEN context END IGNORE NULLS) OVER w, 0) AS ctx, sum(prompt::INT) OVER w AS n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        g AS (SELECT user_id, min(event_id) FILTER (prompt AND n > 3 AND ctx >= 3000) AS cut, min(n) FILTER (prompt AND n > 3 AND ctx >= 3000) AS at_, max(n) AS every, arg_max(ctx, event_id) AS last FROM c GROUP BY user_id)
        SELECT user_id, cut, coalesce(at_, every)::BIGINT AS turns, CASE WHEN cut IS NULL THEN 0 ELSE every - at_ END::BIGINT AS after, last FROM g""",
    "chosen_points": f"""
        WITH {POINTS_SQL}, a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY cwd, before, cut ORDER BY kind, place) = 1),
        b AS (SELECT * FROM a WHERE kind <> 'real' OR before >= 20 QUALIFY row_number() OVER (PARTITION BY cwd ORDER BY kind, place) <= 5),
        s AS (SELECT * FROM b WHERE kind <> 'real' ORDER BY place LIMIT 20), r AS (SELECT *, row_number() OVER (ORDER BY place) AS n FROM b WHERE kind = 'real')
        SELECT kind, session, cwd FROM s UNION ALL SELECT kind, session, cwd FROM r WHERE n <= 40 - (SELECT count(*) FROM s)""",
    "continuations": f"""
        WITH {POINTS_SQL}, s AS (SELECT * FROM p WHERE kind <> 'real' AND after >= 2 ORDER BY after DESC, place LIMIT 11), r AS (SELECT * FROM p WHERE kind = 'real' AND after >= 2 ORDER BY after DESC, place LIMIT 10)
        SELECT kind, session, after FROM s UNION ALL SELECT kind, session, after FROM r""",
    "next_turns": f"""
        WITH {ENTRIES_SQL}, c AS (SELECT *, min(event_id) OVER (PARTITION BY user_id) + 500 AS cut FROM e), f AS (SELECT user_id, min(event_id) AS a FROM c WHERE prompt AND event_id >= cut GROUP BY 1),
        z AS (SELECT f.user_id, a, min(event_id) AS b FROM f LEFT JOIN e ON e.user_id = f.user_id AND prompt AND event_id > a GROUP BY ALL)
        SELECT e.user_id, event_id, CASE WHEN prompt THEN 0 ELSE 1 END::INT AS part FROM e JOIN z ON e.user_id = z.user_id AND event_id >= a AND (b IS NULL OR event_id < b)""",
    "edited_files": f"WITH {ENTRIES_SQL} SELECT DISTINCT user_id, path FROM e WHERE tool IN ('Edit', 'Write')",
    "turn_acts": f"""
        WITH {ENTRIES_SQL}, c AS (SELECT *, user_id || '-' || (event_id // 1000) AS session, tool = 'Read' OR command = 'cat notes' AS reads FROM e WHERE tool <> 'Edit'),
        f AS (SELECT session, min(event_id) AS first FROM c WHERE NOT reads GROUP BY 1)
        SELECT c.session, count(*) AS calls, count(*) FILTER (path <> '/p/0' AND (first IS NULL OR event_id < first)) AS reads_before FROM c LEFT JOIN f USING (session) GROUP BY 1""",
    "marked_names": "SELECT DISTINCT user_id, event_type AS name FROM events UNION SELECT DISTINCT user_id, (event_id % 5)::VARCHAR FROM events",
    "junk_prompts": f"""
        WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN left(text, 1) ELSE text END AS text FROM conversations)
        SELECT conv_id, turn, conv_id % 3 = 0 OR len(list_distinct({terms_sql("text")})) < 3 AS junk FROM t""",
    "revealed_values": f"""
        WITH v AS (SELECT conv_id, turn, {NORM.format("text")} AS t, {NORM.format("substring(text, 3, 6)")} AS a FROM conversations) SELECT conv_id, turn, (a <> '' AND contains(t, a))::INT AS n FROM v""",
    "plant_errors": """
        WITH p AS (SELECT o_orderkey, o_orderkey % 7 AS y, o_orderkey % 4 = o_orderkey % 3 AS o, o_orderkey % 2 = 0 AS f, o_orderkey % 4 = o_orderkey % 5 AS p, o_orderkey % 4 = o_orderkey % 6 AS r, o_orderkey % 4 = o_orderkey % 8 AS u,
                          o_orderkey % 4 = o_orderkey % 9 AS s FROM orders)
        SELECT o_orderkey, concat_ws(',', CASE WHEN y IN (0, 1, 5) AND NOT o THEN 'not in output' END, CASE WHEN y = 2 AND NOT f THEN 'not in failed output' END, CASE WHEN y IN (0, 2) AND p THEN 'in prose' END,
            CASE WHEN y = 1 AND NOT r THEN 'not in reply' END, CASE WHEN y IN (3, 4) AND NOT u THEN 'not in prompt' END, CASE WHEN y = 6 AND NOT s THEN 'not spoken' END) AS errors FROM p""",
    "leak_errors": """
        WITH v AS (SELECT conv_id, turn AS fact, unnest(string_split(split_part(text, ' ', 1), '|')) AS value FROM conversations WHERE role = 'user')
        SELECT DISTINCT v.conv_id, fact, value, turn FROM v JOIN conversations c ON c.conv_id = v.conv_id AND value <> '' AND contains(text, value) AND turn <> fact""",
    "question_errors": """
        SELECT o_orderkey, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'no question' END, CASE WHEN (k % 3 <> 0 AND (k % 7 = 1 OR (k % 2 = 0 AND k % 5 = 1))) OR (k % 4 = 0 AND (k % 7 = 2 OR (k % 2 = 0 AND k % 5 = 2))) THEN 'tells the value' END,
            CASE WHEN k % 5 = 0 AND k % 4 <> 0 THEN 'no task' END) AS errors FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
    "verdict_counts": """
        WITH v AS (SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN 'unknown' WHEN l_linenumber < 6 THEN CASE l_returnflag WHEN 'A' THEN 'correct' WHEN 'N' THEN 'stale' ELSE 'wrong' END END AS v FROM lineitem)
        SELECT l_suppkey, count(v) AS n, count(*) FILTER (v = 'correct') AS correct, count(*) FILTER (v = 'stale') AS stale, count(*) FILTER (v = 'wrong') AS wrong, count(*) FILTER (v = 'unknown') AS "unknown",
               round(count(*) FILTER (v = 'correct')::DOUBLE / nullif(count(v), 0), 9) AS accuracy FROM v GROUP BY 1""",
    "cost_table": f"""
        WITH t AS (SELECT l_suppkey, CASE WHEN l_linenumber > 1 AND l_quantity <> 0 THEN l_quantity::DOUBLE END AS q, l_discount, l_tax FROM lineitem), s AS (SELECT l_suppkey, {MIDDLE.format("q", 0.5)} AS size FROM t WHERE q IS NOT NULL GROUP BY 1)
        SELECT t.l_suppkey, coalesce(min(size), 0) AS size, round(avg(l_discount), 9) AS l_discount, round(avg(l_tax), 9) AS l_tax FROM t LEFT JOIN s USING (l_suppkey) GROUP BY 1""",
    "retrieval_report": f"""
        WITH a AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 40 + 1 END AS r, o_orderkey % 4 = 0 AS hit, o_custkey % 100 AS ms FROM orders)
        SELECT o_orderpriority, count(*) AS asked, count(*) FILTER (hit) AS hits, count(*) FILTER (r <= 12) AS within, count(*) FILTER (r <= 30) AS among, {MIDDLE.format("ms", 0.5)} AS middle_ms, {MIDDLE.format("ms", 0.95)} AS p95_ms FROM a GROUP BY 1""",
    "report_totals": "SELECT sum(o_orderkey)::BIGINT AS o_orderkey, sum(o_custkey)::BIGINT AS o_custkey, max(o_totalprice) AS o_totalprice FROM orders",
    "both_ends": """
        WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM w)
        SELECT doc_id, i::INT AS i, word FROM x WHERE n <= 10 OR i < 5 OR i >= n - 5""",
    "chunk_texts": "SELECT doc_id, sha256(left('cat file' || chr(10) || text, 1200)) AS sha FROM documents WHERE text IS NOT NULL",
}
