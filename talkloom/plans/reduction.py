"""Short turns, recall chunks, cuts and rendered logs over the conversations, whose lines stand in for messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.operators import reduction, render, transcripts
from talkloom.plans.common import table
from talkloom.plans.conversations import SPLIT_SQL, split
from talkloom.plans.retrieval import terms_sql

LATE = "[Image: original 4x4, displayed at 2x2.]"


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages stay; of an assistant's lines every five are a text, a call, its result, a note of the host and late user text."""
    rows = split(spark, sf_dir).select("conv_id", F.col("turn_no").alias("turn"), F.col("turn").alias("message"), "role", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    k, own = F.col("i") % 5, F.col("role") != "user"
    role = F.when(~own | k.isin(2, 4), "user").when(k == 3, "system").otherwise("assistant")
    kind = F.when(own & (k == 1), "tool_use").when(own & (k == 2), "tool_result").otherwise("text")
    text = F.when(own & (k == 3), F.substring("line", 1, 1)).when(own & (k == 4) & (F.col("i") % 2 == 0), LATE).when(kind == "tool_use", F.lit(None)).otherwise(F.col("line"))
    call = F.when(kind != "text", F.concat_ws("-", "message", F.floor(F.col("i") / 5)))
    out = rows.select("conv_id", "turn", (F.col("message") * 100_000 + F.col("i")).alias("seq"), F.lit(0).alias("pos"), role.alias("role"), kind.alias("type"), text.alias("text"), call.alias("call_id"),
                      F.when(kind == "tool_use", F.concat(F.lit("Run "), F.substring("line", 1, 20))).alias("label"))
    return out.withColumns({"said": F.when(F.col("type") == "text", F.col("text")).otherwise(""), "has_content": (F.col("type") != "text") | reduction.filled(F.col("text"))})


BLOCKS_SQL = f"""{SPLIT_SQL},
    bl AS (SELECT conv_id, turn_no AS turn, turn AS message, role, i - 1 AS i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM s)),
    bk AS (SELECT *, message * 100000 + i AS seq, CASE WHEN role = 'user' OR i % 5 IN (2, 4) THEN 'user' WHEN i % 5 = 3 THEN 'system' ELSE 'assistant' END AS who,
                  CASE WHEN role <> 'user' AND i % 5 = 1 THEN 'tool_use' WHEN role <> 'user' AND i % 5 = 2 THEN 'tool_result' ELSE 'text' END AS type FROM bl),
    b AS (SELECT conv_id, turn, seq, who AS role, type, CASE WHEN role <> 'user' AND i % 5 = 3 THEN left(line, 1) WHEN role <> 'user' AND i % 10 = 4 THEN '{LATE}' WHEN type <> 'tool_use' THEN line END AS text,
                 CASE WHEN type <> 'text' THEN message || '-' || (i // 5) END AS call_id, CASE WHEN type = 'tool_use' THEN 'Run ' || left(line, 20) END AS label FROM bk)"""


def reduced_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reduction.reduced_turns(block_rows(spark, sf_dir), thread="conv_id")
    return found.select("conv_id", "turn", "part", F.when(F.col("text").startswith(reduction.INTERRUPTED), -1).otherwise(F.col("seq")).alias("seq"), "role", "type", F.sha2("text", 256).alias("sha"))


def trimmed_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.trimmed_threads(block_rows(spark, sf_dir), thread="conv_id").select("conv_id", "seq", "reduce")


def thread_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("start", F.col("conv_id") % 4)
    told = lambda left, kept: F.concat_ws(" of ", left.cast("string"), kept.cast("string"))
    found = reduction.tail(block_rows(spark, sf_dir), starts, thread="conv_id", seq="seq", notice=told)
    return found.select("conv_id", "place", "seq", "role", F.sha2("text", 256).alias("sha"))


def recall_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two lines, the label twice in front; results in the first messages of even conversations still stand in the context."""
    rows = block_rows(spark, sf_dir)
    kept = rows.where("type = 'tool_result' and conv_id % 2 = 0 and seq < 200000").select("conv_id", "call_id", "text")
    found = reduction.recall_chunks(rows, kept, thread="conv_id", size=2, weight=2)
    return found.select("conv_id", "turn", "call", "chunk", "seq", F.sha2(F.array_join("lines", "|"), 256).alias("sha"), F.size("terms").cast("long").alias("n_terms"))


def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reduction.source_chunks(block_rows(spark, sf_dir), thread="conv_id", origin=F.lit("earlier"), users=True, size=1000)
    return found.groupBy("conv_id", "origin", "call").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("lines")).alias("n_lines"), F.sum(F.size("terms")).alias("n_terms")).where("call in ('you', 'agent')")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings whose length is divisible by three count as interrupted requests."""
    first = split(spark, sf_dir).where("turn_no > 0").groupBy("conv_id", F.col("turn_no").alias("turn")).agg(F.min_by("text", "turn").alias("text"), F.count(F.lit(1)).alias("messages"))
    marked = F.when(F.length("text") % 3 == 0, reduction.REQUEST_INTERRUPTED).otherwise("")
    return reduction.settled(first, thread="conv_id", opening=marked).withColumn("key", F.concat_ws("-", "conv_id", "turn"))


KEYS_SQL = f"""{SPLIT_SQL},
    o AS (SELECT conv_id, turn_no AS turn, arg_min(text, turn) AS text, count(*) AS messages FROM s WHERE turn_no > 0 GROUP BY ALL),
    k AS (SELECT conv_id, turn, messages, max(CASE WHEN length(text) % 3 <> 0 OR turn <= 2 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS settled FROM o)"""


def settled_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("conv_id", "turn", "settled")


def resolved_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the conversations saved their second turn, a third a turn that is gone, a third nothing."""
    keys = _keys(spark, sf_dir)
    saved = keys.select("conv_id").distinct().where("conv_id % 3 < 2").select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.concat_ws("-", "conv_id", F.lit(2))).otherwise("gone").alias("key"))
    return reduction.resolved_cuts(keys, saved, thread="conv_id", forced_keep=1)


def cut_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir).withColumn("pinned", (F.col("conv_id") + F.col("turn")) % 5 == 0)
    state = keys.groupBy("conv_id").agg((F.max("turn") - 1).alias("cut")).withColumn("keep", F.col("conv_id") % 3)
    return reduction.cut_notes(keys, state, thread="conv_id")


def results_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("start", F.col("conv_id") % 3 * 100_000)
    return reduction.open_results(block_rows(spark, sf_dir), starts, thread="conv_id")


def request_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    bounds = rows.select("conv_id").distinct().select("conv_id", F.lit(1).alias("head_end"), (F.col("conv_id") % 4 + 1).alias("live_from"))
    return reduction.request_sizes(rows, bounds, thread="conv_id", seq="turn", size=F.length("text"))


def call_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_rows(spark, sf_dir).where("role = 'assistant'").withColumn("is_call", F.col("type") == "tool_use")
    found = transcripts.narrated(rows, thread="conv_id", seq=["seq"])
    return found.select("conv_id", "seq", "call_no", F.sha2("say", 256).alias("say"), "final")


def session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of each conversation, with every second one launching a side run in turn 1 and one without a turn."""
    turns = _keys(spark, sf_dir).select("conv_id", F.col("turn").alias("number"), F.lit("t").alias("time"), F.concat(F.lit("ask "), "key").alias("prompt"), F.col("messages").alias("calls"), F.when(F.col("turn") % 2 == 0, "done").otherwise("").alias("final"))
    runs = turns.where("number = 1 and conv_id % 2 = 0").select("conv_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), F.lit(1).alias("k"), F.lit("look").alias("description"), F.lit(3).alias("calls"), F.lit("found").alias("final"))
    return render.index(turns, "conv_id", records=runs).select("conv_id", F.sha2("content", 256).alias("sha"))


def ask_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.sha2(transcripts.ask_line(F.col("text")), 256).alias("sha"))


QUERIES = {
    f.__name__: f
    for f in (reduced_turns, trimmed_threads, thread_tails, recall_chunks, source_chunks, settled_cuts, resolved_cuts, cut_notes, results_left, request_sizes, call_narration, session_index, ask_lines)
}
WS = "'^\\s+|\\s+$', '', 'g'"
ORACLE_SQL = {
    "reduced_turns": f"""
        WITH {BLOCKS_SQL},
        m AS (SELECT *, min(seq) FILTER (role = 'assistant') OVER w AS reply, max(seq) FILTER (role <> 'system') OVER w AS last, row_number() OVER (PARTITION BY conv_id, turn, role, type, text ORDER BY seq) AS copy,
                     regexp_replace(coalesce(text, ''), {WS}) AS t FROM b WHERE turn > 0 WINDOW w AS (PARTITION BY conv_id, turn)),
        e AS (SELECT conv_id, turn, bool_or(seq = last AND role = 'assistant' AND type = 'text' AND t <> '') AS whole, arg_max(t, seq) FILTER (role = 'assistant' AND type = 'text' AND t <> '') AS words,
                     list(label ORDER BY seq) FILTER (type = 'tool_use') AS labels FROM m GROUP BY ALL),
        x AS (SELECT m.*, CASE WHEN role = 'user' AND (reply IS NULL OR seq < reply) THEN 0 WHEN role = 'user' AND type = 'text' AND t <> '' AND text <> '{LATE}' THEN 1
                               WHEN role = 'system' AND t <> '' AND copy = 1 THEN 3 WHEN seq = last AND whole THEN 4 END AS part FROM m JOIN e USING (conv_id, turn))
        SELECT conv_id, turn, part::INT AS part, seq, role, type, sha256(text) AS sha FROM x WHERE part IS NOT NULL
        UNION ALL SELECT conv_id, turn, 4, -1, 'assistant', 'text', sha256(concat_ws(chr(10), '[This turn was interrupted before a final reply.]', 'Last thing you said: ' || CASE WHEN length(words) > 600 THEN left(words, 600) || '…' ELSE words END,
            'Tool calls (' || len(labels) || CASE WHEN len(labels) > 20 THEN ', last 20 shown' ELSE '' END || '): ' || array_to_string(labels[-20:], '; '), 'Their output is in the full transcript.')) FROM e WHERE NOT whole""",
    "trimmed_threads": f"WITH {BLOCKS_SQL} SELECT conv_id, seq, turn > 0 AND turn < max(turn) OVER (PARTITION BY conv_id) AS reduce FROM b",
    "thread_tails": f"""
        WITH {BLOCKS_SQL}, f AS (SELECT *, min(seq) FILTER (turn > 0) OVER w AS first, max(turn) OVER w AS n, conv_id % 4 AS start FROM b WINDOW w AS (PARTITION BY conv_id))
        SELECT conv_id, CASE WHEN start <= 1 OR n = 0 OR turn = 0 OR seq = first THEN 0 ELSE 2 END::INT AS place, seq, role, sha256(text) AS sha FROM f WHERE start <= 1 OR n = 0 OR turn = 0 OR seq = first OR turn > start
        UNION ALL SELECT conv_id, 1, seq, 'user', sha256((start - 1) || ' of ' || (n - start)) FROM f WHERE start > 1 AND seq = first""",
    "recall_chunks": f"""
        WITH {BLOCKS_SQL}, v AS (SELECT *, min(seq) OVER w AS a, max(seq) OVER w AS z FROM b WHERE turn > 0 AND turn < (SELECT max(turn) FROM b y WHERE y.conv_id = b.conv_id) WINDOW w AS (PARTITION BY conv_id, turn)),
        pr AS (SELECT c.conv_id, c.turn, c.label AS call, 0 AS chunk, c.seq, r.text FROM v c JOIN v r ON c.conv_id = r.conv_id AND c.turn = r.turn AND c.call_id = r.call_id AND c.type = 'tool_use' AND r.type = 'tool_result'
              WHERE trim(r.text) <> '' AND NOT (c.conv_id % 2 = 0 AND r.seq < 200000)),
        nr AS (SELECT conv_id, turn, seq, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY seq) - 1 AS n FROM v WHERE role = 'assistant' AND type = 'text' AND trim(text) <> '' AND seq > a AND seq < z),
        g AS (SELECT conv_id, turn, 'agent' AS call, (n // 2)::INT AS chunk, min(seq) AS seq, list(regexp_replace(text, {WS}) ORDER BY n) AS lines FROM nr GROUP BY ALL)
        SELECT conv_id, turn, call, chunk, seq, sha256(text) AS sha, 2 * len({terms_sql("call")}) + len({terms_sql("text")}) AS n_terms FROM pr
        UNION ALL SELECT conv_id, turn, call, chunk, seq, sha256(array_to_string(lines, '|')), len({terms_sql("array_to_string(lines, chr(10))")}) FROM g""",
    "source_chunks": f"""
        WITH {BLOCKS_SQL}, v AS (SELECT *, min(seq) OVER w AS a, max(seq) OVER w AS z FROM b WHERE turn > 0 WINDOW w AS (PARTITION BY conv_id, turn)),
        g AS (SELECT conv_id, 'agent' AS call, list(regexp_replace(text, {WS}) ORDER BY seq) AS lines FROM v WHERE role = 'assistant' AND type = 'text' AND trim(text) <> '' AND seq > a AND seq < z GROUP BY conv_id, turn
              UNION ALL SELECT conv_id, 'you', [regexp_replace(text, {WS})] FROM v WHERE seq = a AND trim(text) <> '')
        SELECT conv_id, 'earlier' AS origin, call, count(*) AS n, sum(len(lines))::BIGINT AS n_lines, sum(len({terms_sql("array_to_string(lines, chr(10))")}))::BIGINT AS n_terms FROM g GROUP BY ALL""",
    "settled_cuts": f"WITH {KEYS_SQL} SELECT conv_id, turn, settled FROM k",
    "resolved_cuts": f"""
        WITH {KEYS_SQL}, c AS (SELECT conv_id, max(turn) AS n, CASE WHEN conv_id % 3 = 0 AND max(turn) >= 2 THEN 1 ELSE -1 END AS cut, conv_id % 3 = 1 OR (conv_id % 3 = 0 AND max(turn) < 2) AS reset FROM k GROUP BY conv_id)
        SELECT c.conv_id, CASE WHEN cut <= 0 AND n >= 3 THEN settled - 1 ELSE cut END::INT AS cut, reset, cut <= 0 AND n >= 3 AS forced FROM c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = greatest(2, n - 1)""",
    "cut_notes": f"""
        WITH {KEYS_SQL}, j AS (SELECT *, (conv_id + turn) % 5 = 0 AS pin, turn - 1 AS i, max(turn) OVER (PARTITION BY conv_id) - 1 AS cut, conv_id % 3 AS keep FROM k),
        h AS (SELECT *, CASE WHEN cut > 0 THEN greatest(1, cut - keep) ELSE 0 END AS f FROM j)
        SELECT conv_id, CASE WHEN max(cut) > 0 THEN 'compact' ELSE 'full' END AS action, count(*) FILTER (cut > 0 AND NOT pin AND i >= 1 AND i < f) AS omitted,
               count(*) FILTER (cut > 0 AND NOT pin AND ((i >= f AND i < cut) OR (i = 0 AND f = 1 AND messages > 1))) AS folded, count(*) FILTER (i < cut AND pin) AS pinned FROM h GROUP BY conv_id""",
    "results_left": f"WITH {BLOCKS_SQL} SELECT conv_id, count(*) FILTER (type = 'tool_result' AND role = 'user' AND seq >= conv_id % 3 * 100000) AS n FROM b GROUP BY 1",
    "request_sizes": """
        SELECT conv_id, coalesce(sum(length(text)) FILTER (turn < 1), 0)::BIGINT AS head, coalesce(sum(length(text)) FILTER (turn >= 1 AND turn < conv_id % 4 + 1), 0)::BIGINT AS folded,
               coalesce(sum(length(text)) FILTER (turn >= conv_id % 4 + 1), 0)::BIGINT AS live FROM conversations GROUP BY 1""",
    "call_narration": f"""
        WITH {BLOCKS_SQL}, a AS (SELECT *, type = 'tool_use' AS is_call, CASE WHEN type = 'text' AND trim(text) <> '' THEN regexp_replace(text, {WS}) END AS w, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS n FROM b WHERE role = 'assistant'),
        y AS (SELECT *, max(n) FILTER (w IS NOT NULL) OVER bef AS wn, max(n) FILTER (is_call) OVER bef AS cn, max(n) FILTER (w IS NOT NULL) OVER per AS lw, max(n) FILTER (is_call) OVER per AS lc,
                     sum(is_call::INT) OVER (PARTITION BY conv_id, turn ORDER BY seq)::BIGINT AS call_no
              FROM a WINDOW bef AS (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), per AS (PARTITION BY conv_id, turn))
        SELECT y.conv_id, y.seq, CASE WHEN y.is_call THEN y.call_no END AS call_no, CASE WHEN y.is_call AND y.wn > coalesce(y.cn, 0) THEN sha256(p.w) END AS say, coalesce(y.lw = y.n AND y.n > coalesce(y.lc, 0), false) AS final
        FROM y LEFT JOIN a p ON p.conv_id = y.conv_id AND p.n = y.wn""",
    "session_index": f"""
        WITH {KEYS_SQL}, l AS (SELECT conv_id, turn AS a, 0 AS kk, '- **turn-' || lpad(turn::VARCHAR, 4, '0') || '.md** (t, ' || messages || ' calls): ask ' || conv_id || '-' || turn || ' → ' || CASE WHEN turn % 2 = 0 THEN 'done' ELSE '_(no final reply)_' END AS line FROM k
             UNION ALL SELECT conv_id, 1, 1, '  - **turn-0001-subagent-1.md**: subagent "look" (3 calls) → found' FROM k WHERE turn = 1 AND conv_id % 2 = 0
             UNION ALL SELECT conv_id, 1000000, 1, '  - **turn-0000-subagent-1.md**: subagent "look" (3 calls) → found' FROM k WHERE turn = 1 AND conv_id % 2 = 0)
        SELECT conv_id, sha256('# Session index' || chr(10) || chr(10) || 'One line per turn: what the user asked → how the turn ended. Open turn-NNNN.md for everything that happened in it.' ||
               CASE WHEN max(kk) > 0 THEN ' Indented lines are subagents the agent launched in that turn; turn-NNNN-subagent-K.md holds the subagent''s whole run, which the turn itself only has the report of.' ELSE '' END ||
               chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY a, kk) || chr(10)) AS sha FROM l GROUP BY conv_id""",
    "ask_lines": """
        WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user'),
        h AS (SELECT *, left(t, 80) AS h, CASE WHEN contains(left(t, 80), ' ') THEN 80 - strpos(reverse(left(t, 80)), ' ') ELSE -1 END AS space FROM t)
        SELECT conv_id, turn, sha256(CASE WHEN length(t) <= 80 THEN t ELSE left(h, greatest(space, 40)) || '…' END) AS sha FROM h""",
}
