"""Usage reports, session lists and hand-offs over the driver's tables (stand-in columns), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.functions import text as T
from talkloom.operators import fold, handoffs, reports, usage
from talkloom.plans.catalogue import _catalogue, ASKS_SQL
from talkloom.plans.common import table
from talkloom.plans.conversations import FOLDED_TURNS_SQL, split, SPLIT_SQL
from talkloom.plans.logs import _log, LOG_SQL, OFFSET_SQL

PRICES = [(0, "alpha-1", 30.0, 150.0, 3.0), (1, "alpha", 10.0, 50.0, 1.0)]


def _report(spark: SparkSession, sf_dir: str, unit: str, count: int) -> DataFrame:
    """Events as request log and, three of four, as usage lines some minutes later; the newest event is now."""
    events = table(spark, sf_dir, "events")
    at, k, size = F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id"), F.floor(F.col("value") * 1000).cast("long")
    entries = events.where(k % 4 != 0).select(
        k.alias("usage_id"), (at + k % 5 * 60_000).alias("at"), F.when(k % 9 == 0, "other").otherwise(F.concat(F.lit("alpha-"), F.col("user_id") % 3)).alias("model"), (size % 3).alias("input"),
        (size % 50).alias("output"), (size % 5).alias("cache_write_5m"), F.lit(0).cast("long").alias("cache_write_1h"), (size % 7).alias("cache_read"), (k % 17 == 0).alias("fast"),
    )
    log = _log(spark, sf_dir).join(events.select(k.alias("seq"), at.alias("at")), "seq")
    now = events.agg(F.max(at)).first()[0] or 0
    prices = spark.createDataFrame(PRICES, "pos int, prefix string, p_input double, p_output double, p_read double")
    rows = reports.usage_report(entries, log, prices, now=now, unit=unit, count=count)
    return rows.withColumns({c: F.round(c, 8) for c in reports.AMOUNTS} | {"left_out": reports.left_out()})


def usage_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "day", 7)


def usage_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "week", 8)


def _fixed_sql(x: str, places: int) -> str:
    return f"printf('%.{places}f', CASE WHEN ({x}) * {2.0 ** (places + 1)} % 2 = 1 THEN (floor(({x}) * {10**places}) + 1) / {10**places}::DOUBLE ELSE ({x})::DOUBLE END)"


def _tokens_sql(n: str) -> str:
    cases = []
    for size, unit in (("1e12", "T"), ("1e9", "B"), ("1e6", "M"), ("1e3", "k")):
        x = f"(({n})::DOUBLE / {size}::DOUBLE)"
        cases.append(f"WHEN {x} > 0.95 THEN CASE WHEN {x} < 10 THEN {_fixed_sql(x, 1)} ELSE floor({x} + 0.5)::BIGINT::VARCHAR END || '{unit}'")
    return f"CASE {' '.join(cases)} ELSE floor(({n})::DOUBLE + 0.5)::BIGINT::VARCHAR END"


def _dollars_sql(x: str) -> str:
    return f"('$' || CASE WHEN {x} >= 100 THEN format('{{:,}}', floor({x} + 0.5)::BIGINT) ELSE {_fixed_sql(x, 2)} END)"


def _report_sql(unit: str, days: int, count: int) -> str:
    zero = "{'o': 0.0::DOUBLE, 'hs': []::BIGINT[], 'p': 0.0::DOUBLE, 'f': 0.0::DOUBLE, 's': 0::BIGINT}"
    sums = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in reports.COUNTS) + ", " + ", ".join(f"coalesce(sum({c}), 0.0::DOUBLE) AS {c}" for c in reports.AMOUNTS)
    return f"""
        WITH {LOG_SQL},
        xs AS (SELECT thread, list({{'o': 0.0::DOUBLE, 'hs': []::BIGINT[], 'p': plain::DOUBLE, 'f': coalesce(fixed, 0)::DOUBLE, 's': seq}} ORDER BY seq) AS xs FROM rec WHERE plain IS NOT NULL GROUP BY thread),
        hits AS (SELECT unnest(list_reduce(xs, lambda acc, x: CASE WHEN x.p - acc.o > 0.92::DOUBLE * 100000 THEN {{'o': x.p - x.f - 8333.0::DOUBLE, 'hs': list_append(acc.hs, x.s), 'p': 0.0::DOUBLE, 'f': 0.0::DOUBLE, 's': 0::BIGINT}} ELSE acc END, {zero}).hs) AS seq FROM xs),
        cal AS (SELECT date_trunc('{unit}', max(ts))::DATE AS last, (date_trunc('{unit}', max(ts)) - INTERVAL {days * (count - 1)} DAY)::DATE AS first FROM events),
        lg AS (SELECT r.*, epoch_us(e.ts) // 1000 AS "at", date_trunc('{unit}', e.ts)::DATE AS bucket FROM rec r JOIN events e ON e.event_id = r.seq, cal WHERE date_trunc('{unit}', e.ts)::DATE >= first),
        u0 AS (SELECT event_id AS usage_id, epoch_us(ts) // 1000 + event_id % 5 * 60000 AS "at", CASE WHEN event_id % 9 = 0 THEN 'other' ELSE 'alpha-' || (user_id % 3) END AS model, sz % 3 AS input, sz % 50 AS output,
                      sz % 5 AS w, sz % 7 AS r, CASE WHEN event_id % 17 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM e0 WHERE event_id % 4 <> 0),
        u1 AS (SELECT *, least(date_trunc('{unit}', make_timestamp("at" * 1000))::DATE, (SELECT last FROM cal)) AS bucket, CASE WHEN model = 'alpha-1' THEN 3.0::DOUBLE WHEN model LIKE 'alpha-%' THEN 1.0::DOUBLE END AS p FROM u0),
        u AS (SELECT *, (input * p * 10 + output * p * 50 + r * p + w * p * 10 * 1.25::DOUBLE) / 1e6::DOUBLE * scale AS dollars, p * scale / 1e6::DOUBLE AS rr, p * 10 * CASE WHEN w > 0 THEN 1.25::DOUBLE ELSE 2.0::DOUBLE END * scale / 1e6::DOUBLE AS ww
              FROM u1 WHERE bucket >= (SELECT first FROM cal)),
        m AS (SELECT l.seq, u.usage_id FROM lg l JOIN u ON u.r = l.cr AND u.w = l.cw AND u.input = l.un AND abs(u."at" - l."at") <= 600000 WHERE l.input > 0
              QUALIFY row_number() OVER (PARTITION BY l.seq ORDER BY abs(u."at" - l."at"), u.usage_id) = 1),
        j AS (SELECT l.bucket, l.plain - l.input AS kept, u.usage_id, l.compacted, u.dollars AS actual, (l.plain - l.input) * u.rr - CASE WHEN l.compacted THEN l.cw * (u.ww - u.rr) ELSE 0 END AS saved,
                     l.seq IN (SELECT seq FROM hits) AS hit FROM lg l LEFT JOIN m USING (seq) LEFT JOIN u USING (usage_id) WHERE l.input > 0),
        parts AS (
            SELECT unnest(generate_series(first::TIMESTAMP, last::TIMESTAMP, INTERVAL {days} DAY))::DATE AS bucket, 0 AS requests, 0 AS input, 0 AS output, 0 AS cache_write, 0 AS cache_read, 0 AS unpriced, 0 AS handled, 0 AS priced, 0 AS unsized,
                   0 AS unmatched, 0 AS folds, 0 AS not_sent, 0 AS avoided, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS actual, 0.0::DOUBLE AS saved FROM cal
            UNION ALL SELECT bucket, 1, input, output, w, r, (dollars IS NULL)::INT, 0, 0, 0, 0, 0, 0, 0, coalesce(dollars, 0), 0, 0 FROM u
            UNION ALL SELECT bucket, 0, 0, 0, 0, 0, 0, 1, (saved IS NOT NULL AND actual IS NOT NULL)::INT, (kept IS NULL)::INT, (kept IS NOT NULL AND usage_id IS NULL)::INT, compacted::INT, coalesce(kept, 0), hit::INT,
                             0, CASE WHEN saved IS NOT NULL THEN coalesce(actual, 0) ELSE 0 END, CASE WHEN actual IS NOT NULL THEN coalesce(saved, 0) ELSE 0 END FROM j),
        t AS (SELECT coalesce(bucket::VARCHAR, 'Total') AS label, {sums} FROM parts GROUP BY ROLLUP (bucket))
        SELECT label, {", ".join(reports.COUNTS)}, {", ".join(f"round({c}, 8) AS {c}" for c in reports.AMOUNTS)},
               CASE WHEN requests = 0 THEN '' ELSE {_dollars_sql("cost")} || CASE WHEN unpriced > 0 THEN '*' ELSE '' END END AS cost_cell,
               CASE WHEN handled = 0 THEN '–' ELSE format('{{:,}}', avoided) END AS avoided_cell,
               CASE WHEN handled = 0 THEN '–' WHEN not_sent <= 0 THEN '±0' ELSE {_tokens_sql("not_sent")} || ' ' || folds || CASE WHEN folds = 1 THEN ' fold' ELSE ' folds' END END AS not_sent_cell,
               CASE WHEN priced = 0 THEN '–' WHEN abs(saved) < 0.005 THEN '±0' ELSE CASE WHEN saved < 0 THEN '−' ELSE '' END || {_dollars_sql("abs(saved)")} || ' ' || floor(saved / (actual + saved) * 100 + 0.5)::BIGINT || '%' END AS saved_cell,
               CASE WHEN unmatched > 0 AND handled > priced + unsized + unmatched THEN format('{{:,}}', unmatched) || ' aren''t in session files and ' || (handled - priced - unsized - unmatched) || ' to models without a price'
                    WHEN unmatched > 0 THEN format('{{:,}}', unmatched) || ' aren''t in session files' WHEN handled > priced + unsized + unmatched THEN (handled - priced - unsized - unmatched) || ' to models without a price' ELSE '' END AS left_out
        FROM t"""


def longest_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five users whose events, as a request log, would have carried most."""
    return reports.longest(usage.thread_peaks(_log(spark, sf_dir)))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split(spark, sf_dir).select("conv_id", F.col("turn").alias("seq"), F.col("turn_no").alias("turn"), "role", "text")
    return fold.folded_turns(rows, thread="conv_id", seq="seq", role="role", text="text")


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a list shows them, a third without a label; the folded view is capped at 1,500 characters, mtime counts hours."""
    views = handoffs.session_views(_folded(spark, sf_dir), session="conv_id", cap=1500).select(F.col("conv_id").alias("id"), "chars")
    label = F.when(F.col("id") % 3 > 0, F.substring(F.col("asks")[0], 1, 12))
    hours = F.col("mtime") * F.col("mtime") * 36_000
    rows = reports.session_lines(_catalogue(spark, sf_dir).withColumns({"label": label, "mtime": hours}), views, now=F.lit(101 * 101 * 36_000))
    return rows


def loaded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, size and content of each session's folded view as a file."""
    views = handoffs.session_views(_folded(spark, sf_dir), session="conv_id", cap=1500)
    files = handoffs.loaded_files(views, session="conv_id")
    return files.join(views.select(F.concat(F.col("conv_id").cast("string"), F.lit(".md")).alias("file"), "chars", "lines"), "file").select("file", "chars", "lines", F.sha2("content", 256).alias("sha"))


def several_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every conversation the views of one to three others under 2,000 characters together."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    chosen = ids.select(F.col("conv_id").alias("asker"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("conv_id") % 3)).alias("place"))
    chosen = chosen.withColumn("conv_id", F.floor(F.col("asker") / 2) + F.col("place")).withColumn("title", F.concat(F.lit("talk "), "conv_id"))
    made = handoffs.several_views(chosen, _folded(spark, sf_dir), query="asker", session="conv_id", cap=2000)
    return made.select("asker", "chars", "lines", F.sha2("text", 256).alias("sha"))


def new_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user message asks to continue another conversation by the first characters of its hashed id; a part is known already."""
    rows = table(spark, sf_dir, "conversations")
    name = lambda c: F.concat(F.lit("s-"), F.substring(F.sha2(c.cast("string"), 256), 1, 12))
    said = rows.where("role = 'user'").withColumn("to", F.floor(F.col("conv_id") / 2) + F.col("turn") % 5)
    mark = F.concat(F.lit("go on {continue:"), F.substring(name(F.col("to")), F.lit(1), (F.lit(8) + F.col("turn") % 6).cast("int")), F.lit("}"))
    prompts = said.select(name(F.col("conv_id")).alias("thread"), F.col("turn").alias("seq"), F.concat_ws(":", "conv_id", "turn").alias("key"), F.when(F.col("turn") % 7 < 6, mark).otherwise("go on").alias("text"))
    known = said.where("(conv_id + turn) % 4 = 0").select(name(F.col("conv_id")).alias("thread"), F.concat_ws(":", "conv_id", "turn").alias("key"), F.when(F.col("turn") % 2 == 0, name(F.col("to"))).alias("source"))
    found = rows.where("conv_id % 6 > 0").select(name(F.col("conv_id")).alias("id"), F.concat(F.lit("talk "), "conv_id").alias("label"))
    return handoffs.new_handoffs(prompts, known, found, thread="thread", seq="seq", key="key", text="text")


def agent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shell calls, some of which load or look up a session by the program `keep`."""
    k = F.col("event_id")
    command = F.when(k % 4 == 0, F.concat(F.lit("cd x; keep load s"), F.col("user_id"))).when(k % 4 == 1, F.concat(F.lit('keep  peek "s'), F.col("user_id"), F.lit('" word'))).when(k % 4 == 2, "upkeep load s1").otherwise("keep list")
    calls = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "Read").otherwise("Bash").alias("tool"), command.alias("command"))
    return handoffs.agent_calls(calls, program="keep", source=r"s\d+").select("event_id", "kind", "source")


def folds_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and pins that users name for conversations, over states some of them have."""
    first = split(spark, sf_dir).where("turn_no > 0").groupBy("conv_id", "turn_no").agg(F.min("turn").alias("t"))
    key = lambda c: F.concat_ws("-", "conv_id", c)
    thread = F.col("conv_id").cast("string").alias("thread")
    turns = first.select(thread, (F.col("turn_no") - 1).cast("int").alias("turn"), key("turn_no").alias("key"), F.array(key("t")).alias("prints"))
    ids = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("ts"))
    saved = ids.where("conv_id % 3 > 0").select(
        thread, key(F.lit(1)).alias("cut"), F.lit(0).alias("keep"), F.lit(2).alias("cleared"), F.lit(1).alias("stuck"), F.lit(False).alias("host"), F.array(key(F.lit(1))).alias("pins"),
        F.map_from_arrays(F.transform("ts", lambda t: F.concat_ws("-", "conv_id", t)), F.transform("ts", lambda t: F.concat(F.lit("r"), t))).alias("recalls"),
    )
    asks = ids.where("conv_id % 4 > 0").select(
        thread, F.when(F.col("conv_id") % 5 > 0, (F.col("conv_id") % 5 - 2).cast("int")).alias("at"), F.array((F.col("conv_id") % 2).cast("int")).alias("pin"), F.when(F.col("conv_id") % 7 == 0, F.array(F.lit(0))).alias("unpin"),
    )
    made = handoffs.folded_by_hand(saved, turns, asks)
    left = F.array_join(F.array_sort(F.map_keys("recalls")), ",")
    return made.select("thread", "cut", "keep", "cleared", "stuck", "host", F.array_join("pins", ",").alias("pins"), left.alias("recalls"), "error")


QUERIES = {f.__name__: f for f in (usage_days, usage_weeks, longest_threads, session_lines, loaded_sessions, several_views, new_handoffs, agent_calls, folds_by_hand)}

NL = "chr(10)"
_VIEW_SQL = f"string_agg(CASE WHEN is_full THEN whole ELSE short END, {NL} || {NL} ORDER BY turn)"
_VIEWS_SQL = f"""{FOLDED_TURNS_SQL}, y AS (SELECT *, sum(length(whole)) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 1500 AS is_full FROM x),
    views AS (SELECT conv_id, {_VIEW_SQL} AS text FROM y GROUP BY conv_id)"""
ORACLE_SQL = {
    "usage_days": _report_sql("day", 1, 7),
    "usage_weeks": _report_sql("week", 7, 8),
    "longest_threads": f"""
        {OFFSET_SQL}, p AS (SELECT thread, max(plain) AS plain, arg_max(input, plain * 1000000000 + seq) AS sent, arg_max(turns, seq) FILTER (turns IS NOT NULL) AS turns FROM rec WHERE plain IS NOT NULL GROUP BY thread)
        SELECT thread, thread AS session, plain, {_tokens_sql("plain")} || ' of history' AS history, CASE WHEN acc.h > 0 THEN acc.h || CASE WHEN acc.h = 1 THEN ' compaction avoided' ELSE ' compactions avoided' END ELSE 'no compaction needed' END AS avoided,
               'sent ' || {_tokens_sql("sent")} || CASE WHEN turns > 0 THEN ' · ' || turns || CASE WHEN turns = 1 THEN ' turn' ELSE ' turns' END ELSE '' END AS sent
        FROM p LEFT JOIN w USING (thread) ORDER BY plain DESC, thread LIMIT 5""",
    "session_lines": f"""
        WITH {_VIEWS_SQL}, {ASKS_SQL.strip()}, a AS (SELECT c.id, asks, floor((101 * 101 - mtime * mtime) * 36 + 0.5)::BIGINT AS sec, floor(coalesce(length(text), 0) / 3.6::DOUBLE + 0.5)::BIGINT AS n FROM c LEFT JOIN views ON conv_id = c.id)
        SELECT id, CASE WHEN id % 3 > 0 THEN left(asks[1], 12) ELSE left(id::VARCHAR, 8) END AS title, len(asks) || ' turns · ~' || {_tokens_sql("n")} || ' tokens · ' || CASE WHEN sec < 60 THEN 'just now' WHEN sec < 3600 THEN floor(sec / 60 + 0.5)::BIGINT || 'm ago'
               WHEN sec < 86400 THEN floor(sec / 3600 + 0.5)::BIGINT || 'h ago' ELSE floor(sec / 86400 + 0.5)::BIGINT || 'd ago' END AS meta FROM a""",
    "loaded_sessions": f"WITH {_VIEWS_SQL} SELECT conv_id || '.md' AS file, length(text) AS chars, len(string_split(text, {NL})) AS lines, sha256(text) AS sha FROM views",
    "several_views": f"""
        WITH {FOLDED_TURNS_SQL}, ids AS (SELECT DISTINCT conv_id AS asker FROM conversations), ch AS (SELECT asker, unnest(generate_series(0, asker % 3)) AS place FROM ids),
        c AS (SELECT *, asker // 2 + place AS conv, 2000 // count(*) OVER (PARTITION BY asker) AS share FROM ch),
        y AS (SELECT asker, place, turn, whole, short, sum(length(whole)) OVER (PARTITION BY asker, place ORDER BY turn DESC) <= share AS is_full FROM c JOIN x ON conv_id = conv),
        z AS (SELECT asker, place, {_VIEW_SQL} AS text FROM y GROUP BY ALL),
        o AS (SELECT asker, string_agg('## Session: talk ' || conv || {NL} || {NL} || coalesce(text, ''), {NL} || {NL} ORDER BY place) AS text FROM c LEFT JOIN z USING (asker, place) GROUP BY asker)
        SELECT asker, length(text) AS chars, len(string_split(text, {NL})) AS lines, sha256(text) AS sha FROM o""",
    "new_handoffs": """
        WITH n AS (SELECT conv_id, 's-' || left(sha256(conv_id::VARCHAR), 12) AS name FROM (SELECT DISTINCT conv_id FROM conversations)),
        p AS (SELECT 's-' || left(sha256(conv_id::VARCHAR), 12) AS thread, turn AS seq, conv_id || ':' || turn AS key, 's-' || left(sha256((conv_id // 2 + turn % 5)::VARCHAR), 12) AS target, turn % 7 < 6 AS marked, (conv_id + turn) % 4 = 0 AS known FROM conversations WHERE role = 'user'),
        k AS (SELECT thread, key, CASE WHEN seq % 2 = 0 THEN target END AS source FROM p WHERE known),
        o AS (SELECT thread, seq, key, left(target, 8 + seq % 6) AS wanted FROM p WHERE marked AND NOT known),
        h AS (SELECT o.thread, o.key, min(name) AS id, min('talk ' || conv_id) AS label FROM o JOIN n ON starts_with(name, wanted) AND name <> thread AND conv_id % 6 > 0 GROUP BY o.thread, o.key HAVING count(*) = 1),
        r AS (SELECT o.*, id, label, id IS NOT NULL AND row_number() OVER (PARTITION BY thread, id ORDER BY seq, key) = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.thread = o.thread AND k.source = id) AS fresh FROM o LEFT JOIN h USING (thread, key))
        SELECT thread, key, wanted, CASE WHEN fresh THEN id END AS source, CASE WHEN fresh THEN label END AS label FROM r""",
    "agent_calls": """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'load' WHEN 1 THEN 'peek' ELSE 'other' END AS kind, CASE WHEN event_id % 4 < 2 THEN 's' || user_id END AS source FROM events WHERE event_type <> 'click' AND event_id % 4 <> 2""",
    "folds_by_hand": f"""
        WITH {SPLIT_SQL}, f AS (SELECT conv_id, turn_no - 1 AS i, min(turn) AS t FROM s WHERE turn_no > 0 GROUP BY ALL), c AS (SELECT conv_id, list(DISTINCT turn) AS ts FROM conversations GROUP BY conv_id),
        b AS (SELECT conv_id, ts, (SELECT count(*) FROM f WHERE f.conv_id = c.conv_id) AS n, conv_id % 3 > 0 AS has, conv_id % 4 > 0 AS asked FROM c),
        a AS (SELECT *, CASE WHEN conv_id % 5 > 0 THEN conv_id % 5 - 2 ELSE n - 1 END AS cut_at FROM b),
        e AS (SELECT *, CASE WHEN NOT asked THEN NULL WHEN n = 0 THEN 'no turn' WHEN cut_at >= 0 AND n <= 1 THEN 'one turn only' WHEN cut_at >= 0 AND (cut_at < 1 OR cut_at >= n) THEN 'no such turn'
                             WHEN conv_id % 2 >= n OR (conv_id % 7 = 0 AND 0 >= n) THEN 'no such turn to pin' END AS error FROM a),
        g AS (SELECT *, asked AND error IS NULL AS fine, asked AND error IS NULL AND cut_at >= 0 AS folds, coalesce((SELECT list(f.t) FROM f WHERE f.conv_id = e.conv_id AND f.i < e.cut_at), []) AS gone FROM e WHERE has OR asked),
        q AS (SELECT *, list_sort(list_filter(list_distinct(CASE WHEN has THEN [conv_id || '-1'] ELSE [] END || CASE WHEN fine THEN [conv_id || '-' || (conv_id % 2 + 1)] ELSE [] END), lambda x: NOT (fine AND conv_id % 7 = 0 AND x = conv_id || '-1'))) AS ps,
                     list_sort(list_transform(list_filter(ts, lambda t: NOT folds OR NOT list_contains(gone, t)), lambda t: conv_id || '-' || t)) AS rs FROM g)
        SELECT conv_id::VARCHAR AS thread, CASE WHEN folds THEN conv_id || '-' || (cut_at + 1) WHEN has THEN conv_id || '-1' END AS cut, CASE WHEN folds THEN cut_at - 1 WHEN has THEN 0 END AS keep, CASE WHEN has AND NOT folds THEN 2 END AS cleared, CASE WHEN has AND NOT folds THEN 1 END AS stuck,
               CASE WHEN folds THEN true WHEN has THEN false END AS host, CASE WHEN len(ps) > 0 THEN array_to_string(ps, ',') END AS pins, CASE WHEN has THEN array_to_string(rs, ',') END AS recalls, error FROM q""",
}
