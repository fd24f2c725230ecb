"""Usage reports, session catalogue, grades and choices over the driver's tables (stand-in columns), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.operators import evals, judging, retrieval, sessions, usage
from talkloom.plans.common import table


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage lines: some without message id or model, some synthetic, some placeholders."""
    e = table(spark, sf_dir, "events")
    at, k = F.col("ts").cast("timestamp"), F.col("event_id")
    return e.select(
        F.concat(F.lit("f"), F.col("user_id") % 10).alias("file"), k.alias("line"), F.unix_millis(at).alias("at"),
        F.when(k % 7 != 0, F.concat_ws("-", "user_id", F.date_format(at, "yyyyMMddHH"))).alias("message_id"), F.when(k % 5 != 0, F.col("event_type")).alias("request_id"),
        F.when(F.col("event_type") == "error", "<synthetic>").when(k % 13 != 0, F.concat(F.lit("alpha-"), F.col("user_id") % 3)).alias("model"),
        F.when(k % 3 == 0, "standard").alias("service_tier"), F.when(k % 11 == 0, 1000).otherwise(k % 500).cast("long").alias("input_tokens"), F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        (k % 5 * 10).alias("cache_creation_input_tokens"), (k % 4 * 100).alias("cache_read_input_tokens"), (k % 3 * 10).alias("ephemeral_1h_input_tokens"), F.when(k % 17 == 0, "fast").alias("speed"),
    )


USAGE_SQL = """
    l AS (SELECT 'f' || (user_id % 10) AS file, event_id AS line, epoch_us(ts) // 1000 AS "at", CASE WHEN event_id % 7 <> 0 THEN user_id || '-' || strftime(ts, '%Y%m%d%H') END AS message_id,
                 CASE WHEN event_id % 5 <> 0 THEN event_type END AS request_id, CASE WHEN event_type = 'error' THEN '<synthetic>' WHEN event_id % 13 <> 0 THEN 'alpha-' || (user_id % 3) END AS model,
                 event_id % 3 = 0 AS api, CASE WHEN event_id % 11 = 0 THEN 1000 ELSE event_id % 500 END AS input, floor(value * 10)::BIGINT AS output, event_id % 5 * 10 AS cc,
                 event_id % 4 * 100 AS cache_read, least(event_id % 5 * 10, event_id % 3 * 10) AS cache_write_1h, event_id % 17 = 0 AS fast FROM events),
    b AS (SELECT * FROM l WHERE model IS DISTINCT FROM '<synthetic>'
          QUALIFY row_number() OVER (PARTITION BY coalesce(message_id || ':' || coalesce(request_id, ''), file || ':' || line) ORDER BY api DESC, output DESC, cc DESC, file, line) = 1),
    u AS (SELECT "at", coalesce(model, 'unknown') AS model, input, output, cc - cache_write_1h AS cache_write_5m, cache_write_1h, cache_read, fast FROM b WHERE NOT (NOT api AND input = 1000 AND cache_read = 0 AND cc = 0)),
    d AS (SELECT *, (input * pi + output * po + cache_read * pr + cache_write_5m * pi * 1.25::DOUBLE + cache_write_1h * pi * 2.0::DOUBLE) / 1e6::DOUBLE * CASE WHEN fast THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS dollars
          FROM (SELECT *, CASE WHEN model = 'alpha-1' THEN 3.0::DOUBLE WHEN model LIKE 'alpha-%' THEN 1.0::DOUBLE END AS pi, CASE WHEN model = 'alpha-1' THEN 15.0::DOUBLE WHEN model LIKE 'alpha-%' THEN 5.0::DOUBLE END AS po,
                       CASE WHEN model = 'alpha-1' THEN 0.3::DOUBLE WHEN model LIKE 'alpha-%' THEN 0.1::DOUBLE END AS pr FROM u))"""
SUMS_SQL = """count(*) AS requests, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_write_5m + cache_write_1h)::BIGINT AS cache_write, sum(cache_read)::BIGINT AS cache_read,
    round(coalesce(sum(dollars), 0), 9) AS cost, count(*) FILTER (dollars IS NULL) AS unpriced"""


def usage_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.deduplicated_usage(usage_rows(spark, sf_dir))


def _dollars(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([(0, "alpha-1", 3.0, 15.0, 0.3), (1, "alpha", 1.0, 5.0, 0.1)], "pos int, prefix string, p_input double, p_output double, p_read double")
    return usage.priced(usage_dedupe(spark, sf_dir), prices, name="model").withColumn("dollars", usage.cost())


def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_model(_dollars(spark, sf_dir)).withColumns({"cost": F.round("cost", 9), "share": F.round("share", 6)})


def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd").alias("day")
    return usage.summarize(_dollars(spark, sf_dir), day).withColumn("cost", F.round("cost", 9))


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summarize(_dollars(spark, sf_dir)).withColumn("cost", F.round("cost", 9))


def cache_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean dollars per million cached tokens read and written, and the cache hit rate, of each model."""
    read, write = usage.rates()
    rows = _dollars(spark, sf_dir).withColumns({"r": read * 1e6, "w": write * 1e6})
    hit = usage.hit_rate(F.sum("cache_read"), F.sum(F.col("cache_write_5m") + F.col("cache_write_1h")), F.sum("input"))
    return rows.groupBy("model").agg(F.round(F.avg("r"), 6).alias("read"), F.round(F.avg("w"), 6).alias("write"), F.round(hit, 9).alias("hit_rate"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role = 'user'").withColumnRenamed("conv_id", "id")
    made = sessions.outlines(said, session="id", turn="turn", prompt="text")
    return made.withColumns({"mtime": F.col("id") * 37 % 101, "cwd": F.concat(F.lit("/w"), F.col("id") % 4)})


ASKS_SQL = """
    t AS (SELECT conv_id AS id, turn, trim(text, ' ') AS t FROM conversations WHERE role = 'user' AND trim(text, ' ') <> ''),
    c AS (SELECT id, list(left(t, 240) ORDER BY turn) AS asks, id * 37 % 101 AS mtime, '/w' || (id % 4) AS cwd FROM t GROUP BY id)"""


def session_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir).select("id", F.size("asks").cast("long").alias("n_asks"), F.sha2("outline", 256).alias("sha"))


def session_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.candidates(_catalogue(spark, sf_dir), owner=F.col("cwd") != "/w3").select("cwd", "id", "place")


def session_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sessions whose prompts begin alike (first eight characters of the first two) the oldest."""
    short = _catalogue(spark, sf_dir).withColumn("asks", F.transform("asks", lambda a: F.substring(a, 1, 8)))
    return sessions.without_copies(short).select("id", "mtime")


def session_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recency(_catalogue(spark, sf_dir), query_id="cwd", item="id", at="mtime").where("rank <= 5").select("cwd", "id", "rank")


def unrouted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last purchase came after their last click, or who never clicked."""
    e = table(spark, sf_dir, "events")
    last = lambda kind, name: e.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("session_id")).agg(F.max("event_id").alias(name))
    return sessions.unrouted(last("purchase", "started_at"), last("click", "last_seen")).select("session_id", "started_at")


def session_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' dearest urgent order as a setting over their balance."""
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("most"))
    own = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"))
    return sessions.with_settings(base, own, key="c_custkey", names=["most"])


def recent_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recent_sessions(table(spark, sf_dir, "events"), session="user_id", at="event_id", keep=50)


def saved_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with what was recalled for them (a third has something, a third nothing, a third was not asked) and what is still to be asked."""
    prompts = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "conv_id", F.array("text").alias("blocks"))
    saved = prompts.where("conv_id % 3 < 2").select("key", F.when(F.col("conv_id") % 3 == 0, "recalled").otherwise("").alias("text"))
    open_ = sessions.missing_recalls(prompts, saved, key="key").select("key", F.lit(True).alias("missing"))
    out = sessions.with_recalls(prompts, saved, key="key", blocks="blocks").join(open_, "key", "left")
    return out.select("key", F.sha2(F.array_join("blocks", "|"), 256).alias("sha"), F.coalesce("missing", F.lit(False)).alias("missing"))


def session_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "conv_id", F.array("text").alias("blocks"))
    given = prompts.where("conv_id % 5 < 2").select("key", F.concat(F.lit("s"), F.col("conv_id")).alias("label"), F.when(F.col("conv_id") % 5 == 0, "seen before").alias("text"))
    out = sessions.with_handoffs(prompts, given, key="key", blocks="blocks")
    return out.select("key", F.size("blocks").cast("long").alias("n"), F.sha2(F.array_join("blocks", "|"), 256).alias("sha"))


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("unit"), F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("question"), F.col("l_linestatus").alias("replicate"),
        (F.col("l_quantity").cast("long") % 3).alias("score"), "l_orderkey", (F.col("l_partkey") % 3 + 1).alias("place"),
        F.when(F.col("l_quantity") < 5, "wrong").when(F.col("l_quantity") < 25, "unknown").otherwise("correct").alias("label"),
    )


GRADES_SQL = """g AS (SELECT l_suppkey % 20 AS unit, l_returnflag AS arm, l_linenumber AS question, l_linestatus AS replicate, l_quantity::BIGINT % 3 AS score, l_orderkey, l_partkey % 3 + 1 AS place,
    CASE WHEN l_quantity < 5 THEN 'wrong' WHEN l_quantity < 25 THEN 'unknown' ELSE 'correct' END AS label FROM lineitem)"""


def grades_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.mean_grades(_grades(spark, sf_dir), unit="unit", arm="arm").withColumn("pct", F.round("pct", 6))


def labels_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.pooled_labels(_grades(spark, sf_dir), ["l_orderkey"])


def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judging.agreement(_grades(spark, sf_dir), ["l_orderkey"])
    return found.withColumns({"exact": F.round("exact", 6), "within_one": F.round("within_one", 6)})


def question_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.question_shapes(_grades(spark, sf_dir), ["l_orderkey", "arm"])


def arm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.arm_matrix(_grades(spark, sf_dir), unit="unit", arm="arm", value="score").withColumn("mean", F.round("mean", 6))


def tool_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls, clicks among them as shell commands."""
    command = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("cd x && rg "), F.col("props"))).when(F.col("event_id") % 3 == 1, "make all")
    calls = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "click", "Bash").otherwise(F.col("event_type")).alias("name"), command.alias("command"))
    return judging.lookups(calls, key="user_id")


def lookup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages whose first word stands in an assistant message of the conversation."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.lit("recent").alias("type"), F.split_part("text", F.lit(" "), F.lit(1)).alias("answer"))
    return judging.lookup_hits(asked, rows.where("role = 'assistant'").select("conv_id", "text"), unit="conv_id").select("conv_id", "turn")


def item_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("e"), F.collect_set(F.when(F.col("o_totalprice") > 150_000, F.col("o_orderpriority"))).alias("k"))
    return judging.retention(per, expected="e", kept="k").withColumn("share", F.round("share", 9))


def tuned_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", (F.col("l_orderkey") % 2).alias("half"), "l_quantity")
    best = judging.best_parameters(rows, parameters=["l_linenumber", "l_returnflag"], half_="half", value="l_quantity")
    return best.withColumns({"tuned": F.round("tuned", 6), "checked": F.round("checked", 6)})


def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", judging.half(F.col("props")).alias("half"))


def closest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("pos"))
    return judging.closest(options, "AFRIKAN", "name")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 10_000).alias("p"))


def probability_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.by_probability(_suppliers(spark, sf_dir), query="s_nationkey", place="s_suppkey", p="p").select("s_nationkey", "s_suppkey", "rank")


def picked_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order by probability with every third supplier in front, the last of them first."""
    ranked = probability_order(spark, sf_dir)
    picks = ranked.where("s_suppkey % 3 = 0").select("s_nationkey", "s_suppkey", (-F.col("s_suppkey")).alias("pick"))
    return judging.picked_first(ranked, picks, query="s_nationkey", item="s_suppkey").select("s_nationkey", "s_suppkey", "rank")


def best_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's best supplier with a positive balance, else its first."""
    pool = _suppliers(spark, sf_dir).withColumn("place", F.col("s_suppkey"))
    ranked = judging.by_probability(pool.where("p > 0.5"), query="s_nationkey", place="place", p="p")
    return judging.last_or(ranked, pool, query="s_nationkey", item="s_suppkey")


def vote_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged supplier (the smallest key) of each nation where it is among the two of highest balance, else the highest."""
    judged = _suppliers(spark, sf_dir).groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    return retrieval.vote_pick(probability_order(spark, sf_dir), judged, query_id="s_nationkey", item="s_suppkey")


def deferred_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("p"), F.col("event_type").alias("pick"), F.col("event_id").alias("message"))
    return judging.deferred(judged, query="user_id", least=40.0)


def sessions_to_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of two prompts and more whose outlines differ in the first 20 characters."""
    return sessions.discovered(_catalogue(spark, sf_dir), least=2, prefix=20).select("cwd", "id", "place")


def recent_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir).select("id", F.sha2(sessions.recent_outline(F.col("asks"), 2), 256).alias("sha"))


def pull_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs with their first line's supplier modulo 5 as source, lines as calls."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", (F.col("l_suppkey") % 5).alias("source"), F.when(F.col("l_returnflag") == "R", "load").when(F.col("l_returnflag") == "A", "peek").otherwise("list").alias("kind"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderpriority", (F.col("o_custkey") % 5).alias("source"))
    return sessions.pull_report(orders, lines, arm=["o_orderpriority"]).withColumn("commands", F.round("commands", 6))


QUERIES = {
    f.__name__: f
    for f in (usage_dedupe, usage_by_model, usage_by_day, usage_summary, cache_rates, session_outlines, session_candidates, session_copies, session_recency, unrouted_sessions, session_settings, recent_users, saved_recalls,
              session_handoffs, grades_mean, labels_pooled, judge_agreement, question_shapes, arm_matrix, tool_lookups, lookup_hits, item_retention, tuned_parameters, half_split, closest_name, probability_order,
              picked_first, best_or_first, vote_pick, deferred_pick, sessions_to_choose, recent_asks, pull_report)
}
RANK_SQL = "s AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal / 10000 END AS p FROM supplier), r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(p, 0) DESC, s_suppkey) AS rank FROM s)"
ORACLE_SQL = {
    "usage_dedupe": f"WITH {USAGE_SQL} SELECT * FROM u",
    "usage_by_model": f"""
        WITH {USAGE_SQL}, m AS (SELECT model, {SUMS_SQL}, coalesce(sum(dollars), 0) AS c FROM d GROUP BY model)
        SELECT * EXCLUDE c, round(CASE WHEN sum(c) OVER () > 0 AND unpriced = 0 THEN c / sum(c) OVER () END, 6) AS share, row_number() OVER (ORDER BY c DESC, requests DESC, model) AS place FROM m""",
    "usage_by_day": f"""WITH {USAGE_SQL} SELECT strftime(make_timestamp("at" * 1000), '%Y-%m-%d') AS day, {SUMS_SQL} FROM d GROUP BY 1""",
    "usage_summary": f"WITH {USAGE_SQL} SELECT {SUMS_SQL} FROM d",
    "cache_rates": f"""
        WITH {USAGE_SQL}, x AS (SELECT *, CASE WHEN fast THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS f, cache_write_5m + cache_write_1h AS w FROM d)
        SELECT model, round(avg(pr * f), 6) AS read, round(avg(pi * f * CASE WHEN w > 0 THEN (cache_write_5m * 1.25::DOUBLE + cache_write_1h * 2.0::DOUBLE) / w ELSE 2.0::DOUBLE END), 6) AS write,
               round(sum(cache_read)::DOUBLE / sum(cache_read + w + input)::DOUBLE, 9) AS hit_rate FROM x GROUP BY model""",
    "session_outlines": f"WITH {ASKS_SQL} SELECT id, len(asks)::BIGINT AS n_asks, sha256(array_to_string(list_transform(asks, lambda a, i: i || '. ' || a), chr(10))) AS sha FROM c",
    "session_candidates": f"WITH {ASKS_SQL} SELECT cwd, id, row_number() OVER (PARTITION BY cwd ORDER BY mtime DESC, id) AS place FROM c WHERE len(asks) >= 2 AND cwd <> '/w3' QUALIFY place <= 12",
    "session_copies": f"""
        WITH {ASKS_SQL} SELECT id, mtime FROM c QUALIFY row_number() OVER (PARTITION BY list_transform(asks[1:2], lambda a: left(a, 8)) ORDER BY mtime, id) = 1""",
    "session_recency": f"WITH {ASKS_SQL} SELECT cwd, id, row_number() OVER (PARTITION BY cwd ORDER BY mtime DESC, id) AS rank FROM c QUALIFY rank <= 5",
    "sessions_to_choose": f"""
        WITH {ASKS_SQL}, e AS (SELECT *, array_to_string(list_transform(asks, lambda a, i: i || '. ' || a), chr(10)) AS outline FROM c WHERE len(asks) >= 2),
        d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cwd, left(outline, 20) ORDER BY id) = 1)
        SELECT cwd, id, row_number() OVER (PARTITION BY cwd ORDER BY mtime DESC, id) AS place FROM d QUALIFY count(*) OVER (PARTITION BY cwd) >= 2""",
    "recent_asks": f"""
        WITH {ASKS_SQL} SELECT id, sha256(array_to_string(list_transform(asks[-2:], lambda a, i: (greatest(len(asks) - 2, 0) + i) || '. ' || a), chr(10))) AS sha FROM c""",
    "pull_report": """
        WITH p AS (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n, count(*) FILTER (l_returnflag IN ('R', 'A')) AS pulls, count(*) FILTER (l_returnflag = 'R') AS loads,
                          count(*) FILTER (l_returnflag IN ('R', 'A') AND l_suppkey % 5 = o_custkey % 5) AS fits FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
        SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (pulls > 0) AS pulled, count(*) FILTER (loads > 0) AS loaded, count(*) FILTER (pulls > 0 AND fits = pulls) AS right, round(avg(n), 6) AS commands FROM p GROUP BY 1""",
    "unrouted_sessions": """
        SELECT user_id AS session_id, max(event_id) FILTER (event_type = 'purchase') AS started_at FROM events GROUP BY user_id
        HAVING started_at IS NOT NULL AND coalesce(max(event_id) FILTER (event_type = 'click'), -1) < started_at""",
    "session_settings": """
        SELECT c_custkey, coalesce(max(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), c_acctbal) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal""",
    "recent_users": "SELECT user_id, max(event_id) AS last_seen FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 50",
    "saved_recalls": "SELECT conv_id || ':' || turn AS key, sha256(CASE WHEN conv_id % 3 = 0 THEN text || '|recalled' ELSE text END) AS sha, conv_id % 3 = 2 AS missing FROM conversations WHERE role = 'user'",
    "session_handoffs": """
        SELECT conv_id || ':' || turn AS key, CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS n,
               sha256(CASE WHEN conv_id % 5 = 0 THEN '<handoff from="s' || conv_id || '">' || chr(10) || 'seen before' || chr(10) || '</handoff>|' || text ELSE text END) AS sha FROM conversations WHERE role = 'user'""",
    "grades_mean": f"""
        WITH {GRADES_SQL}, a AS (SELECT unit, arm, question, replicate, avg(score) AS s FROM g GROUP BY ALL), b AS (SELECT unit, arm, question, avg(s) AS s FROM a GROUP BY ALL)
        SELECT unit, arm, round(avg(s) * 50, 6) AS pct FROM b GROUP BY ALL""",
    "labels_pooled": f"WITH {GRADES_SQL} SELECT l_orderkey, CASE WHEN bool_or(label = 'wrong') THEN 'wrong' WHEN bool_and(label = 'unknown') THEN 'unknown' ELSE 'correct' END AS label FROM g GROUP BY 1",
    "judge_agreement": f"""
        WITH {GRADES_SQL}, p AS (SELECT l_orderkey, max(score) FILTER (place = 1) AS a, max(score) FILTER (place = 2) AS b FROM g GROUP BY 1)
        SELECT count(*) AS pairs, round(avg((a = b)::INT), 6) AS exact, round(avg((abs(a - b) <= 1)::INT), 6) AS within_one FROM p WHERE a IS NOT NULL AND b IS NOT NULL""",
    "question_shapes": f"""
        WITH {GRADES_SQL}, p AS (SELECT max(score) AS hi, min(score) AS lo FROM g GROUP BY l_orderkey, arm)
        SELECT count(*) FILTER (hi = 0) AS dead, count(*) FILTER (lo = 2) AS aced, count(*) FILTER (hi <> 0 AND lo <> 2) AS separating FROM p""",
    "arm_matrix": f"""
        WITH {GRADES_SQL}, p AS (SELECT unit, arm, avg(score) AS v FROM g GROUP BY ALL), q AS (SELECT * FROM p WHERE arm IN (SELECT arm FROM p GROUP BY arm HAVING count(*) >= 3))
        SELECT x.arm AS a, y.arm AS b, count(*) AS n, round(avg(x.v - y.v), 6) AS mean FROM q x JOIN q y ON x.unit = y.unit AND x.arm <> y.arm GROUP BY ALL""",
    "tool_lookups": """
        SELECT user_id, CASE WHEN event_type <> 'click' THEN event_type WHEN event_id % 3 = 0 THEN 'rg' ELSE 'bash' END AS tool, count(*) AS n FROM events GROUP BY ALL""",
    "lookup_hits": """
        WITH q AS (SELECT conv_id, turn, trim(regexp_replace(lower(split_part(text, ' ', 1)), '\\s+', ' ', 'g')) AS a FROM conversations WHERE role = 'user')
        SELECT conv_id, turn FROM q WHERE length(a) >= 3 AND EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = q.conv_id AND role = 'assistant' AND contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), a))""",
    "item_retention": """
        WITH p AS (SELECT o_custkey, o_orderpriority, coalesce(bool_or(o_totalprice > 150000), false) AS has FROM orders GROUP BY ALL)
        SELECT sum(has::INT)::BIGINT AS have, count(*) AS total, round(avg(has::INT), 9) AS share FROM p""",
    "tuned_parameters": """
        SELECT l_linenumber, l_returnflag, round(avg(l_quantity) FILTER (l_orderkey % 2 = 0), 6) AS tuned, round(avg(l_quantity) FILTER (l_orderkey % 2 = 1), 6) AS checked FROM lineitem GROUP BY 1, 2
        ORDER BY avg(l_quantity) FILTER (l_orderkey % 2 = 0) DESC, 1, 2 LIMIT 1""",
    "half_split": "SELECT event_id, (list_reduce(list_prepend(7::BIGINT, list_transform(string_split(props, ''), lambda x: unicode(x)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 2)::INT AS half FROM events",
    "closest_name": "SELECT r_name AS name, levenshtein(r_name, 'AFRIKAN')::INT AS edits FROM region WHERE levenshtein(r_name, 'AFRIKAN') <= 2 ORDER BY edits, r_regionkey LIMIT 1",
    "probability_order": f"WITH {RANK_SQL} SELECT * FROM r",
    "picked_first": f"WITH {RANK_SQL} SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN -s_suppkey END NULLS LAST, rank) AS rank FROM r",
    "best_or_first": "SELECT s_nationkey, coalesce(arg_max(s_suppkey, (s_acctbal, -s_suppkey)) FILTER (s_acctbal / 10000 > 0.5), min(s_suppkey)) AS s_suppkey FROM supplier GROUP BY 1",
    "vote_pick": f"""
        WITH {RANK_SQL}, j AS (SELECT s_nationkey, min(s_suppkey) AS said FROM s GROUP BY 1)
        SELECT s_nationkey, coalesce(min(said) FILTER (s_suppkey = said AND rank <= 2), min(s_suppkey) FILTER (rank = 1)) AS s_suppkey FROM r JOIN j USING (s_nationkey) GROUP BY 1""",
    "deferred_pick": "SELECT user_id, arg_min(event_type, event_id) AS pick, min(event_id) AS message FROM events WHERE value >= 40 GROUP BY 1",
}
