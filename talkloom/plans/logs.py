"""Usage, request-log and join operators over the driver's event and order tables (stand-in columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from talkloom.operators import evals, retrieval, turns, usage
from talkloom.plans.common import table
from talkloom.streaming import jobs


PRICES = [(0, "PROMO", 1.0), (1, "STANDARD-POLISHED", 2.0), (2, "STANDARD", 3.0), (3, "SMALL", 4.0)]


def price_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types (words joined by hyphens) priced by the first matching prefix of a list; null without one."""
    prices = spark.createDataFrame(PRICES, "pos int, prefix string, rate double")
    parts = table(spark, sf_dir, "part").withColumn("model", F.replace("p_type", F.lit(" "), F.lit("-")))
    out = usage.priced(parts, prices, name="model").groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p_retailprice") * F.col("rate")), 2).alias("priced"))
    return out


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's nearest click within ten minutes."""
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    left = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("us").alias("at"))
    right = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("us").alias("clicked"))
    found = usage.nearest(left, right, key=["user_id"], left_id="purchase_id", right_id="click_id", left_at="at", right_at="clicked", within=600_000_000)
    return found.select("purchase_id", "click_id", "distance")


def _buckets(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000")
    sums = [F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")]
    rows = usage.filled_buckets(orders, "o_orderdate", unit=unit, first=F.min("o_orderdate"), last=F.max("o_orderdate"), aggregates=sums)
    return rows.select(F.col("bucket").cast("string").alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def daily_buckets_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir, "day")


def weekly_monday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir, "week")


def _buckets_sql(unit: str, step: str) -> str:
    return f"""
        WITH o AS (SELECT date_trunc('{unit}', o_orderdate)::DATE AS b, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000),
        spine AS (SELECT unnest(generate_series(min(b)::TIMESTAMP, max(b)::TIMESTAMP, INTERVAL {step}))::DATE AS b FROM o),
        sums AS (SELECT b, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o GROUP BY b)
        SELECT b::VARCHAR AS bucket, coalesce(n, 0) AS n, coalesce(total, 0.0::DOUBLE) AS total FROM spine LEFT JOIN sums USING (b)"""


def rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and in total in one pass."""
    rows = table(spark, sf_dir, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"), F.grouping("event_type").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "Total").otherwise(F.col("event_type")).alias("label"), "n", "value")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: users are threads, values sizes."""
    e = table(spark, sf_dir, "events")
    size = F.floor(F.col("value") * 1000).cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("thread"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), size.alias("input"),
        (size * 3 + F.col("event_id") % 1000).alias("charsIn"), (size * 2 + 1).alias("charsOut"), F.lit(100).cast("long").alias("charsFixed"), (size % 7).alias("cacheRead"),
        (size % 5).alias("cacheWrite"), (size % 3).alias("uncached"), (F.col("event_type") == "error").alias("compacted"),
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 50).cast("int")).alias("turns"), F.lit(100_000).cast("long").alias("window"),
    )


LOG_SQL = """
    e0 AS (SELECT *, floor(value * 1000)::BIGINT AS sz FROM events),
    log AS (SELECT user_id::VARCHAR AS thread, event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, sz AS input, sz * 3 + event_id % 1000 AS ci, sz * 2 + 1 AS co, 100 AS cf,
                   sz % 7 AS cr, sz % 5 AS cw, sz % 3 AS un, event_type = 'error' AS compacted, CASE WHEN event_id % 3 = 0 THEN (event_id % 50)::INT END AS turns, 100000 AS win FROM e0),
    rec AS (SELECT *, CASE WHEN input > 0 AND co > 0 AND ci > 0 THEN floor(input::DOUBLE * ci / co + 0.5)::BIGINT END AS plain,
                   CASE WHEN input > 0 AND co > 0 THEN floor(input::DOUBLE * cf / co + 0.5)::BIGINT END AS fixed FROM log)"""


def per_session_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.per_session(_log(spark, sf_dir))


def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the last 24 hours of the log."""
    log = _log(spark, sf_dir)
    newest = F.broadcast(log.agg(F.max("ts").alias("now")))
    recent = log.crossJoin(newest).where(F.col("ts").cast("timestamp") >= F.col("now").cast("timestamp") - F.expr("interval 24 hours"))
    return usage.totals(recent.drop("now"))


def thread_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.thread_peaks(_log(spark, sf_dir))


def resetting_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.native_compactions(_log(spark, sf_dir)).groupBy("thread").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"))


OFFSET_SQL = f"""
    WITH {LOG_SQL}, g AS (SELECT thread, list({{'o': 0.0::DOUBLE, 'h': 0::BIGINT, 'p': plain::DOUBLE, 'f': coalesce(fixed, 0)::DOUBLE}} ORDER BY seq) AS xs, count(*) AS n FROM rec WHERE plain IS NOT NULL GROUP BY thread),
    w AS (SELECT thread, n, list_reduce(xs, lambda acc, x: CASE WHEN x.p - acc.o > 0.92::DOUBLE * 100000 THEN {{'o': x.p - x.f - 8333.0::DOUBLE, 'h': acc.h + 1, 'p': 0.0::DOUBLE, 'f': 0.0::DOUBLE}} ELSE acc END,
            {{'o': 0.0::DOUBLE, 'h': 0::BIGINT, 'p': 0.0::DOUBLE, 'f': 0.0::DOUBLE}}) AS acc FROM g)"""


def model_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, lines and share of the total by brand, largest first."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_discount")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    per = lines.join(parts, "l_partkey").groupBy("p_brand").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count(F.lit(1)).alias("n"))
    return per.select("p_brand", "n", F.round("r", 2).alias("revenue"), F.round(F.col("r") / F.sum("r").over(W.partitionBy()), 6).alias("share"))


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.nth_ascending(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.5, "median")


def p95_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.nth_ascending(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.95, "p95")


def anti_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order whose status no returned line of the order has: the returned ones are what is still in the context."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    open_ = turns.without_kept(lines, lines.where("l_returnflag = 'R'"), call_id="l_orderkey", text="l_linestatus")
    return open_.select("l_orderkey", "l_linenumber", "l_linestatus")


def range_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each order's up to twelve newest earlier orders of its customer were urgent.

    The self range join "same customer, earlier, newest twelve" is a frame of twelve rows: no pair is made.
    """
    before = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-12, -1)
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.count(F.lit(1)).over(before).alias("n_before"), F.coalesce(F.sum(urgent).over(before), F.lit(0)).alias("n_urgent"))
    return rows


def overlap_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts two suppliers of a nation have in common, without parts that more than half of the nation's suppliers have."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    owned = lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    pairs = evals.shared_items(owned, group="s_nationkey", owner="l_suppkey", item="l_partkey")
    return pairs.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("shared").alias("shared"), F.max("shared").alias("most"))


def runner_up_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's largest supplier balance, picked if it leads the second by 500."""
    order = W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    ranked = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("score"), F.row_number().over(order).alias("rank"))
    return evals.gated(ranked, query="s_nationkey", item="s_suppkey", least=1000.0, margin=500.0)


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each customer segment."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return retrieval.ranked(joined.withColumn("score", F.col("o_totalprice")), "c_mktsegment", ["o_orderkey"], 3).select("c_mktsegment", "o_orderkey", "rank", "o_totalprice")


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows per type, the plan the stream runs."""
    sums = [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")]
    rows = jobs.tumbling(table(spark, sf_dir, "events"), at="ts", width="1 hour", late="10 minutes", keys=["event_type"], aggregates=sums)
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def events_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of a user end after thirty minutes without an event."""
    rows = jobs.sessions(table(spark, sf_dir, "events"), at="ts", gap="30 minutes", late="10 minutes", key="user_id", aggregates=[F.count(F.lit(1)).alias("n")])
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started"), "n")


QUERIES = {
    f.__name__: f
    for f in (price_prefix_join, asof_nearest, daily_buckets_zero_filled, weekly_monday, rollup_total, per_session_last, request_totals, thread_peaks, resetting_offset, model_share,
              upper_median, p95_floor, anti_kept, range_earlier, overlap_intersect, runner_up_gate, top_per_group, events_tumbling, events_session_window)
}


def _nth_sql(share: str, name: str) -> str:
    return f"""
        WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) - 1 AS k,
                          count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem)
        SELECT l_returnflag, l_linestatus, l_extendedprice AS {name} FROM r WHERE k = least(floor({share}::DOUBLE * n), n - 1)"""


ORACLE_SQL = {
    "price_prefix_join": """
        WITH p(pos, prefix, rate) AS (VALUES (0, 'PROMO', 1.0::DOUBLE), (1, 'STANDARD-POLISHED', 2.0), (2, 'STANDARD', 3.0), (3, 'SMALL', 4.0)),
        m AS (SELECT p_partkey, p_retailprice, prefix, rate FROM (SELECT *, replace(p_type, ' ', '-') AS model FROM part) LEFT JOIN p ON model = prefix OR starts_with(model, prefix || '-')
              QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY pos) = 1)
        SELECT prefix, count(*) AS n, round(sum(p_retailprice * rate), 2) AS priced FROM m GROUP BY prefix""",
    "asof_nearest": """
        WITH e AS (SELECT *, epoch_us(ts) AS us FROM events)
        SELECT a.event_id AS purchase_id, b.event_id AS click_id, abs(a.us - b.us) AS distance FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.us - b.us) <= 600000000
        WHERE a.event_type = 'purchase' AND b.event_type = 'click' QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.us - b.us), b.event_id) = 1""",
    "daily_buckets_zero_filled": _buckets_sql("day", "1 DAY"),
    "weekly_monday": _buckets_sql("week", "7 DAYS"),
    "rollup_total": "SELECT CASE WHEN grouping(event_type) = 1 THEN 'Total' ELSE event_type END AS label, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ROLLUP (event_type)",
    "per_session_last": f"""
        WITH {LOG_SQL} SELECT thread AS session, arg_max(input, seq) AS context, arg_max(fixed, seq) AS fixed, arg_max(plain, seq) AS plain, arg_max(turns, seq) FILTER (turns IS NOT NULL) AS turns,
               count(*) AS requests, sum(compacted::INT)::BIGINT AS folds, arg_max(ts, seq) AS last_seen FROM rec WHERE input > 0 GROUP BY thread""",
    "request_totals": f"""
        WITH {LOG_SQL}, r AS (SELECT * FROM rec WHERE ts::TIMESTAMP >= (SELECT max(ts)::TIMESTAMP FROM rec) - INTERVAL 24 HOURS AND input > 0)
        SELECT count(*) AS requests, coalesce(sum(cr), 0)::BIGINT AS "cacheRead", coalesce(sum(cw), 0)::BIGINT AS "cacheWrite", coalesce(sum(un), 0)::BIGINT AS uncached, coalesce(sum(compacted::INT), 0)::BIGINT AS folds,
               arg_max(ts, seq) FILTER (compacted) AS last_fold, coalesce(sum(input) FILTER (plain IS NOT NULL), 0)::BIGINT AS sent, coalesce(sum(plain - input), 0)::BIGINT AS saved FROM r""",
    "thread_peaks": f"""
        {OFFSET_SQL}, p AS (SELECT thread, max(plain) AS plain, arg_max(input, plain * 1000000000 + seq) AS sent, arg_max(turns, seq) FILTER (turns IS NOT NULL) AS turns, arg_max(ts, seq) AS last_seen FROM rec WHERE plain IS NOT NULL GROUP BY thread)
        SELECT p.*, coalesce(acc.h, 0) AS compactions FROM p LEFT JOIN w USING (thread)""",
    "resetting_offset": f"{OFFSET_SQL} SELECT thread, acc.h AS hits, n FROM w",
    "model_share": """
        WITH p AS (SELECT p_brand, sum(l_extendedprice * (1 - l_discount)) AS r, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
        SELECT p_brand, n, round(r, 2) AS revenue, round(r / sum(r) OVER (), 6) AS share FROM p""",
    "upper_median": _nth_sql("0.5", "median"),
    "p95_floor": _nth_sql("0.95", "p95"),
    "anti_kept": """
        SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem l
        WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_linestatus = l.l_linestatus AND k.l_returnflag = 'R')""",
    "range_earlier": """
        SELECT o_orderkey, count(*) OVER w AS n_before, coalesce(sum((o_orderpriority = '1-URGENT')::INT) OVER w, 0)::BIGINT AS n_urgent FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
    "overlap_intersect": """
        WITH o AS (SELECT DISTINCT s_nationkey, l_suppkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), c AS (SELECT s_nationkey, count(DISTINCT l_suppkey) AS n FROM o GROUP BY 1),
        u AS (SELECT s_nationkey, l_partkey FROM o JOIN c USING (s_nationkey) GROUP BY s_nationkey, l_partkey, n HAVING n < 4 OR count(*) <= n * 0.5), k AS (SELECT o.* FROM o JOIN u USING (s_nationkey, l_partkey)),
        p AS (SELECT a.s_nationkey, a.l_suppkey, b.l_suppkey AS other, count(*) AS shared FROM k a JOIN k b ON a.s_nationkey = b.s_nationkey AND a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)
        SELECT s_nationkey, count(*) AS pairs, sum(shared)::BIGINT AS shared, max(shared) AS most FROM p GROUP BY s_nationkey""",
    "runner_up_gate": """
        WITH r AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(s_acctbal) OVER w, 0) AS nxt FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey))
        SELECT s_nationkey, CASE WHEN s_acctbal >= 1000 AND s_acctbal - nxt >= 500 THEN s_suppkey END AS pick FROM r WHERE rank = 1""",
    "top_per_group": """
        SELECT c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(o_totalprice, 9) DESC, o_orderkey) AS rank, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY rank <= 3""",
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "events_session_window": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, count(*) AS n FROM n GROUP BY user_id, k""",
}
