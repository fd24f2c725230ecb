"""Usage and request-log analytics: dedupe, prices, buckets, nearest matches, totals, peaks, offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.operators.walks import walk
from talkloom.sources.tables import written

WRITE_5M, WRITE_1H, FAST = 1.25, 2.0, 2.0
COMPACT_AT, SUMMARY_TOKENS = 0.92, 8_333
#: Length of the time blocks of nearest(), in tolerances.
NEAR_BLOCK = 16


def best_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")


def deduplicated_usage(lines: DataFrame) -> DataFrame:
    """Usage lines to one row per response: API rows first, then larger output, larger cache writes, earlier line; placeholders go last.

    Rows without a model stay, as "unknown"; only synthetic ones go.  Lines without a message id are their own.
    """
    key = F.when(F.col("message_id").isNotNull(), F.concat_ws(":", "message_id", F.coalesce("request_id", F.lit("")))).otherwise(F.concat_ws(":", "file", F.col("line").cast("string")))
    api = F.col("service_tier").isNotNull()
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = lines.where(~F.col("model").eqNullSafe("<synthetic>")).withColumns({"__key": key, "__api": api})
    best = best_per_key(rows, ["__key"], [F.desc("__api"), n("output_tokens").desc(), n("cache_creation_input_tokens").desc(), F.asc("file"), F.asc("line")])
    placeholder = ~F.col("__api") & (n("input_tokens") == 1000) & (n("cache_read_input_tokens") == 0) & (n("cache_creation_input_tokens") == 0)
    hour = F.least(n("cache_creation_input_tokens"), n("ephemeral_1h_input_tokens"))
    return best.where(~placeholder).select(
        "at", F.coalesce("model", F.lit("unknown")).alias("model"), n("input_tokens").alias("input"), n("output_tokens").alias("output"),
        (n("cache_creation_input_tokens") - hour).alias("cache_write_5m"), hour.alias("cache_write_1h"), n("cache_read_input_tokens").alias("cache_read"), (F.coalesce("speed", F.lit("")) == "fast").alias("fast"),
    )


def priced(rows: DataFrame, prices: DataFrame, *, name: str) -> DataFrame:
    """Left join with the first price (by pos) whose prefix is the name or is followed by a hyphen in it.

    A hyphenated name has few prefixes, so the theta join becomes an equi-join of the names' prefixes;
    distinct names are matched once and their price joins back.
    """
    parts = F.split(F.col(name), "-")
    names = rows.select(name).distinct().select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "-"))).alias("prefix"))
    found = best_per_key(names.join(prices, "prefix"), [name], [F.asc("pos")])
    return rows.join(found, name, "left")


def cost() -> Column:
    """Dollars of a usage row with its price columns (p_input, p_output, p_read per million); null without a price."""
    sum_ = F.col("input") * F.col("p_input") + F.col("output") * F.col("p_output") + F.col("cache_read") * F.col("p_read") + F.col("cache_write_5m") * F.col("p_input") * F.lit(WRITE_5M) + F.col("cache_write_1h") * F.col("p_input") * F.lit(WRITE_1H)
    return sum_ / F.lit(1e6) * F.when(F.col("fast"), F.lit(FAST)).otherwise(F.lit(1.0))


def summarize(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Per group (or over all): requests, tokens, dollars of the priced rows and how many have no price; rows carry cost() as dollars."""
    n = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), n("input", "input"), n("output", "output"), n(F.col("cache_write_5m") + F.col("cache_write_1h"), "cache_write"), n("cache_read", "cache_read"),
        F.coalesce(F.sum("dollars"), F.lit(0.0)).alias("cost"), F.count_if(F.col("dollars").isNull()).alias("unpriced"),
    )


def by_model(rows: DataFrame) -> DataFrame:
    """summarize() per model with its place by falling cost, then requests, and its share of all dollars; no share where a price is missing.

    Only the models' own rows, a handful, are ranked in one partition.
    """
    per = summarize(rows, "model")
    total = F.sum("cost").over(W.partitionBy())
    share = F.when((total > 0) & (F.col("unpriced") == 0), F.col("cost") / total)
    return per.withColumns({"share": share, "place": F.row_number().over(W.orderBy(F.desc("cost"), F.desc("requests"), "model"))})


def hit_rate(read: Column, write: Column, uncached: Column) -> Column:
    """Share of the input that came from the cache; null without input."""
    return F.try_divide(read.cast("double"), (read + write + uncached).cast("double"))


def rates() -> tuple[Column, Column]:
    """Dollars per cached token read and written; without writes the hour rate."""
    writes = F.col("cache_write_5m") + F.col("cache_write_1h")
    share = F.when(writes > 0, (F.col("cache_write_5m") * F.lit(WRITE_5M) + F.col("cache_write_1h") * F.lit(WRITE_1H)) / writes).otherwise(F.lit(WRITE_1H))
    scale = F.when(F.col("fast"), F.lit(FAST)).otherwise(F.lit(1.0)) / F.lit(1e6)
    return F.col("p_read") * scale, F.col("p_input") * share * scale


def nearest(left: DataFrame, right: DataFrame, *, key: list[str], left_id: str, right_id: str, left_at: str, right_at: str, within: int) -> DataFrame:
    """Each left row with the right row of its key nearest in time (epoch units), `within` at most, earliest id on ties.

    Both sides stand in one order of time, where the last right row before and the first one after a left row
    are its only candidates; no pair is made.  Times fall in blocks of NEAR_BLOCK tolerances, so a key with many
    rows is split; right rows near an edge stand in both blocks.  Null keys and times match nothing.
    """
    block = lambda c: F.floor(c / (within * NEAR_BLOCK or 1))
    known = lambda rows, at: rows.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*key, at)]))
    near = known(left, left_at).select(*key, block(F.col(left_at)).alias("__block"), F.col(left_at).alias("__at"), F.struct(*left.columns).alias("__left"))
    found = F.struct(F.col(right_id), F.col(right_at)).alias("__right")
    there = known(right, right_at).select(*key, F.explode(F.sequence(block(F.col(right_at) - within), block(F.col(right_at) + within))).alias("__block"), F.col(right_at).alias("__at"), found)
    rows = near.unionByName(there, allowMissingColumns=True)
    # left rows come behind right ones of their time, of which the least id stands last
    last = lambda time: F.last("__right", ignorenulls=True).over(W.partitionBy(*key, "__block").orderBy(time, F.col("__left").isNotNull(), F.desc(f"__right.{right_id}")).rowsBetween(W.unboundedPreceding, 0))
    sides = rows.withColumns({"__before": last(F.asc("__at")), "__after": last(F.desc("__at"))}).where(F.col("__left").isNotNull())
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("__at") - F.col(c)[right_at]).alias("distance"), F.col(c)[right_id].alias("id"), F.col(c)[right_at].alias("at")))
    best = sides.withColumn("__best", F.least(away("__before"), away("__after"))).where(F.col("__best.distance") <= within)
    others = [F.col("__left")[c].alias(c) for c in left.columns if c not in key]
    met = best.select(*key, *others, F.col("__best.id").alias(right_id), F.col("__best.at").alias(right_at), F.col("__best.distance").alias("distance"))
    return best_per_key(met, [left_id], [F.asc("distance"), F.asc(right_id)])


def filled_buckets(rows: DataFrame, at: str, *, unit: str, first: Column, last: Column, aggregates: list[Column]) -> DataFrame:
    """One row per calendar bucket between two dates, empty ones too; weeks begin on Monday."""
    step = {"day": "interval 1 day", "week": "interval 7 days"}[unit]
    spine = rows.agg(F.date_trunc(unit, first).cast("date").alias("a"), F.date_trunc(unit, last).cast("date").alias("b"))
    spine = spine.select(F.explode(F.sequence("a", "b", F.expr(step))).alias("bucket"))
    sums = rows.groupBy(F.date_trunc(unit, at).cast("date").alias("bucket")).agg(*aggregates)
    return spine.join(sums, "bucket", "left")


def scaled(chars: str) -> Column:
    """round(input * chars / charsOut) where all are positive, else null."""
    ok = (F.col("input") > 0) & (F.col("charsOut") > 0) & (F.col(chars) > 0)
    return F.when(ok, T.js_round(F.col("input") * F.col(chars) / F.col("charsOut")))


def per_session(log: DataFrame) -> DataFrame:
    """Last sizes, last known turns, requests, folds and last seen of each session of a request log (seq gives the order)."""
    session = F.regexp_replace("thread", "-[0-9a-f]{24}$", "")
    rows = log.where((F.col("input") > 0) & F.col("thread").isNotNull()).withColumns({"session": session, "fixed": scaled("charsFixed"), "plain": scaled("charsIn")})
    last = lambda c: F.max_by(F.col(c), F.col("seq")).alias
    turns = F.max_by("turns", F.when(F.col("turns").isNotNull(), F.col("seq")))
    return rows.groupBy("session").agg(last("input")("context"), last("fixed")("fixed"), last("plain")("plain"), turns.alias("turns"), F.count(F.lit(1)).alias("requests"), F.count_if(F.coalesce("compacted", F.lit(False))).alias("folds"), last("ts")("last_seen"))


def totals(log: DataFrame) -> DataFrame:
    rows = log.where("input > 0").withColumn("saved", scaled("charsIn") - F.col("input"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    fold = F.coalesce("compacted", F.lit(False))
    sent = F.coalesce(F.sum(F.when(F.col("saved").isNotNull(), F.col("input"))), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("requests"), n("cacheRead"), n("cacheWrite"), n("uncached"), F.count_if(fold).alias("folds"), F.max_by("ts", F.when(fold, F.col("seq"))).alias("last_fold"), sent.alias("sent"), n("saved"))


def resetting_offset(rows: DataFrame, *, key: str, order: str, plain: str, fixed: str, window: Column, at: float = COMPACT_AT, summary: int = SUMMARY_TOKENS) -> DataFrame:
    """(key, order, hit): rows where the size since the last reset passes at * window; a hit resets to plain - fixed - summary."""

    def step(state: list, o: int, p: float, f: float, w: float) -> tuple:
        hit = bool(p - state[0] > at * w)  # a missing size or window never hits
        if hit:
            state[0] = p - f - summary
        return o, hit

    number = lambda c: c.cast("double")
    values = {"p": number(F.col(plain)), "f": number(F.coalesce(F.col(fixed), F.lit(0))), "w": number(window)}
    return walk(rows, key=key, order=order, values=values, start=lambda: [0.0], step=step, schema=f"{order} bigint, hit boolean")


def native_compactions(log: DataFrame) -> DataFrame:
    """(thread, seq, hit) of a request log's sized rows."""
    rows = log.withColumns({"plain": scaled("charsIn"), "fixed": scaled("charsFixed")}).where("plain is not null and thread is not null and window > 0")
    return resetting_offset(rows, key="thread", order="seq", plain="plain", fixed="fixed", window=F.col("window"))


def thread_peaks(log: DataFrame) -> DataFrame:
    """Per thread its largest plain size (the later row on ties) with what was sent then, last known turns, compactions, last seen."""
    rows = log.withColumn("plain", scaled("charsIn")).where("plain is not null and thread is not null")
    hits = native_compactions(log).groupBy("thread").agg(F.count_if("hit").alias("compactions"))
    place = F.struct("plain", "seq")
    out = rows.groupBy("thread").agg(F.max("plain").alias("plain"), F.max_by("input", place).alias("sent"), F.max_by("turns", F.when(F.col("turns").isNotNull(), F.col("seq"))).alias("turns"), F.max_by("ts", "seq").alias("last_seen"))
    return out.join(hits, "thread", "left").withColumn("compactions", F.coalesce("compactions", F.lit(0)))


def savings_rows(log: DataFrame, usage: DataFrame, prices: DataFrame, within_ms: int = 600_000) -> DataFrame:
    """(seq, at, saved_tokens, usage_id, saved, actual) of the requests with input, matched with usage rows: tokens kept out and the dollars they and the request are worth.

    saved and actual are null without a match or a price, saved also without sizes.
    """
    key = ["k_read", "k_write", "k_input"]
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    left = log.where("input > 0").withColumns({"k_read": n("cacheRead"), "k_write": n("cacheWrite"), "k_input": n("uncached"), "saved_tokens": scaled("charsIn") - F.col("input")})
    right = usage.withColumns({"k_read": F.col("cache_read"), "k_write": F.col("cache_write_5m") + F.col("cache_write_1h"), "k_input": F.col("input")})
    pairs = nearest(left.select("seq", "at", *key), right.select("usage_id", F.col("at").alias("used_at"), *key), key=key, left_id="seq", right_id="usage_id", left_at="at", right_at="used_at", within=within_ms)
    entry = priced(usage, prices, name="model").drop("at", "pos", "prefix")
    read, write = rates()
    both = left.select("seq", "at", "saved_tokens", "compacted", "k_write").join(pairs.select("seq", "usage_id"), "seq", "left").join(entry, "usage_id", "left")
    rewrite = F.when(F.coalesce("compacted", F.lit(False)), F.col("k_write") * (write - read)).otherwise(F.lit(0.0))
    return both.select("seq", "at", "saved_tokens", "usage_id", (F.col("saved_tokens") * read - rewrite).alias("saved"), cost().alias("actual"))


def saving_sums() -> list[Column]:
    """handled, priced, unsized, unmatched, actual and saved dollars, as aggregates over savings_rows()."""
    ok = F.col("saved").isNotNull() & F.col("actual").isNotNull()
    return [
        F.count(F.lit(1)).alias("handled"), F.count_if(ok).alias("priced"), F.count_if(F.col("saved_tokens").isNull()).alias("unsized"),
        F.count_if(F.col("saved_tokens").isNotNull() & F.col("usage_id").isNull()).alias("unmatched"),
        F.coalesce(F.sum(F.when(ok, F.col("actual"))), F.lit(0.0)).alias("actual"), F.coalesce(F.sum(F.when(ok, F.col("saved"))), F.lit(0.0)).alias("saved"),
    ]


def savings(log: DataFrame, usage: DataFrame, prices: DataFrame, within_ms: int = 600_000) -> DataFrame:
    """handled, priced, unsized, unmatched, actual and saved dollars of a request log matched with usage rows."""
    return savings_rows(log, usage, prices, within_ms).agg(*saving_sums())


def nth_ascending(rows: DataFrame, key: list[str], value: str, share: float, name: str, *, accuracy: int = 10_000) -> DataFrame:
    """The element numbered floor(share * n) (from 0) of the ascending numbers of each group.

    A sketch that is merged map-side gives two numbers around the place; a second pass counts what lies at and
    below them, and only distinct numbers between them, some 1 in `accuracy` / 6 of the rows, are put in order with
    their counts.  Where the sketch missed the place, that side stays open, so the answer is exact in any case.
    Null keys are groups, null numbers are left out.  Numbers of each group are written, one row a group, so that
    their size is known: where groups are few, the rows meet them where they lie and no group is gathered in a task.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("__v"))
    same = lambda side: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{side}{i}")) for i, k in enumerate(key)])
    own = lambda side: [F.col(k).alias(f"__{side}{i}") for i, k in enumerate(key)]
    around = F.percentile_approx("__v", [max(0.0, share - 3 / accuracy), min(1.0, share + 3 / accuracy)], accuracy)
    guess = written(rows.groupBy(*key).agg(around.alias("__p")).select(*own("g"), F.col("__p")[0].alias("__low"), F.col("__p")[1].alias("__high")), "nth-guess")
    near = rows.join(guess, same("g"))
    counts = near.groupBy(*key, "__low", "__high").agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__v") < F.col("__low")).alias("__below"), F.count_if(F.col("__v") <= F.col("__high")).alias("__upto"))
    place = F.least(F.floor(F.lit(share) * F.col("__n")), F.col("__n") - 1)
    low, high = F.col("__below") <= place, F.col("__upto") > place
    bounds = counts.select(*own("b"), place.alias("__place"), F.when(low, F.col("__below")).otherwise(0).alias("__before"), F.when(low, F.col("__low")).alias("__from"), F.when(high, F.col("__high")).alias("__to"))
    bounds = written(bounds, "nth-bounds")
    inside = (F.col("__from").isNull() | (F.col("__v") >= F.col("__from"))) & (F.col("__to").isNull() | (F.col("__v") <= F.col("__to")))
    few = rows.join(bounds, same("b")).where(inside).groupBy(*key, "__v", "__place", "__before").agg(F.count(F.lit(1)).alias("__times"))
    upto = F.col("__before") + F.sum("__times").over(W.partitionBy(*key).orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    return few.withColumn("__at", upto).where(F.col("__at") > F.col("__place")).groupBy(*key).agg(F.min("__v").alias(name))
