"""Evaluation statistics: hit tallies, verdicts, paired differences, resampling, gates."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.sources.tables import written

# Framings that mark a value as superseded, before and after it.
SUPERSEDED_BEFORE = r"(?:old|older|previous|former|earlier|replac\w*|instead of|rather than|no longer|not|n.t|over|from|was|were|used to|superseded|dropped|rejected|ruled out|than)\W*(?:\w+\W+){0,4}$"
SUPERSEDED_AFTER = r"^\W*(?:\w+\W+){0,3}?(?:is|was|has been|got)?\W*(?:no longer|replaced|superseded|retired|dropped|rejected|out|old|obsolete|deprecated)\b"
NOT_SAID = r"^(unknown|i don.?t know|not sure|n/a|none)\.?$"
HEDGED = r"unknown|don.?t know|not (?:sure|in (?:my )?context)|can.?t (?:find|tell)|no record"

#: Rows of owners and items that one task puts in order.
ITEM_ROWS = 1_000_000


def arm_matrix(scores: DataFrame, *, unit: str, arm: str, value: str, least: int = 3) -> DataFrame:
    """(a, b, n, mean): mean difference of every arm from every other over the units that have both, arms of `least` units and more.

    Arms are few, so a unit has few rows and the self join stays small.
    """
    per = scores.groupBy(unit, arm).agg(F.avg(value).alias("v"))
    enough = per.groupBy(arm).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(arm)
    per = per.join(F.broadcast(enough), arm)
    left, right = per.select(unit, F.col(arm).alias("a"), F.col("v").alias("va")), per.select(unit, F.col(arm).alias("b"), F.col("v").alias("vb"))
    return left.join(right, unit).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("va") - F.col("vb")).alias("mean"))


def tally(rows: DataFrame, key: list[str], hit: Column, *, everything: str = "all") -> DataFrame:
    """Hits, total and rounded per cent for each key and for everything together (one pass of grouping sets)."""
    out = rows.withColumn("__hit", hit.cast("int")).rollup(*key).agg(F.sum("__hit").alias("hits"), F.count(F.lit(1)).alias("total"), F.grouping_id().alias("__g"))
    out = out.where((F.col("__g") == 0) | (F.col("__g") == 2 ** len(key) - 1))
    out = out.withColumn("pct", T.js_round(F.lit(100.0) * F.col("hits") / F.col("total")))
    return out.select(*[F.when(F.col("__g") > 0, F.lit(everything)).otherwise(F.col(k).cast("string")).alias(k) for k in key], "hits", "total", "pct")


def uses_unframed(said: Column, value: Column) -> Column:
    """Whether some occurrence of the value is not framed as superseded by the 50 characters before or the 40 after it."""
    return T.bound(F.struct(said.alias("said"), T.normalised(value).alias("needle")), lambda x: _unframed(x["said"], x["needle"]))


def _unframed(said: Column, needle: Column) -> Column:
    """Places are only looked for in texts that hold the needle; both are values that were worked out before."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(said) - F.length(needle) + 1, F.lit(1))), lambda i: F.substr(said, i, F.length(needle)) == needle)

    def plain(i: Column) -> Column:
        before = F.substr(said, F.greatest(i - 50, F.lit(1)), i - F.greatest(i - 50, F.lit(1)))
        after = F.substr(said, i + F.length(needle), F.lit(40))
        return ~before.rlike(SUPERSEDED_BEFORE) & ~after.rlike(SUPERSEDED_AFTER)

    return F.when(F.contains(said, needle), F.exists(starts, plain)).otherwise(False)


def verdict(kind: Column, answer: Column, stale: Column, response: Column) -> Column:
    """correct, stale, wrong or unknown."""
    old = F.coalesce(stale, F.lit("")) != ""

    def judged(x: Column) -> Column:
        said, has = x["said"], F.contains(x["said"], x["answer"])
        has_old = old & F.coalesce(F.contains(said, x["stale"]), F.lit(False))
        uses_old = old & _unframed(said, x["stale"])
        decision = F.when(has & ~uses_old, "correct").when(has_old & ~has, "stale").otherwise("wrong")
        plain = F.when(has, F.when(uses_old, "wrong").otherwise("correct")).when(has_old, "stale").when(said.rlike(HEDGED), "unknown").otherwise("wrong")
        return F.when((said == "") | said.rlike(NOT_SAID), "unknown").when(kind == "decision", decision).otherwise(plain)

    return T.bound(F.struct(T.normalised(F.coalesce(response, F.lit(""))).alias("said"), T.normalised(answer).alias("answer"), T.normalised(stale).alias("stale")), judged)


def paired(scores: DataFrame, *, unit: str, arm: str, value: str, baseline: str) -> DataFrame:
    """(arm, n, mean_diff, sd): differences to a baseline arm over the units both have."""
    base = scores.where(F.col(arm) == baseline).select(unit, F.col(value).alias("__base"))
    both = scores.where(F.col(arm) != baseline).join(base, unit)
    diff = F.col(value) - F.col("__base")
    return both.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd"))


def needed_units(effect: Column, spread: Column) -> Column:
    return F.when(effect != 0, F.greatest(F.lit(3.0), F.ceil(F.lit(7.849) * spread * spread / (effect * effect)).cast("double"))).otherwise(F.lit(float("inf")))


def lcg(seed: int):
    """The linear congruential generator in double arithmetic, as numbers in [0, 1]."""
    s = seed
    while True:
        s = int(float(s) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        yield s / 0x7FFFFFFF


def mixing(seed: int):
    """The 32-bit mixing generator, as numbers in [0, 1)."""
    m = 0xFFFFFFFF
    while True:
        seed = (seed + 0x6D2B79F5) & m
        t = (seed ^ (seed >> 15)) * (1 | seed) & m
        t = ((t + ((t ^ (t >> 7)) * (61 | t) & m)) & m) ^ t
        yield ((t ^ (t >> 14)) & m) / 4294967296


#: Multiplier, increment and modulus of the generator of bootstrap_points(), and its seed.
STEP_MULTIPLIER, STEP_INCREMENT, STEP_MODULUS, STEP_SEED = 1_664_525, 1_013_904_223, 1 << 32, 20_261_008
#: Numbers of the generator that one task makes at once.
STEP_BLOCK = 1 << 20


def jumped(state: int, steps: int) -> int:
    """The generator's state so many steps on: powers of its affine step by repeated squaring."""
    a, c, by, add = 1, 0, STEP_MULTIPLIER, STEP_INCREMENT
    while steps:
        if steps & 1:
            a, c = a * by % STEP_MODULUS, (c * by + add) % STEP_MODULUS
        by, add = by * by % STEP_MODULUS, (add * by + add) % STEP_MODULUS
        steps >>= 1
    return (a * state + c) % STEP_MODULUS


def stepped(state: int, count: int) -> np.ndarray:
    """The next `count` states, doubling what is known by one jump over it."""
    out = np.empty(count, dtype=np.uint64)
    if count:
        out[0] = (state * STEP_MULTIPLIER + STEP_INCREMENT) % STEP_MODULUS
    a, c, known = STEP_MULTIPLIER, STEP_INCREMENT, 1
    while known < count:
        more = min(known, count - known)
        out[known : known + more] = (out[:more] * np.uint64(a) + np.uint64(c)) % np.uint64(STEP_MODULUS)
        a, c, known = a * a % STEP_MODULUS, (c * a + c) % STEP_MODULUS, known + more
    return out


def bootstrap_points(rows: DataFrame, *, arm: str, point: str, order: str, diff: str, draws: int = 20_000, seed: int = STEP_SEED) -> DataFrame:
    """(arm, n, mean, low, high, above, below): means of paired differences over points, resampled by point.

    Each point counts once, by the mean of its rows' differences (null ones left out), in the order of the
    least `order` of its rows.  Draw d of an arm takes numbers d * n to d * n + n - 1 of one generator that
    begins anew for each arm; blocks of draws jump ahead to theirs, so they run in parallel and equal one walk.
    low and high are the elements at 2.5 and 97.5 per cent of the sorted means; above and below count the
    points whose difference is over and under 0.  A task holds the points of one arm, one number each.
    """
    per = rows.where(F.col(diff).isNotNull()).groupBy(arm, point).agg(F.avg(F.col(diff).cast("double")).alias("d"), F.min(order).alias("o"))
    arrays = per.groupBy(arm).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", point, "d"))), lambda x: x["d"]).alias("ds"))
    each = F.greatest(F.lit(1), F.floor(F.lit(STEP_BLOCK) / F.size("ds"))).cast("int")
    blocks = arrays.withColumn("each", each).select(arm, "ds", "each", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.col("each"))).alias("first"))
    kind = dict(per.dtypes)[arm]

    def run(frames):
        for frame in frames:
            for name, ds, each, first in frame.itertuples(index=False, name=None):
                xs = np.asarray(ds, dtype=float)
                n, count = len(xs), min(each, draws - first)
                at = stepped(jumped(seed, int(first) * n), count * n).astype(float) / STEP_MODULUS * n
                drawn = xs[at.astype(np.int64)].reshape(count, n)
                # summed one after the other, as a walk would
                yield pd.DataFrame({arm: [name] * count, "m": np.add.accumulate(drawn, axis=1)[:, -1] / n})

    means = blocks.repartition(arm, "first").mapInPandas(run, f"`{arm}` {kind}, m double")
    rank = F.row_number().over(W.partitionBy(arm).orderBy("m")) - 1
    ends = means.withColumn("__r", rank).where(F.col("__r").isin(draws // 40, draws - draws // 40)).groupBy(F.col(arm).alias("__arm")).agg(F.min("m").alias("low"), F.max("m").alias("high"))
    count = lambda c: F.size(F.filter("ds", c)).cast("long")
    mean = F.aggregate("ds", F.lit(0.0), lambda a, x: a + x) / F.size("ds")
    sums = arrays.select(arm, F.size("ds").cast("long").alias("n"), mean.alias("mean"), count(lambda x: x > 0).alias("above"), count(lambda x: x < 0).alias("below"))
    return sums.join(ends, F.col(arm).eqNullSafe(F.col("__arm"))).select(arm, "n", "mean", "low", "high", "above", "below")


def bootstrap(diffs: DataFrame, key: str, order: str, value: str, *, draws: int = 10_000, seed: int = 12345, generator=lcg) -> DataFrame:
    """(key, n, low, high): the 2.5 and 97.5 per cent elements of resampled means.

    A group is one comparison's differences, one number per evaluated unit; draws are seeded per group.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        xs = frame.sort_values(order)[value].tolist()
        rand, n = generator(seed), len(xs)
        means = sorted(sum(xs[min(n - 1, math.floor(next(rand) * n))] for _ in range(n)) / n for _ in range(draws))
        return pd.DataFrame({key: [str(frame[key].iloc[0])], "n": [n], "low": [means[math.floor(draws * 0.025)]], "high": [means[math.floor(draws * 0.975)]]})

    return diffs.select(F.col(key).cast("string"), order, F.col(value).cast("double")).groupBy(key).applyInPandas(run, f"{key} string, n long, low double, high double")


def first_hit(rows: DataFrame, query: str, rank: str, hit: Column, miss: int = 999) -> DataFrame:
    return rows.groupBy(query).agg(F.coalesce(F.min(F.when(hit, F.col(rank))), F.lit(miss)).alias("first_hit"))


def gated(ranked: DataFrame, *, query: str, item: str, least: float, margin: float) -> DataFrame:
    """(query, pick): the top item if its score and its lead over the runner-up suffice, else null."""
    ahead = F.lead("score").over(W.partitionBy(query).orderBy("rank"))
    rows = ranked.withColumn("__next", F.coalesce(ahead, F.lit(0.0))).where("rank = 1")
    sure = (F.col("score") >= least) & (F.col("score") - F.col("__next") >= margin)
    return rows.select(query, F.when(sure, F.col(item)).alias("pick"))


def outcome(pick: Column, source: Column, partial: Column) -> Column:
    return (
        F.when(pick.isNull(), F.when(source.isNotNull(), "missed").otherwise("abstain-ok"))
        .when(pick == source, "right").when(F.array_contains(partial, pick), "partial").when(source.isNotNull(), "wrong").otherwise("false")
    )


def utility(rows: DataFrame, key: list[str], result: str = "outcome") -> DataFrame:
    n = lambda v: F.count_if(F.col(result) == v)
    return rows.groupBy(*key).agg(n("right").alias("right"), (n("wrong") + n("false")).alias("bad"), (n("right") - 2 * (n("wrong") + n("false")) - n("partial")).alias("utility"))


def shared_items(sets: DataFrame, *, group: str, owner: str, item: str, most: float = 0.5, from_owners: int = 4) -> DataFrame:
    """(group, a, b, shared): common items of two owners, without items that more than `most` of a group's owners have (from 4 owners on).

    A first pass counts owners and rows of each group.  Rows are then exchanged once, by item, in as many partitions
    as their number asks for; an owner meets the later ones of its item in the order of owners, so nothing is joined with itself.
    """
    per = sets.groupBy(group, owner).agg(F.count(F.lit(1)).alias("__rows")).groupBy(group).agg(F.count(owner).alias("__n"), F.sum("__rows").alias("__rows"))
    owners = written(per, "shared-owners")
    tasks = -(-int(owners.agg(F.sum("__rows")).first()[0] or 0) // ITEM_ROWS)
    rows = sets.select(group, owner, item).where(F.col(item).isNotNull()).join(owners.drop("__rows"), group)
    rows = rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), group, item).distinct()
    order = W.partitionBy(group, item).orderBy(owner)
    held = rows.withColumn("__k", F.count(F.lit(1)).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    useful = held.where(((F.col("__n") < from_owners) | (F.col("__k") <= F.col("__n") * most)) & F.col(owner).isNotNull())
    later = useful.withColumn("__later", F.collect_list(owner).over(order.rowsBetween(1, W.unboundedFollowing)))
    pairs = later.select(group, F.col(owner).alias("a"), F.explode("__later").alias("b"))
    return pairs.groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def balanced_object(text: str) -> str | None:
    """The first balanced {...}, braces in strings aside."""
    start, depth, quoted = text.find("{"), 0, False
    for m in re.finditer(r'\\.|["{}]', text[start:], re.S) if start >= 0 else ():
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : start + m.end()]
    return None


def first_json(text: str) -> str | None:
    """The first JSON object of a reply: as it stands, in a fence, or without trailing commas; null if none parses."""
    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)```", text)
    for source in (text, fenced and fenced[1]):
        found = balanced_object(source) if source else None
        for attempt in (found, found and re.sub(r",\s*([\]}])", r"\1", found)) if found else ():
            try:
                return json.dumps(json.loads(attempt), sort_keys=True, ensure_ascii=False)
            except ValueError:
                continue
    return None


def extract_json(text: Column) -> Column:
    """first_json of each text, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: first_json(t) if isinstance(t, str) else None)

    return F.pandas_udf(run, "string")(text)
