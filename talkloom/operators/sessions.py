"""Sessions as a catalogue: outlines, candidates, ranking, side runs, hand-offs between sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.functions import text as T
from talkloom.operators import retrieval

LEAST_ASKS, MOST_CANDIDATES, LEAST_TERMS = 2, 12, 2
INLINE = "sidechain"


def outlines(turns: DataFrame, *, session: str, turn: str, prompt: str) -> DataFrame:
    """(session, asks, outline): the first 240 characters of each turn's non-empty prompt, numbered, in order."""
    rows = turns.withColumn("__t", T.without_tags(F.col(prompt))).where("__t <> ''")
    asks = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), F.substring("__t", 1, 240).alias("t")))), lambda x: x["t"])
    numbered = F.array_join(F.transform("asks", lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a)), "\n")
    return rows.groupBy(session).agg(asks.alias("asks")).withColumn("outline", numbered)


def session_files(seen: DataFrame, scanned: DataFrame) -> DataFrame:
    """Files of sessions seen at the proxy and found by scan; the seen one counts for an id in both."""
    both = seen.select("id", "file", "mtime", F.lit(0).alias("__from")).union(scanned.select("id", "file", "mtime", F.lit(1)))
    return both.withColumn("__rank", F.row_number().over(W.partitionBy("id").orderBy("__from", "file"))).where("__rank = 1").drop("__rank", "__from")


def candidates(catalogue: DataFrame, *, owner: Column, most: int = MOST_CANDIDATES) -> DataFrame:
    """The newest sessions of each working folder with two prompts and more; order is their place from 1."""
    rows = catalogue.where((F.size("asks") >= LEAST_ASKS) & owner)
    order = W.partitionBy("cwd").orderBy(F.desc("mtime"), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def ranked_candidates(prompts: DataFrame, found: DataFrame, *, prompt_id: str, prompt: str, min_terms: int = LEAST_TERMS) -> DataFrame:
    """(prompt_id, id, matched, score, rank) by BM25 over outlines, ties by id."""
    scored = retrieval.bm25(prompts, found, query_id=prompt_id, query_terms=T.terms(F.col(prompt)), doc_key=["id"], doc_terms=T.terms(F.col("outline")), min_terms=min_terms)
    return retrieval.ranked(scored, prompt_id, ["id"])


def shortlist(ranked: DataFrame, found: DataFrame, *, prompt_id: str, prompts: DataFrame, k: int = 3) -> DataFrame:
    """The k best candidates of each prompt, filled with unranked ones, newest first.

    Candidates are bounded per folder, so every prompt meets only its folder's list.
    """
    pool = prompts.select(prompt_id, "cwd").join(found.select("cwd", "id", "mtime"), "cwd").join(ranked.select(prompt_id, "id", "rank"), [prompt_id, "id"], "left")
    order = W.partitionBy(prompt_id).orderBy(F.col("rank").asc_nulls_last(), F.desc("mtime"), "id")
    return pool.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(prompt_id, "id", "place")


def filtered(ranked: DataFrame, found: DataFrame, query: str) -> DataFrame:
    """Ranked candidates, then unranked ones whose label or outline holds every word of the query."""
    words = F.array(*[F.lit(w) for w in query.lower().split()])
    hay = F.lower(F.concat_ws(" ", "label", "outline"))
    rest = found.join(ranked.select("id"), "id", "left_anti").where(F.forall(words, lambda w: F.contains(hay, w)))
    first = ranked.select("id", F.lit(0).alias("__part"), F.col("rank").cast("long").alias("__by"))
    return first.union(rest.select("id", F.lit(1), -F.col("mtime").cast("long"))).withColumn("place", F.row_number().over(W.orderBy("__part", "__by", "id"))).select("id", "place")


def without_copies(catalogue: DataFrame) -> DataFrame:
    """One session of those that share their first two prompts, the oldest."""
    key = F.sha2(F.array_join(F.slice("asks", 1, 2), "\n"), 256)
    return catalogue.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy("mtime", "id"))).where("__rank = 1").drop("__rank")


def side_runs(file_entries: DataFrame, meta: DataFrame, inline_entries: DataFrame) -> DataFrame:
    """Side runs of a session: those with files of their own, and inline ones without a file, by start.

    file_entries and inline_entries: run_id, seq, ts, type, text; meta: run_id, description, tool_use_id.
    """

    def summed(rows: DataFrame, inline: bool) -> DataFrame:
        prompt = F.min_by("text", F.when((F.col("type") == "user") & (F.coalesce("text", F.lit("")) != ""), F.col("seq")))
        found = rows.withColumn("run_id", F.coalesce("run_id", F.lit(INLINE))).groupBy("run_id").agg(F.coalesce(prompt, F.lit("")).alias("prompt"), F.coalesce(F.min_by("ts", "seq"), F.lit("")).alias("started"))
        return found.withColumn("inline", F.lit(inline))

    own = summed(file_entries, False).join(meta, "run_id", "left")
    inside = summed(inline_entries, True).join(own.select("run_id"), "run_id", "left_anti")
    both = own.unionByName(inside, allowMissingColumns=True)
    return both.select("run_id", "inline", F.coalesce("description", T.clip(F.col("prompt"), 80)).alias("description"), "tool_use_id", "prompt", "started")


def numbered_runs(launched: DataFrame) -> DataFrame:
    """Adds k: the nth run of its parent turn, by start."""
    return launched.withColumn("k", F.row_number().over(W.partitionBy("turn").orderBy("started", "run_id")))


def continue_id(text: Column, marker: str = "continue") -> Column:
    """The session id (eight characters and more) a prompt asks to continue, injected text aside; null if none."""
    found = F.regexp_extract(T.spoken(text), r"\{(?:[a-z]+:)?" + marker + r":([A-Za-z0-9-]{8,})\}", 1)
    return F.when(found != "", found)


def with_handoffs(prompts: DataFrame, handoffs: DataFrame, *, key: str, blocks: str) -> DataFrame:
    """Prompts with the saved hand-off of their fingerprint in front; resolved to nothing (null text) adds nothing."""
    known = handoffs.where("text is not null").select(key, F.col("label").alias("__label"), F.col("text").alias("__text"))
    block = F.concat(F.lit('<handoff from="'), T.xml_attribute(F.col("__label")), F.lit('">\n'), F.col("__text"), F.lit("\n</handoff>"))
    out = prompts.join(known, key, "left")
    return out.withColumn(blocks, F.when(F.col("__text").isNotNull(), F.concat(F.array(block), blocks)).otherwise(F.col(blocks))).drop("__label", "__text")


def with_recalls(prompts: DataFrame, recalls: DataFrame, *, key: str, blocks: str) -> DataFrame:
    """Prompts with their saved recall behind; an empty recall was computed and adds nothing."""
    known = recalls.where("text is not null and text <> ''").select(key, F.col("text").alias("__text"))
    return prompts.join(known, key, "left").withColumn(blocks, F.when(F.col("__text").isNotNull(), F.concat(blocks, F.array("__text"))).otherwise(F.col(blocks))).drop("__text")


def missing_recalls(prompts: DataFrame, recalls: DataFrame, *, key: str) -> DataFrame:
    """Prompts whose recall has not been computed, not even to nothing."""
    return prompts.join(recalls.where("text is not null").select(key), key, "left_anti")


def unrouted(live: DataFrame, seen: DataFrame) -> DataFrame:
    """Live sessions never seen, or last seen before they started."""
    return live.join(seen.select("session_id", "last_seen"), "session_id", "left").where("last_seen is null or last_seen < started_at")


def recent_sessions(rows: DataFrame, *, session: str, at: str, keep: int = 200) -> DataFrame:
    """Last seen per session, the newest `keep`."""
    return rows.groupBy(session).agg(F.max(at).alias("last_seen")).orderBy(F.desc("last_seen"), session).limit(keep)


def with_settings(sessions: DataFrame, settings: DataFrame, *, key: str, names: list[str]) -> DataFrame:
    """Each session's own settings over the defaults it has."""
    own = settings.select(key, *[F.col(n).alias(f"__{n}") for n in names])
    out = sessions.join(own, key, "left")
    return out.withColumns({n: F.coalesce(f"__{n}", n) for n in names}).drop(*[f"__{n}" for n in names])


def discovered(catalogue: DataFrame, *, group: str = "cwd", least: int = 15, prefix: int = 200) -> DataFrame:
    """Sessions to choose among: `least` prompts and more, one of those whose outlines begin alike (the first id), groups of two and more; place from the newest."""
    rows = catalogue.where(F.size("asks") >= least)
    alike = W.partitionBy(group, F.substring("outline", 1, prefix)).orderBy("id")
    one = rows.withColumn("__rank", F.row_number().over(alike)).where("__rank = 1").drop("__rank")
    enough = one.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2").select(group)
    return one.join(enough, group, "left_semi").withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("mtime"), "id")))


def recent_outline(asks: Column, count: int = 10) -> Column:
    """The last `count` prompts with their numbers in the session."""
    first = F.greatest(F.size(asks) - count, F.lit(0))
    return F.array_join(F.transform(F.slice(asks, first + 1, F.lit(count)), lambda a, i: F.concat((first + i + 1).cast("string"), F.lit(". "), a)), "\n")


def pull_report(runs: DataFrame, calls: DataFrame, *, arm: list[str]) -> DataFrame:
    """(arm, runs, pulled, loaded, right, commands): runs that looked up or loaded an earlier session, and whether it was always the right one.

    runs: run_id, arm columns, source; calls: run_id, kind (load, peek or another), source.  right counts
    runs whose every load or peek names their source; commands are the mean calls of a run.
    """
    pull = F.col("kind").isin("load", "peek")
    wanted = runs.select("run_id", F.col("source").alias("__own"))
    per = calls.join(wanted, "run_id").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pull).alias("pulls"), F.count_if(F.col("kind") == "load").alias("loads"), F.count_if(pull & F.col("source").eqNullSafe(F.col("__own"))).alias("fits")
    )
    rows = runs.join(per, "run_id", "left").fillna(0, ["n", "pulls", "loads", "fits"])
    hit = F.col("pulls") > 0
    return rows.groupBy(*arm).agg(F.count(F.lit(1)).alias("runs"), F.count_if(hit).alias("pulled"), F.count_if(F.col("loads") > 0).alias("loaded"), F.count_if(hit & (F.col("fits") == F.col("pulls"))).alias("right"), F.avg("n").alias("commands"))
