"""Structured Streaming: request-log state per thread, session last-seen, windows over events, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkloom.operators.usage import COMPACT_AT, SUMMARY_TOKENS


def compaction_alerts(rows: DataFrame) -> DataFrame:
    """(thread, seq, hit) as a stream: the resetting offset of each thread lives in keyed state.

    rows: thread, seq, plain, fixed, window.  Rows of one thread are ordered inside a batch by seq; state
    is one number per thread and goes after a day without rows.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        offset = state.get[0] if state.exists else 0.0
        frame = pd.concat(list(frames)).sort_values("seq")
        hits = []
        for r in frame.itertuples(index=False):
            hit = r.plain - offset > COMPACT_AT * r.window
            offset = r.plain - (0.0 if pd.isna(r.fixed) else r.fixed) - SUMMARY_TOKENS if hit else offset
            hits.append(hit)
        state.update((float(offset),))
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame({"thread": key[0], "seq": frame["seq"].to_numpy(), "hit": hits})

    return rows.groupBy("thread").applyInPandasWithState(run, "thread string, seq long, hit boolean", "offset double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def last_seen(rows: DataFrame) -> DataFrame:
    """Per session its last row's time and count; a plain aggregate in update mode, no custom state."""
    session = F.regexp_replace("thread", "-[0-9a-f]{24}$", "")
    return rows.groupBy(session.alias("session")).agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("requests"))


def tumbling(events: DataFrame, *, at: str, width: str, late: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Windowed aggregates with a watermark; the same plan runs in batch."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(*aggregates)
    return rows.select(F.col("window.start").alias("window_start"), *keys, *[c for c in rows.columns if c not in ("window", *keys)])


def sessions(events: DataFrame, *, at: str, gap: str, late: str, key: str, aggregates: list[Column]) -> DataFrame:
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(*aggregates)
    return rows.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in rows.columns if c not in ("session_window", key)])


def write_once(stream: DataFrame, path: str, checkpoint: str, key: list[str], *, at: str, late: str = "1 day"):
    """A sink that takes each key once: a repeated batch overwrites its own folder, keys repeated within `late` of each other's time `at` are dropped by state, which goes behind the watermark."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_watch(misses: Column, alive: Column, most: int = 2) -> Column:
    """Liveness: (misses, action) after one probe; `most` misses in a row pause, an answer resumes."""
    now = F.when(alive, 0).otherwise(misses + 1)
    return F.struct(now.alias("misses"), F.when(alive & (misses >= most), "resume").when(~alive & (now == most), "pause").otherwise("none").alias("action"))
