"""Sessions last seen: at most one record in half a minute for each, the newest 200 of all."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkloom.operators.walks import walk

#: Milliseconds within which a session is not recorded again; and after which its state goes.
QUIET_MS, STATE_MS = 30_000, 7 * 86_400_000
KEEP = 200
RECORD = "at bigint, mode string, cwd string"


def _step(state: list, at: int, mode: str | None, cwd: str | None, has_file: bool | None) -> tuple | None:
    """The record of a request, or None while the session is quiet.  state: time, mode and folder recorded last."""
    before = state[0]
    wants = has_file is True and not state[2]
    if before is not None and state[1] == mode and not wants and at - before < QUIET_MS:
        return None
    state[:] = [at, mode, state[2] or (cwd if has_file is True else None)]
    return at, mode, state[2]


def recorded(rows: DataFrame) -> DataFrame:
    """(session, at, mode, cwd) of the requests (session, at in ms, mode, cwd, has_file) that are recorded.

    A session is recorded when it is new, its mode changed, it has a file but no folder yet, or half a minute
    has gone since its last record.  Rows are taken by time; null sessions are one session.
    """
    text = lambda c: F.col(c)
    return walk(rows, key="session", order="at", values={c: text(c) for c in ("mode", "cwd", "has_file")}, start=lambda: [None, None, None], step=_step, schema=RECORD)


class Recorder(StatefulProcessor):
    """One value for each session, which goes by its time to live."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, mode string, cwd string", ttlDurationMs=STATE_MS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = list(self.last.get()) if self.last.exists() else [None, None, None]
        known = lambda x: None if x is None or pd.isna(x) else x
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        out = []
        for at, mode, cwd, has_file in frame[["at", "mode", "cwd", "has_file"]].itertuples(index=False, name=None):
            made = _step(state, int(at), known(mode), known(cwd), known(has_file) in (True, 1))
            if made:
                out.append((key[0], *made))
        if out:
            self.last.update(tuple(state))
        yield pd.DataFrame(out, columns=["session", "at", "mode", "cwd"])

    def close(self) -> None:
        pass


def recorded_stream(rows: DataFrame) -> DataFrame:
    """recorded() over a stream, with the state store that keeps times to live (RocksDB)."""
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=Recorder(), outputStructType=f"session string, {RECORD}", outputMode="Append", timeMode="ProcessingTime")


def newest(records: DataFrame, keep: int = KEEP) -> DataFrame:
    """The last record of each of the `keep` sessions seen last, ties by session."""
    last = records.groupBy("session").agg(F.max(F.struct("at", "mode", "cwd")).alias("r"))
    return last.select("session", "r.*").orderBy(F.desc("at"), F.asc_nulls_last("session")).limit(keep)


def keep_newest(records: DataFrame, path: str, checkpoint: str, keep: int = KEEP):
    """A sink that holds newest() of all batches as path/version=N: `keep` rows at most are read and written for each batch.

    A repeated batch reads the version before its own and writes its own again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("session", "at", "mode", "cwd")
        if number:
            rows = rows.union(spark.read.schema(rows.schema).parquet(f"{path}/version={number - 1}"))
        newest(rows, keep).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
