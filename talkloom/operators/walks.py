"""Rules that feed back into themselves along the ordered rows of a key: Spark sorts, a small carried state walks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def walk(rows: DataFrame, *, key: str, order: str, values: dict[str, Column], start: Callable[[], list], step: Callable[..., tuple | None], schema: str, finish: Callable[[list], list[tuple]] | None = None) -> DataFrame:
    """Rows that `step(state, order, *values)` gives along each key, and those of `finish(state)` at its end, led by the key.

    schema: the columns behind the key.  Rows are partitioned by key and sorted within partitions; batches
    pass through and only the state of one key is alive, so a key of any number of rows needs no more memory.
    Ties of the order follow the values.  Null keys are one key; no rows give no rows.
    """
    names = list(values)
    lean = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), *[c.alias(n) for n, c in values.items()])
    sorted_ = lean.repartition("k").sortWithinPartitions("k", "o", *names)
    columns = [key, *[c.split()[0] for c in schema.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, None
        for frame in frames:
            out = []
            null = frame["k"].isna().to_numpy()
            for missing, r in zip(null, frame.itertuples(index=False, name=None), strict=True):
                now = (missing, None if missing else r[0])
                if now != here:
                    if here is not None and finish:
                        out += [(here[1], *x) for x in finish(state)]
                    here, state = now, start()
                made = step(state, *r[1:])
                if made is not None:
                    out.append((now[1], *made))
            yield pd.DataFrame(out, columns=columns)
        if here is not None and finish:
            yield pd.DataFrame([(here[1], *x) for x in finish(state)], columns=columns)

    kind = lean.schema["k"].dataType.simpleString()
    return sorted_.mapInPandas(run, f"`{key}` {kind}, {schema}")
