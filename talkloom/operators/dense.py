"""Blocks of vectors and the products between them: helpers that run inside tasks of the dense search."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vectors of one block; rows of one product; pairs that are looked at one by one at a time.
BLOCK, STRIP, PAIRS = 4096, 1024, 50_000
PLACES = 5
#: What a score may lose by rounding, and by the order of sums of a product, relative to the lengths of the vectors.
ROUNDING, SLACK = 1.01 * 10.0**-PLACES, 1e-12


def rounded(x: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Half up by the shortest decimal form, as Spark's round: near a half the decimal form decides."""
    scaled = np.abs(x) * 10.0**places
    whole = np.floor(scaled)
    out = np.copysign(np.where(scaled < 2.0**52, np.floor(scaled + 0.5), scaled) / 10.0**places, x)
    unit = Decimal(1).scaleb(-places)
    with np.errstate(invalid="ignore"):
        close = np.isfinite(x) & (np.abs(scaled - whole - 0.5) < 1e-3 + scaled * 1e-15)
    for i in np.flatnonzero(close):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP)) if scaled[i] < 2.0**52 else x[i]
    return out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vec) as rows (ids, width, bytes) of at most BLOCK vectors of one width; width -1 holds those that have no product: null ones and ones with a null."""
    for batch in batches:
        ids, vecs = batch.column(0), batch.column(1)
        flat = vecs.flatten()
        kind = flat.type.to_pandas_dtype()
        width = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if flat.null_count:
            width[np.unique(pc.list_parent_indices(vecs).filter(flat.is_null()).to_numpy())] = -1
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            for at in range(0, len(of), BLOCK):
                some = pa.array(of[at : at + BLOCK])
                data = vecs.take(some).flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes() if w > 0 else b""
                yield pa.RecordBatch.from_arrays([pa.array([ids.take(some).to_pylist()], pa.list_(ids.type)), pa.array([w], pa.int32()), pa.array([data], pa.binary())], names=["ids", "width", "data"])


class _Best:
    """The best k rows of each query of one block: by falling rounded score (not a number first, none last), ties by key."""

    def __init__(self, ids: pa.Array, vecs: np.ndarray, k: int):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.floor = np.full(len(ids), -np.inf)
        self.full = np.zeros(len(ids), dtype=bool)
        self.rows: pa.Table | None = None

    def add(self, query: np.ndarray, keys: pa.Array, score: np.ndarray, order: np.ndarray) -> None:
        score = pa.array(score, mask=np.isneginf(order))
        rows = pa.table({"query": query, "order": order, "key": keys, "score": score})
        rows = pa.concat_tables([self.rows, rows]) if self.rows is not None else rows
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("order", "descending"), ("key", "ascending")]))
        query = rows["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.rows = rows.filter(pa.array(place < self.k))
        last = place == self.k - 1
        self.floor[query[last]], self.full[query[last]] = rows["order"].to_numpy()[last], True


def _orders(score: np.ndarray) -> np.ndarray:
    most = np.finfo(float).max
    return np.where(np.isnan(score), np.inf, np.clip(rounded(score), -most, most))


def _meet(best: _Best, keys: pa.Array, vecs: np.ndarray | None) -> None:
    """Let the rows of a block compete for the places of a query block; a product of blocks leaves few pairs, which are summed one by one."""
    n = len(best.ids)
    mine, theirs = (np.asarray(pc.dictionary_encode(pa.chunked_array([keys, best.ids.cast(keys.type)]).combine_chunks()).indices)[s] for s in (slice(0, len(keys)), slice(len(keys), None)))
    for at in range(0, len(keys), STRIP):
        own = mine[at : at + STRIP]
        if vecs is None:
            near = np.full((n, len(own)), -np.inf)
            margin = np.zeros(n)
        else:
            strip = vecs[at : at + STRIP]
            with np.errstate(all="ignore"):
                near = best.vecs @ strip.T
                size = np.linalg.norm(best.vecs, axis=1) * (np.linalg.norm(strip, axis=1).max() if strip.size else 0.0)
            near[np.isnan(near)] = np.inf
            margin = ROUNDING + SLACK * np.where(np.isfinite(size), size, np.inf)
        near[theirs[:, None] == own[None, :]] = np.nan  # a row is not its own neighbour
        with np.errstate(invalid="ignore"):
            sure = np.isfinite(margin)
            floor = np.where(best.full & sure, best.floor - margin, -np.inf)
            # rows without a product only count while places are free
            hit = near >= floor[:, None] if vecs is not None else ~np.isnan(near) & ~(best.full & ~np.isneginf(best.floor))[:, None]
            if hit.sum() > 4 * best.k * n and near.shape[1] > best.k:
                low = np.partition(np.where(np.isnan(near), -np.inf, near), near.shape[1] - best.k, axis=1)[:, near.shape[1] - best.k]
                hit &= near >= np.where(sure, low - margin, -np.inf)[:, None]
        query, row = np.nonzero(hit)
        for lo in range(0, len(query), PAIRS):
            q, r = query[lo : lo + PAIRS], row[lo : lo + PAIRS]
            if vecs is None:
                score = order = np.full(len(q), -np.inf)
            else:
                with np.errstate(all="ignore"):
                    products = best.vecs[q] * strip[r]
                    score = np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(q))
                order = _orders(score)
            better = ~best.full[q] | (order >= best.floor[q])
            best.add(q[better], keys.take(pa.array(at + r[better])), score[better], order[better])


def searched(k: int, kind: str, names: list[str]):
    """Function over batches (block, query_ids, query_width, query_data, ids, width, data): at the end (query, key, score) of each query's best k rows of the task."""

    def matrix(width: int, data: bytes) -> np.ndarray | None:
        return np.frombuffer(data, dtype=kind).reshape(-1, width).astype(float) if width > 0 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, _Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, query_ids, query_width, query_data, ids, width, data = (c[i] for c in batch.columns)
                which = block.as_py()
                if which not in states:
                    vecs = matrix(query_width.as_py(), query_data.as_py())
                    states[which] = _Best(query_ids.values, np.zeros((len(query_ids.values), 0)) if vecs is None else vecs, k)
                vecs, best = matrix(width.as_py(), data.as_py()), states[which]
                if width.as_py() == 0 == query_width.as_py():
                    vecs = np.zeros((len(ids.values), 0))  # the product of nothing is 0
                _meet(best, ids.values, vecs if width.as_py() == query_width.as_py() else None)
        for best in states.values():
            if best.rows is not None and best.rows.num_rows:
                rows = best.rows
                made = pa.table({"query": best.ids.take(rows["query"].combine_chunks()), "key": rows["key"], "score": rows["score"]}).rename_columns(names)
                yield from made.combine_chunks().to_batches(max_chunksize=10_000)

    return run
