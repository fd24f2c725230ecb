"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talkloom.llm.common import CLEAN, body, cut, settings
from talkloom.llm.shingles import mixed

LENGTH = 400
#: Order of the field behind the difference cover; its period is ORDER ** 2 + ORDER + 1.
ORDER = 17
PERIOD = ORDER * ORDER + ORDER + 1
#: Bytes of the sample suffixes that are ranked: what is left of LENGTH after the largest shift.
TAIL = LENGTH - PERIOD + 1
#: Text bytes of a block of documents, and ranked suffixes of a suffix bucket.
BLOCK_BYTES, BUCKET_ROWS = 8 << 20, 1 << 20
#: Files of the table of blocks; beyond so many blocks a file holds several, which are still read one at a time.
MOST_FILES = 50_000
#: Groups of suffix buckets that are sorted one after another.
ROUNDS = 2
SEGMENT = 1 << 20
_rng = np.random.Generator(np.random.PCG64(400))
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 5
_powers: dict[int, np.ndarray] = {}
#: The second hash of a tied window: two polynomials over a prime field with bases of their own.
PRIME = (1 << 31) - 1
FIELD_BASES = tuple(int(b) for b in _rng.integers(1 << 20, PRIME - 1, 2))
_FIELD_BYTE = _rng.permutation(1 << 20)[:256].astype(np.uint64) + np.uint64(1)
_field_powers: dict[int, np.ndarray] = {}


def difference_cover() -> np.ndarray:
    """Residues modulo PERIOD of which every difference modulo PERIOD occurs: a line of the projective plane.

    Powers of a generator of the cubic extension of the field of ORDER elements run through the plane's
    points with period PERIOD; those on one line form the cover.
    """
    q = ORDER
    for a in range(q):
        for b in range(q):
            for c in range(1, q):  # x^3 = a x^2 + b x + c
                x, line, seen = (1, 0, 0), [], set()
                for i in range(PERIOD):
                    lead = next(v for v in x if v)
                    point = tuple(v * pow(lead, -1, q) % q for v in x)
                    if point in seen:
                        break
                    seen.add(point)
                    if x[2] == 0:
                        line.append(i)
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                else:
                    if len({(i - j) % PERIOD for i in line for j in line}) == PERIOD:
                        return np.array(line)
    raise AssertionError("no generator")


COVER = difference_cover()


def powers(base: int) -> np.ndarray:
    if base not in _powers:
        out = np.empty(SEGMENT + LENGTH + 1, np.uint64)
        out[0] = 1
        done = 1
        while done < len(out):  # doubling: the next stretch is the first one times base ** done
            step = np.uint64(pow(base, done, 1 << 64))
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * step
            done += more
        _powers[base] = out
    return _powers[base]


def window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the windows of `length` bytes at sorted positions, segment by segment."""
    up, down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
    out = np.empty(len(at), np.uint64)
    for low in range(0, len(data), SEGMENT):
        i, j = np.searchsorted(at, (low, low + SEGMENT))
        if i < j:
            part = data[low : low + SEGMENT + length]
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=run[1:])
            q = at[i:j] - low
            out[i:j] = mixed((run[q + length] - run[q]) * down[q])
    return out


def field_powers(base: int) -> np.ndarray:
    if base not in _field_powers:
        out = np.ones(SEGMENT + LENGTH + 1, np.uint64)
        done = 1
        while done < len(out):
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
            done += more
        _field_powers[base] = out
    return _field_powers[base]


def sure_keys(data: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of the LENGTH bytes at sorted positions that stand for their first hash and two more of another kind.

    Different bytes agree in one polynomial over the field for at most LENGTH - 1 of its PRIME bases, whatever they hold.
    """
    out, p = first.copy(), np.uint64(PRIME)
    for low in range(0, len(data), SEGMENT):
        i, j = np.searchsorted(at, (low, low + SEGMENT))
        if i == j:
            continue
        part = _FIELD_BYTE[data[low : low + SEGMENT + LENGTH]]
        q = at[i:j] - low
        run = np.zeros(len(part) + 1, np.uint64)
        for base in FIELD_BASES:
            up, down = field_powers(base), field_powers(pow(base, -1, PRIME))
            np.cumsum(part * up[: len(part)] % p, out=run[1:])  # a segment's sum is below 2 ** 52
            out[i:j] = mixed(out[i:j] ^ ((run[q + LENGTH] - run[q]) % p * down[q] % p))
    return out


def sample_positions(n: int) -> np.ndarray:
    """Cover positions of a text of n bytes whose ranked part fits."""
    if n < LENGTH:
        return np.empty(0, np.int64)
    all_ = (np.arange(0, n, PERIOD)[:, None] + COVER[None, :]).ravel()
    return all_[all_ <= n - TAIL]


def candidate_positions(n: int, anchors: np.ndarray) -> np.ndarray:
    """Starts of whole windows that hold a repeated sample suffix within their first PERIOD bytes."""
    last = n - LENGTH
    if last < 0 or not len(anchors):
        return np.empty(0, np.int64)
    edge = np.zeros(last + 2, np.int32)
    low = np.clip(anchors - PERIOD + 1, 0, last + 1)
    high = np.clip(anchors + 1, 0, last + 1)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    return np.flatnonzero(np.cumsum(edge[: last + 1]) > 0)


def is_in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def coded(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and upper half of each key."""
    return (values % np.uint64(buckets)) << np.uint64(32) | values >> np.uint64(32)


def fragments(block: int, hashes: list[np.ndarray], buckets: int, *, half: bool = False) -> pa.RecordBatch:
    """One row per suffix bucket: the block's distinct keys, sorted, and which occur more than once in the block; only their upper halves if asked for."""
    values, times = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.empty(0, np.uint64), np.empty(0, int))
    home = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    values, times, home = values[order], times[order], home[order]
    values = (values >> np.uint64(32)).astype(np.uint32) if half else values
    names, first = np.unique(home, return_index=True)
    ends = [*first[1:], len(home)][: len(first)]
    rows = [(int(b), block, values[i:j].tobytes(), (times[i:j] > 1).astype(np.uint8).tobytes()) for b, i, j in zip(names, first, ends, strict=True)]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "keys", "again"])


FRAGMENT = "bucket long, block long, keys binary, again binary"


def repeated(rows: DataFrame, *, half: bool = False) -> DataFrame:
    """(block, keys): of each block's keys those that occur anywhere else; one suffix bucket is sorted at a time.

    Of upper halves those that occur nowhere else, as coded() keys.
    """

    def sort(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_buffer(), np.uint32 if half else np.uint64) for k in table.column("keys")]
        again = np.concatenate([np.frombuffer(k.as_buffer(), np.uint8) for k in table.column("again")])
        joined = np.concatenate(keys)
        order = np.argsort(joined, kind="stable")
        ranked = joined[order]
        same = ranked[1:] == ranked[:-1]
        ties = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (again[order] > 0)
        hit = np.empty(len(joined), bool)
        hit[order] = ties ^ half
        at, out = 0, []
        for block, k in zip(table.column("block").to_pylist(), keys, strict=True):
            mine = k[hit[at : at + len(k)]]
            at += len(k)
            if len(mine):
                mine = np.uint64(table.column("bucket")[0].as_py() << 32) | mine.astype(np.uint64) if half else mine
                out.append((block, mine.tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["block", "keys"])

    return rows.groupBy("bucket").applyInArrow(sort, "block long, keys binary")


def keys_of(table: pa.Table, kind: str) -> np.ndarray:
    if not table.num_rows:  # the empty side of a cogroup has no columns either
        return np.empty(0, np.uint64)
    got = [np.frombuffer(k.as_buffer(), np.uint64) for k, c in zip(table.column("keys"), table.column("kind").to_pylist(), strict=True) if c == kind]
    return np.sort(np.concatenate(got)) if got else np.empty(0, np.uint64)


def runs_of(n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of bytes covered by windows at sorted starts."""
    if not len(starts):
        return starts, starts
    cut_ = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH)
    return starts[np.concatenate([[0], cut_ + 1])], starts[np.concatenate([cut_, [len(starts) - 1]])] + LENGTH


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes).

    A byte goes if a string of LENGTH bytes over it also starts elsewhere, in any text.

    1. Equal texts are one text with a count.  Texts lie in blocks, a table bucketed by block.
    2. Sample suffixes at difference-cover positions are ranked by their first TAIL bytes: each block
       sends its distinct keys to suffix buckets, each bucket is sorted alone, ties go back to the blocks.
       Two equal strings of LENGTH bytes have a cover position at one common shift, so both hold a tie.
    3. Only suffixes with a tied sample within PERIOD bytes are still open.  They are keyed by their
       LENGTH bytes and sorted bucket by bucket, in ROUNDS groups of buckets one after another.
    4. Suffixes that tie in step 3 meet once more, in the bucket and by the upper half of a key that stands for three
       hashes of their bytes, two of them over a prime field.  Those that then stand alone had a false tie and stay.
    A block sends each key once, so a string that a third of all texts hold costs a bucket one row per
    block.  A block's keys for one bucket are one row, so the rows sent never outnumber the keys.  Keys are
    64-bit hashes of the bytes; a false tie needs two equal hashes in step 3.

    Null texts are empty; texts shorter than LENGTH lose nothing; a text of any length lies in one block,
    whose task holds it whole.  Rows that repeat an identifier count
    as texts of their own; null identifiers are kept.  Empty tables stay empty.  Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    slim = cut(rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "suffix-rows")
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    with block_table(rows.where(F.octet_length("text") >= LENGTH), total) as texts:
        return cut(_repeated_in(texts, total, slim), "suffix-result")


@contextmanager
def block_table(rows: DataFrame, total: int) -> Iterator[DataFrame]:
    """Distinct texts (sha, text, copies, first_id) as a table bucketed by block, gone afterwards.

    Copies meet before the shuffle, so a text that a third of the rows hold is one row per task.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, math.ceil(total / BLOCK_BYTES))
    files = min(MOST_FILES, blocks)
    name = f"blocks_{uuid.uuid4().hex}"
    each = rows.groupBy(F.sha2("text", 256).alias("sha"))
    distinct = each.agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    placed = distinct.withColumn("block", F.pmod(F.xxhash64("sha"), F.lit(blocks)))
    with settings(spark, **CLEAN):
        placed.repartition(files, "block").write.bucketBy(files, "block").format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _repeated_in(texts: DataFrame, total: int, slim: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(total * len(COVER) / PERIOD / BUCKET_ROWS))

    def sample(table: pa.Table) -> pa.Table:
        hashes = []
        for text in table.column("text"):
            data = np.frombuffer(text.as_py().encode(), np.uint8)
            hashes.append(window_hashes(data, sample_positions(len(data)), TAIL))
        return pa.Table.from_batches([fragments(table.column("block")[0].as_py(), hashes, buckets)])

    ties = cut(repeated(texts.groupBy("block").applyInArrow(sample, FRAGMENT)).withColumn("kind", F.lit("sample")), "suffix-ties")

    def opened(data: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = sample_positions(len(data))
        at = candidate_positions(len(data), at[is_in(window_hashes(data, at, TAIL), anchors)])
        return at, window_hashes(data, at, LENGTH)

    def suffixes_of(turn: int):
        def suffixes(table: pa.Table, known: pa.Table) -> pa.Table:
            anchors, hashes = keys_of(known, "sample"), []
            for text in table.column("text") if table.num_rows and len(anchors) else ():
                _, keys = opened(np.frombuffer(text.as_py().encode(), np.uint8), anchors)
                hashes.append(keys[(keys >> np.uint64(40)) % np.uint64(ROUNDS) == turn])
            return pa.Table.from_batches([fragments(table.column("block")[0].as_py() if table.num_rows else 0, hashes, buckets)])

        return suffixes

    found = ties
    for turn in range(ROUNDS):
        open_ = texts.groupBy("block").cogroup(ties.groupBy("block")).applyInArrow(suffixes_of(turn), FRAGMENT)
        found = found.union(cut(repeated(open_).withColumn("kind", F.lit("whole")), f"suffix-found-{turn}"))

    def tied(data: np.ndarray, anchors: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, keys = opened(data, anchors)
        hit = is_in(keys, whole)
        return at[hit], keys[hit]

    def confirm(table: pa.Table, known: pa.Table) -> pa.Table:
        anchors, whole, hashes = keys_of(known, "sample"), keys_of(known, "whole"), []
        for text in table.column("text") if table.num_rows and len(whole) else ():
            data = np.frombuffer(text.as_py().encode(), np.uint8)
            hashes.append(sure_keys(data, *tied(data, anchors, whole)))
        return pa.Table.from_batches([fragments(table.column("block")[0].as_py() if table.num_rows else 0, hashes, buckets, half=True)])

    met = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(confirm, FRAGMENT)
    found = found.union(cut(repeated(met, half=True).withColumn("kind", F.lit("false")), "suffix-false"))

    def remove(table: pa.Table, known: pa.Table) -> pa.Table:
        anchors, whole, false = (keys_of(known, kind) for kind in ("sample", "whole", "false"))
        out = []
        for sha, text, copies in zip(table.column("sha").to_pylist(), table.column("text"), table.column("copies").to_pylist(), strict=True):
            raw = text.as_py().encode()
            if copies > 1:
                out.append((sha, [0], [len(raw)], hashlib.sha256(b"").hexdigest()))
                continue
            data = np.frombuffer(raw, np.uint8)
            at, keys = tied(data, anchors, whole)
            if len(false):  # a first hash that different bytes share
                at = at[~is_in(coded(sure_keys(data, at, keys), buckets), false)]
            start, end = runs_of(len(raw), at)
            if len(start):
                kept = b"".join(raw[i:j] for i, j in zip([0, *end], [*start, len(raw)], strict=True))
                out.append((sha, start.tolist(), end.tolist(), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["sha", "starts", "ends", "kept"])

    removed = texts.select("block", "sha", "text", "copies").groupBy("block").cogroup(found.groupBy("block"))
    removed = removed.applyInArrow(remove, "sha string, starts array<long>, ends array<long>, kept string")
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    removed = removed.select("sha", spans.alias("spans"), "kept")
    lost = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]), F.lit(0))
    return slim.join(removed, "sha", "left").select(
        "doc_id", "n_bytes", lost.cast("long").alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"), "spans",
    )
