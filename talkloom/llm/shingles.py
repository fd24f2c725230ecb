"""Words and word shingles of many texts at once as 64-bit hashes, MinHash signatures, exact comparison of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SHINGLE = 5
#: Per cent of the union that linked sets have in common at least.
LIKE = 75
#: Texts of about so many bytes are hashed together; a longer text is a group of its own.
GROUP_BYTES = 128 << 10
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A random odd number for each byte, A-Z like a-z.
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _weights(place: np.ndarray) -> np.ndarray:
    """An odd number for each place within a word."""
    return mixed((place.astype(np.uint64) + np.uint64(1)) * _MUL) | np.uint64(1)


_PLACES = _weights(np.arange(1 << 12))


@dataclass
class Words:
    """The words of some texts, one after another: runs of anything but ASCII white space, A-Z like a-z.

    start and end are places in data, hash is 64 bits of the word, text i has the words per[i] to per[i + 1]
    and the bytes bounds[i] to bounds[i + 1].
    """

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    per: np.ndarray

    def grams(self, size: int = SHINGLE) -> np.ndarray:
        """The hash of the shingle that starts at each word; where the text ends before, of what is left if that is the whole text, else of no meaning."""
        n = len(self.hash)
        padded = np.concatenate([self.hash, np.zeros(size - 1, np.uint64)])
        h = np.full(n, size, np.uint64)
        for j in range(size):
            h = mixed(h * _MUL + padded[j : n + j])
        count = np.diff(self.per)
        for i in np.flatnonzero((count > 0) & (count < size)):
            one = np.full(1, count[i], np.uint64)
            for k in range(self.per[i], self.per[i + 1]):
                one = mixed(one * _MUL + self.hash[k : k + 1])
            h[self.per[i]] = one[0]
        return h

    def shingled(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(hash, per): the shingles text by text; fewer words than `size` are one shingle, none are none."""
        count = np.diff(self.per)
        many = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
        here = np.arange(len(self.hash)) - np.repeat(self.per[:-1], count) < np.repeat(many, count)
        return self.grams(size)[here], np.concatenate([[0], np.cumsum(many)])


def split_words(data: np.ndarray, bounds: np.ndarray, gap: np.ndarray = SPACE) -> Words:
    """`gap` tells the bytes between words."""
    inside = ~gap[data]
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = bounds[full], bounds[full + 1] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(start):
        size = end - start
        at = np.cumsum(size) - size
        place = np.arange(at[-1] + size[-1]) - np.repeat(at, size)
        weight = _PLACES[place] if size.max() <= len(_PLACES) else _weights(place)
        code = mixed(np.add.reduceat(_BYTE[data[inside]] * weight, at))
    else:
        code = np.empty(0, np.uint64)
    return Words(data, bounds, start, end, code, np.searchsorted(start, bounds))


def text_groups(column: pa.Array | pa.ChunkedArray, most: int = GROUP_BYTES, gap: np.ndarray = SPACE) -> Iterator[Words]:
    """The words of a column of texts without nulls, in groups of whole texts."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        _, places, values = chunk.buffers()
        kind = np.int64 if pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type) else np.int32
        bounds = np.frombuffer(places, kind)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        data = np.frombuffer(values, np.uint8) if values else np.empty(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield split_words(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], gap)
            at = to


def of_text(text: str) -> Words:
    return next(text_groups(pa.array([text], pa.string())))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    return np.unique(of_text(text).shingled(size)[0])


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for words in text_groups(column):
        values, per = words.shingled(size)
        yield from (np.unique(values[per[i] : per[i + 1]]) for i in range(len(per) - 1))


class MinHash:
    """`count` 32-bit minima under multiply-shift hashing; multipliers follow from the seed."""

    def __init__(self, count: int, seed: int = 1):
        draw = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, (2, count), np.uint64)
        self.a, self.b = (draw[0] << np.uint64(1)) | np.uint64(1), draw[1]

    def of(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row of minima for each stretch of values that starts at `at`; none is empty."""
        low = [np.minimum.reduceat(a * values + b, at) for a, b in zip(self.a, self.b, strict=True)]
        return (np.column_stack(low) >> np.uint64(32)).astype(np.uint32)


def key_of(values: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return xxhash.xxh128_digest(values.tobytes())


def alike(a: bytes, b: bytes, like: int = LIKE) -> bool:
    """Exact Jaccard of two sets given as sorted 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    small, large = sorted((len(x), len(y)))
    if 100 * small < like * large:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= like * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, like: int = LIKE) -> DataFrame:
    """The pairs (a, b) whose sets (key, values) are alike."""
    first = pairs.join(sets.selectExpr("key as a", "values as va"), "a")
    both = first.join(sets.selectExpr("key as b", "values as vb"), "b").select("a", "b", "va", "vb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = batch.column(2), batch.column(3)
            keep = [alike(va[i].as_buffer(), vb[i].as_buffer(), like) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a binary, b binary")


def sharing(sets: DataFrame, put, like: int = LIKE) -> DataFrame:
    """Pairs (a, b) of sets (key, part, values) of other parts that could be alike; none that is alike is missing.

    Each set is read from its rarest shingle on.  The smaller of two sets alike has one of its first
    n - ceil(2 l n / (1 + l)) + 1 shingles among the larger one's first n - ceil(l n) + 1, l being `like`: where
    many sets share what is too little to be alike, their first shingles are their own, and they do not meet.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(2)]
            for at in range(0, len(values), 256):
                some = values[at : at + 256]
                sizes = np.array([len(v) for v in some])
                row = pa.array(np.repeat(np.arange(at, at + len(some)), sizes))
                arrays = [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(some))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "part", "n", "gram"])

    grams = put(sets.select("key", "part", "values").mapInArrow(spread, "key binary, part long, n long, gram long"), "sharing-grams")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = grams.join(often, "gram").groupBy("key", "part", "n").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("shared"))
    # shingles of one set only come first and meet nothing
    shared = shared.withColumn("own", F.col("n") - F.size("shared")).withColumn("first", F.col("n") - F.ceil(F.col("n") * like / 100) + 1)
    met = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("first") - F.col("own")).cast("int"))
    rows = shared.select("key", "part", "n", "own", F.posexplode(met).alias("pos", "x")).select("key", "part", "n", (F.col("own") + F.col("pos")).alias("at"), "x.gram")
    # written tables on both sides let Spark split the join where many sets have one shingle
    large = put(rows, "sharing-first")
    small = large.where(F.col("at") < F.col("n") - F.ceil(F.col("n") * 2 * like / (100 + like)) + 1)
    small = put(small.select("gram", *[F.col(c).alias(f"{c}_s") for c in ("key", "part", "n", "at")]), "sharing-small")
    left = F.least(F.col("n") - F.col("at"), F.col("n_s") - F.col("at_s"))
    could = (F.col("part") != F.col("part_s")) & (F.col("n_s") <= F.col("n")) & (100 * F.col("n_s") >= like * F.col("n"))
    could &= left * (100 + like) >= like * (F.col("n") + F.col("n_s"))
    pairs = small.join(large, "gram").where(could)
    return pairs.select(F.least("key", "key_s").alias("a"), F.greatest("key", "key_s").alias("b")).distinct()
