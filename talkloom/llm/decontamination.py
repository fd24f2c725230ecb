"""Benchmark decontamination by Wu-Manber search for windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talkloom.llm import shingles
from talkloom.llm.common import body, cut, drop_table, free

WINDOW = 10
#: Words of a block whose shift the tables know.
BLOCK = 2
#: The benchmark is searched in blocks of items whose texts take about so many bytes; their tables take some
#: ten times that, are built once and broadcast.
ITEM_BYTES = 4 << 20
#: Lower-cases A-Z; GAP tells the ASCII characters that are neither letter nor digit.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
GAP = np.array([not (b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
_MUL = np.uint64(0x9E3779B97F4A7C15)


def block_keys(words: np.ndarray, block: int) -> np.ndarray:
    """The key of the block of words that starts at each place."""
    return words if block == 1 else shingles.mixed(words[:-1] * _MUL + words[1:])


class WuManber:
    """Search tables for the windows of one number of words of some items, as arrays.

    keys and shift: by how much a window may move whose last block has that key.  Windows lie in buckets by
    the key of their last block, equal ones once: of bucket k, numbers low[k] to low[k + 1]; place is where
    a window starts in the items' words, and owners its items, of window w numbers of[w] to of[w + 1].
    """

    def __init__(self, length: int, words: shingles.Words, items: np.ndarray):
        self.length, self.block, self.words = length, min(BLOCK, length), words
        self.far = length - self.block + 1
        keys, shifts, places, owners = [], [], [], []
        for i in items:
            a, b = words.per[i], words.per[i + 1]
            k = block_keys(words.hash[a:b], self.block)
            shift = np.maximum(length - self.block - np.arange(len(k)), 0)
            last = np.flatnonzero(shift == 0)
            keys.append(k)
            shifts.append(shift)
            places.append(a + last + self.block - length)
            owners.append(np.full(len(last), i, np.int32))
        keys, shifts, places, owners = (np.concatenate(x) for x in (keys, shifts, places, owners))
        window = np.zeros(len(places), np.uint64)
        for j in range(length):
            window = shingles.mixed(window * _MUL + words.hash[places + j])
        ends = block_keys(words.hash, self.block)[places + length - self.block]
        order = np.lexsort((shifts, keys))
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        self.keys, self.shift = keys[order][first], shifts[order][first].astype(np.uint8 if length < 256 else np.int64)
        order = np.lexsort((owners, window, ends))
        ends, window, places, owners = ends[order], window[order], places[order], owners[order]
        distinct = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (ends[1:] != ends[:-1])]))
        self.place, self.owners, self.of = places[distinct].astype(np.int32), owners, np.append(distinct, len(owners))
        self.ends, self.low = np.unique(ends[distinct], return_index=True)
        self.low = np.append(self.low, len(distinct))

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def steps(self, words: np.ndarray) -> np.ndarray:
        """How far a window may move whose last block starts at each place."""
        keys = block_keys(words, self.block)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.shift[at], self.far)

    def same(self, place: int, text: shingles.Words, at: int) -> bool:
        """Whether the window of the items at `place` is at word `at` of the text, word by word."""
        own, n = self.words, self.length
        if not (own.hash[place : place + n] == text.hash[at : at + n]).all():
            return False
        for k in range(n):
            a, b = own.data[own.start[place + k] : own.end[place + k]], text.data[text.start[at + k] : text.end[at + k]]
            if len(a) != len(b) or not (a == FOLD[b]).all():
                return False
        return True

    def find(self, text: shingles.Words, steps: list[int], begin: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """(start, items) of each occurrence among words `begin` to `stop`."""
        size, block = self.length, self.block
        end = begin + size
        while end <= stop:
            step = steps[end - block]
            if step:
                end += step
                continue
            start = end - size
            key = block_keys(text.hash[end - block : end], block)[0]
            k = np.searchsorted(self.ends, key)
            if k < len(self.ends) and self.ends[k] == key:
                for w in range(self.low[k], self.low[k + 1]):
                    if self.same(self.place[w], text, start):
                        yield start, self.owners[self.of[w] : self.of[w + 1]]
            end += 1


def tables(texts: list[str], window: int = WINDOW) -> list[WuManber]:
    """One search table for each pattern length: windows of `window` words, and whole items of fewer."""
    words = next(shingles.text_groups(pa.array(texts, pa.string()), 1 << 62, GAP))
    words.data = FOLD[words.data]
    words.start, words.end = words.start.astype(np.int32), words.end.astype(np.int32)
    size = np.minimum(np.diff(words.per), window)
    return [WuManber(int(n), words, np.flatnonzero(size == n)) for n in np.unique(size[size > 0])]


def search(text: shingles.Words, found: list[WuManber]) -> tuple[np.ndarray, list[set]]:
    """Which words of a group of texts are hit, and of each text the numbers of the items of which a window occurs."""
    hit, items = np.zeros(len(text.hash), np.uint8), [set() for _ in range(len(text.per) - 1)]
    for table in found:
        steps = table.steps(text.hash).tolist() if len(text.hash) >= table.block else []
        for i, names in enumerate(items):
            for start, owners in table.find(text, steps, int(text.per[i]), int(text.per[i + 1])):
                hit[start : start + table.length] = 1
                names.update(owners.tolist())
    return hit, items


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list, list]]:
    """Identifiers (as strings) and texts in blocks of bounded size, streamed through the driver."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), body(text_col).alias("t")).where("t <> ''")
    names, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        names.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"])
        if size >= most:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The input's columns and behind them __n_words, __n_hit, __hits (bytes, 1 for a hit word), __items (sorted identifiers as strings).

    Each worker slides the Wu-Manber tables over the words of a whole text: the last block of words under
    the window tells how far it may move; at shift 0 the bucket of that block lists the windows that are
    compared word by word.  One pass over the rows for each block of items, written before the next, so a
    benchmark of any size is searched completely while tables and broadcasts stay bounded.  A table of an
    earlier block goes when the next stands, so there are two copies of the rows at most, and one at the end.

    Null and empty texts have no words; a text of any length is searched whole by one task.  Items without
    words are never found, items with a null identifier count as hits but are not listed, items that repeat
    an identifier count once.  Rows are judged alone, so repeats and null identifiers do no harm.  An empty
    benchmark hits nothing, an empty table stays empty.  The new columns get more underscores where the
    input has such names.
    """
    spark, kept = docs.sparkSession, docs.columns
    new = free(docs, "__n_words", "__n_hit", "__hits", "__items")
    rows = docs.withColumns({c: F.lit(None).cast(t) for c, t in zip(new, ("long", "long", "binary", "array<string>"), strict=True)})
    schema = rows.schema
    blocks = item_blocks(benchmark, item_id, item_text, item_bytes)
    block, follow = next(blocks, ([], [])), next(blocks, None)
    standing: DataFrame | None = None
    while block is not None:
        held = spark.sparkContext.broadcast((block[0], tables(block[1], window) if block[1] else []))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, found = held.value
            for batch in batches:
                done = 0
                old_hits, old_items = batch.column(len(kept) + 2), batch.column(len(kept) + 3)
                texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
                for text in shingles.text_groups(texts, gap=GAP):
                    hit, numbers = search(text, found)
                    n, n_hit, hits, items = [], [], [], []
                    for i, own in enumerate(numbers):
                        k = done + i
                        mine = hit[text.per[i] : text.per[i + 1]]
                        listed = {names[x] for x in own}
                        if old_hits[k].is_valid:  # from an earlier block of items
                            was = np.frombuffer(old_hits[k].as_py(), np.uint8)
                            mine = mine | was if len(was) else mine
                            listed |= set(old_items[k].as_py())
                        n.append(len(mine))
                        n_hit.append(int(mine.sum()))
                        hits.append(mine.tobytes() if n_hit[-1] else b"")
                        items.append(sorted(x for x in listed if x is not None))
                    made = [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
                    part = batch.slice(done, len(n))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=[*batch.schema.names])
                    done += len(n)

        rows = rows.mapInArrow(scan, schema)
        if follow is not None:
            rows = cut(rows, "contamination")
            if standing is not None:  # its rows stand in the new table
                drop_table(standing)
            standing = rows
        block, follow = follow, next(blocks, None)
    return rows


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = contamination(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, text_col="text", **options)
    return rows.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.col("__n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents no word of which is hit, with the columns of the input, whatever their names."""
    rows = contamination(docs, benchmark, **options)
    return rows.where(F.col(rows.columns[-3]) == 0).select(*docs.columns)
