"""Repeated passages by MinHash banding of paragraphs, confirmed on their shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talkloom.llm import near, shingles, suffixes
from talkloom.llm.common import body, components, cut, drop_table, extended, scratch

#: A pair of similarity 0.75 meets in no band with probability (1 - 0.75 ** 2) ** 6 = 0.7 %; a passage has several paragraphs.
BANDS, ROWS = 6, 2
#: A paragraph ends at the first sentence or cut that brings it to MIN_WORDS words; cuts are near enough that it has at most MAX_WORDS.
MIN_WORDS, MAX_WORDS = 16, 64
#: Words between two cuts at most: before them lie less than MIN_WORDS words of a paragraph, at the text's end behind them too.
STRETCH = MAX_WORDS // 2
#: Starts lie at least so many words apart; then paragraphs of one text that drift from word to word are never alike (LIKE).
APART = 4
ENDS = np.zeros(256, bool)
ENDS[list(b".!?")] = True


def closing(words: shingles.Words) -> np.ndarray:
    """Whether a sentence or a line ends behind each word."""
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])
    behind = np.append(words.start[1:], len(words.data))
    ends = np.minimum(behind, np.repeat(words.bounds[1:], np.diff(words.per)))
    return ENDS[words.data[words.end - 1]] | (lines[ends] > lines[words.end])


def lowest(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of sorted places `at`, those with the smallest hash among the places less than APART words away, the first of equals."""
    keep = np.ones(len(at), bool)
    for o in range(1, APART):
        near = at[o:] - at[:-o] < APART
        keep[:-o] &= ~near | (h[at[:-o]] <= h[at[o:]])
        keep[o:] &= ~near | (h[at[o:]] < h[at[:-o]])
    return at[keep]


def cuts_in(words: shingles.Words, closes: np.ndarray) -> np.ndarray:
    """Word numbers at which paragraphs start and end: both ends of each text among them, no two further apart than STRETCH.

    Cuts lie behind sentence and line ends, of ends less than APART words apart at the one of smallest hash of
    the two words that follow.  Longer stretches are cut where that hash is smallest among its neighbours, so
    a passage has the same cuts wherever it stands; what is still too long (repeated words) is cut evenly.
    Cuts within a text stay APART words away from its ends, so the texts around it change nothing.
    """
    per, n = words.per, len(words.hash)
    after = np.append(words.hash[1:], np.uint64(0))
    tails = per[1:][np.diff(per) > 0] - 1
    after[tails] = 0
    h = shingles.mixed(words.hash * np.uint64(3) + after)

    def inside(at: np.ndarray, borders: np.ndarray) -> np.ndarray:
        home = np.searchsorted(borders, at, "right") - 1
        return (at - borders[home] >= APART) & (borders[np.minimum(home + 1, len(borders) - 1)] - at >= APART)

    borders = np.unique(per)
    ends = np.flatnonzero(closes) + 1
    ends = lowest(h, ends[inside(ends, borders)])
    cuts = np.union1d(borders, ends)
    wide = np.diff(cuts) > STRETCH
    if wide.any():
        inner = lowest(h, np.arange(n))
        inner = inner[wide[np.searchsorted(cuts, inner, "right") - 1] & inside(inner, cuts)]
        cuts = np.union1d(cuts, inner)
        gap = np.diff(cuts)
        more = [cuts[i] + gap[i] * np.arange(1, -(-gap[i] // STRETCH)) // -(-gap[i] // STRETCH) for i in np.flatnonzero(gap > STRETCH)]
        cuts = np.union1d(cuts, np.concatenate(more)) if more else cuts
    return cuts


def paragraphs_in(words: shingles.Words) -> tuple[np.ndarray, np.ndarray]:
    """Paragraphs as [first, last) word numbers, in which every word of each text of MIN_WORDS words lies.

    One starts at each cut and ends at the first cut, sentence or line end MIN_WORDS words on, but not before
    the next cut, so they may overlap; a text's last one runs on to its end.
    """
    none = np.empty(0, np.int64)
    if not len(words.hash):
        return none, none
    closes = closing(words)
    cuts = cuts_in(words, closes)
    ends = words.per[np.searchsorted(words.per, cuts[:-1], "right")]
    fit = np.flatnonzero(cuts[:-1] + MIN_WORDS <= ends)
    if not len(fit):
        return none, none
    first, ends = cuts[fit], ends[fit]
    stops = np.union1d(cuts, np.flatnonzero(closes) + 1)
    last = np.maximum(stops[np.searchsorted(stops, first + MIN_WORDS)], cuts[fit + 1])
    final = np.append(ends[1:] != ends[:-1], True) & (last < ends)
    first, last = np.concatenate([first, first[final]]), np.concatenate([last, ends[final]])
    order = np.lexsort((last, first))
    return first[order], last[order]


class Paragraphs:
    """The paragraphs of a group of texts with band hashes: first and last word, text, bands, place in a band."""

    def __init__(self, words: shingles.Words, hashing: shingles.MinHash):
        self.words = words
        self.first, self.last = paragraphs_in(words)
        self.text = np.searchsorted(words.per, self.first, "right") - 1
        self.grams = words.grams()
        if len(self.first):
            grams = np.append(self.grams, self.grams[-1:])
            at = np.column_stack([self.first, self.last - shingles.SHINGLE + 1]).ravel()
            low = [np.minimum.reduceat(a * grams + b, at)[::2] for a, b in zip(hashing.a, hashing.b, strict=True)]
            self.bands = np.column_stack([shingles.mixed(low[i] * np.uint64(31) + low[i + 1] + np.uint64(i)) for i in range(0, BANDS * ROWS, ROWS)])
            # further values order the members of a band: paragraphs alike are near each other
            self.place = sum((low[i] >> np.uint64(32) & np.uint64(0xFFFF)) << np.uint64(16 * k) for k, i in enumerate((10, 7, 4, 1)))
        else:
            self.bands, self.place = np.empty((0, BANDS), np.uint64), np.empty(0, np.uint64)

    def counted(self) -> np.ndarray:
        """The band hashes, once for each text, and once more where paragraphs that do not overlap have the same in one text.

        Overlapping paragraphs share bands all the time.
        """
        values, row = self.bands.ravel(), np.repeat(np.arange(len(self.first)), BANDS)
        if not len(values):
            return values
        order = np.lexsort((values, self.text[row]))
        values, row = values[order], row[order]
        text = self.text[row]
        at = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (text[1:] != text[:-1])]))
        again = np.maximum.reduceat(self.first[row], at) >= np.minimum.reduceat(self.last[row], at)
        return np.concatenate([values[at], values[at][again]])

    def values(self, i: int) -> np.ndarray:
        return np.unique(self.grams[self.first[i] : self.last[i] - shingles.SHINGLE + 1])

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each paragraph in its text, up to the next word, so that nothing is left between paragraphs that follow each other."""
        words = self.words
        low = words.bounds[self.text]
        closed = self.last == words.per[self.text + 1]
        follow = np.append(words.start, 0)[self.last]
        return words.start[self.first] - low, np.where(closed, words.end[self.last - 1], follow) - low


def _instances(texts: DataFrame, total: int, put) -> DataFrame:
    """(sha, first_id, n_units, key, values, bands, place, s, e) of the paragraphs some band of which occurs again; and one row without key for each text."""
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(total / 12 * BANDS / suffixes.BUCKET_ROWS))

    def sample(table: pa.Table) -> pa.Table:
        hashing = shingles.MinHash(BANDS * ROWS)
        hashes = [Paragraphs(words, hashing).counted() for words in shingles.text_groups(table.column("text"))]
        return pa.Table.from_batches([suffixes.fragments(table.column("block")[0].as_py(), hashes, buckets)])

    ties = suffixes.repeated(texts.groupBy("block").applyInArrow(sample, suffixes.FRAGMENT)).withColumn("kind", F.lit("band"))
    ties = put(ties, "paragraph-ties")
    schema = "sha string, first_id long, copies long, n_units long, key binary, values binary, bands array<long>, place long, s long, e long"
    kinds = [("sha", pa.string()), ("first_id", pa.int64()), ("copies", pa.int64()), ("n_units", pa.int64()), ("key", pa.binary()), ("values", pa.binary()), ("bands", pa.list_(pa.int64())), ("place", pa.int64()), ("s", pa.int64()), ("e", pa.int64())]

    def open_(table: pa.Table, known: pa.Table) -> pa.Table:
        hashing, tied, done, out = shingles.MinHash(BANDS * ROWS), suffixes.keys_of(known, "band"), 0, []
        heads = list(zip(*(table.column(c).to_pylist() for c in ("sha", "first_id", "copies")), strict=True)) if table.num_rows else []
        for words in shingles.text_groups(table.column("text")) if heads else ():
            found = Paragraphs(words, hashing)
            texts_ = len(words.per) - 1
            n_units = np.bincount(found.text, minlength=texts_).tolist()
            out += [(*heads[done + t], n_units[t], None, None, None, None, None, None) for t in range(texts_)]
            hit = suffixes.is_in(found.bands.ravel(), tied).reshape(found.bands.shape)
            some = np.flatnonzero(hit.any(axis=1))
            bands, place, (s, e) = found.bands.view(np.int64), found.place.view(np.int64), found.spans()
            for i, t, p, b, c in zip(some.tolist(), *(x[some].tolist() for x in (found.text, place, s, e)), strict=True):
                values = found.values(i)
                out.append((*heads[done + t], n_units[t], shingles.key_of(values), values.tobytes(), bands[i][hit[i]], p, b, c))
            done += texts_
        columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])

    plain = texts.select("block", "sha", "text", "copies", F.col("first_id").cast("long").alias("first_id"))
    return plain.groupBy("block").cogroup(ties.groupBy("block")).applyInArrow(open_, schema)


def colliding(units: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of paragraph keys that are neighbours within some band; and as rows (a, null, region) the keys of bands not compared whole."""
    rows = units.select(F.explode("bands").alias("region"), "key", "place").distinct().withColumn("part", F.xxhash64("key"))
    spark = units.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // near.ROWS_PER_PARTITION)
    ordered = rows.repartitionByRange(parts, "region", "place").sortWithinPartitions("region", "place", "key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        region, place, part = (whole.column(c).to_numpy() for c in ("region", "place", "part"))
        yield from near.meetings(whole, *near.pairs_in(region, place, part, 2), near.open_in(region, part))

    return near.distinct(ordered.mapInArrow(meet, near.MEETINGS))


def repeated_paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_paragraphs, n_repeated, n_removed, removed_bytes, spans, sources.

    Paragraphs of MIN_WORDS words and more that share a band are compared on their five-word shingles,
    those of bands of more than near.REGION different ones also where they share rare shingles; links at 0.75 and equal sets form components.  In each component the instance with the smallest
    (doc_id, position) stays; the others go, but for instances of the same text that overlap the first.
    spans are the bytes that go, with the white space behind them, sources the documents that keep the passages.  Of equal texts only the
    smallest identifier is looked at, the others lose all their paragraphs.  What repeats within one text
    alone goes as well.

    Null and short texts have no paragraphs.  Null identifiers come last when a first instance is
    chosen.  Rows that repeat an identifier and a text share their answer.  Empty tables stay empty.
    Other columns are not looked at.
    """
    with scratch() as put:
        return cut(_repeated(docs, id_col, text_col, put), "paragraph-result")


def _repeated(docs: DataFrame, id_col: str, text_col: str, put) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    slim = put(rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "paragraph-rows")
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    with suffixes.block_table(rows.where(F.octet_length("text") >= 2 * MIN_WORDS), total) as texts:
        found = put(_instances(texts, total, put), "paragraph-units")
    units = found.where("key is not null")
    sets = put(units.groupBy("key").agg(F.first("values").alias("values")), "paragraph-sets")
    met = put(colliding(units), "paragraph-pairs")
    links = put(shingles.confirmed(met.where("b is not null").select("a", "b"), sets), "paragraph-links")
    labels = components(links)
    rest = near.unsettled(met, labels, put)
    if rest.limit(1).count():
        more = put(shingles.confirmed(put(shingles.sharing(sets.join(rest, "key"), put), "paragraph-sharing"), sets), "paragraph-more")
        first_labels, labels = labels, extended(labels, more, put)
        drop_table(first_labels)
    rooted = units.select("sha", "first_id", "copies", "key", "s", "e").join(labels.select(F.col("node").alias("key"), "root"), "key", "left")
    rooted = put(rooted.select("sha", "first_id", "copies", F.coalesce("root", "key").alias("root"), "s", "e"), "paragraph-rooted")
    place = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "sha", "s", "e")
    # written tables on both sides let Spark split the join where one component has many instances
    firsts = put(rooted.groupBy("root").agg(F.min(place).alias("first")), "paragraph-firsts")
    met = rooted.join(firsts, "root").withColumn("own", F.col("sha") == F.col("first.sha"))
    met = met.withColumn("gone", ~F.col("own") | (F.col("s") >= F.col("first.e")))
    met = put(met, "paragraph-met")
    counted = put(met.groupBy("root").agg(F.max("gone").alias("again")).where("again"), "paragraph-counted")
    met = met.join(counted, "root", "left")
    keep = F.filter(F.array_sort(F.collect_list(F.when(F.col("gone"), F.struct("s", "e")))), lambda x: x.isNotNull())
    by_text = met.groupBy("sha").agg(
        F.count_if(F.col("again")).alias("n_repeated"), F.count_if(F.col("gone")).alias("n_removed"), keep.alias("parts"),
        F.array_sort(F.collect_set(F.when(F.col("gone") & ~F.col("own"), F.col("first.first_id")))).alias("sources"),
    )
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    grow = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x)))
    texts_ = found.where("key is null").select("sha", "first_id", "copies", "n_units").join(by_text, "sha", "left")
    merged = F.aggregate(F.coalesce("parts", none), none, grow)
    texts_ = texts_.select("sha", "first_id", "copies", "n_units", "n_repeated", "n_removed", merged.alias("spans"), "sources")
    out = slim.join(put(texts_, "paragraph-texts"), "sha", "left")
    copy = (F.col("copies") > 1) & ~F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_units") > 0)
    size = F.aggregate(F.coalesce("spans", none), F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "doc_id", n("n_units").alias("n_paragraphs"), F.when(F.col("copies") > 1, F.col("n_units")).otherwise(n("n_repeated")).alias("n_repeated"),
        F.when(copy, F.col("n_units")).otherwise(n("n_removed")).alias("n_removed"), F.when(copy, F.col("n_bytes")).otherwise(size).alias("removed_bytes"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.array("first_id")).otherwise(F.coalesce("sources", F.array().cast("array<bigint>"))).alias("sources"),
    )
