"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talkloom.llm import shingles
from talkloom.llm.common import body, components, cut, drop_table, extended, free, scratch

#: Sorted orders (trees), signature values that a candidate pair shares at least, and values per signature.
TREES, DEPTH = 32, 4
VALUES = TREES * DEPTH
#: Regions of up to so many nodes are compared whole; denser ones among longest common prefixes, then by rare shingles.
REGION = 16
#: Trees of the first round, which joins the bulk of dense regions before all trees are searched.
FIRST_TREES = 4
#: Equal bits of a 128-bit sketch below which two sets are not compared: 6 standard deviations under
#: the mean at the similarity asked for (112 of 128 bits, deviation 3.7).
SKETCH_BITS = 89
#: Rows of a list of wanted documents up to which it is broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000
ROWS_PER_PARTITION = 200_000


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, n_shingles, key, sig): mark is a hash of the text, key stands for the whole set."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = shingles.MinHash(VALUES)
        for batch in batches:
            n, keys, sigs = [], [], []
            for words in shingles.text_groups(batch.column(1)):
                values, per = words.shingled()
                sets = [np.unique(values[per[i] : per[i + 1]]) for i in range(len(per) - 1)]
                full = [v for v in sets if len(v)]
                sizes = np.array([len(v) for v in full], np.int64)
                rows_ = iter(hashing.of(np.concatenate(full), np.cumsum(sizes) - sizes) if full else ())
                n += [len(v) for v in sets]
                keys += [shingles.key_of(v) if len(v) else None for v in sets]
                sigs += [next(rows_).tobytes() if len(v) else None for v in sets]
            arrays = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "n_shingles", "key", "sig"])

    return rows.mapInArrow(sign, "doc_id long, mark long, n_shingles long, key binary, sig binary")


def classes(signed: DataFrame) -> DataFrame:
    """One row per distinct set: key, its smallest document (rep_id, rep_mark), sig."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("rep")
    found = signed.where("key is not null").groupBy("key").agg(rep, F.first("sig").alias("sig"))
    return found.select("key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("rep_mark"), "sig")


def leaves(nodes: DataFrame, trees: int) -> DataFrame:
    """Each node once per tree: region (hash of the tree and its first DEPTH values), order (the next values), sketch.

    Tree t reads the signature from value t * DEPTH on, round the end: every tree is another rotation.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column("sig")), np.uint32).reshape(batch.num_rows, VALUES)
            bits = np.packbits((sig & 1).astype(np.uint8), axis=1).view(np.int64)
            for t in range(trees):
                turn = np.roll(sig[:, : VALUES], -t * DEPTH, axis=1)[:, : DEPTH + 4].astype(np.uint64)
                region = np.full(len(sig), t + 1, np.uint64)
                for j in range(DEPTH):
                    region = shingles.mixed(region * np.uint64(0x9E3779B97F4A7C15) + turn[:, j])
                order = np.zeros(len(sig), np.uint64)
                for j in range(DEPTH, DEPTH + 4):
                    order = (order << np.uint64(16)) | (turn[:, j] & np.uint64(0xFFFF))
                made = [pa.array(x) for x in (region.view(np.int64), order.view(np.int64), bits[:, 0], bits[:, 1])]
                yield pa.RecordBatch.from_arrays([*made, batch.column("key"), batch.column("part")], names=["region", "place", "s1", "s2", "key", "part"])

    return nodes.select("key", "sig", "part").mapInArrow(grow, "region long, place long, s1 long, s2 long, key binary, part long")


def pairs_in(region: np.ndarray, place: np.ndarray, part: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) to compare among sorted leaves.

    Regions of up to REGION leaves: all of other parts within the region.  Denser regions deepen: the
    longest prefix that leaves at most REGION together is compared whole, everyone meets the next `far`
    leaves (its longest common prefixes), and neighbours among the region's parts meet once.
    """
    n = len(region)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = [], []

    def within(ids: np.ndarray, most: int, reach: int) -> None:
        """ids: run numbers of sorted leaves."""
        size = np.bincount(ids)[ids]
        for o in range(1, min(reach, n - 1) + 1):
            i = np.flatnonzero((ids[:-o] == ids[o:]) & (size[:-o] <= most) & (part[:-o] != part[o:]))
            if not len(i) and o >= most:
                break
            left.append(i)
            right.append(i + o)

    runs = np.concatenate([[0], np.cumsum(region[1:] != region[:-1])])
    within(runs, REGION, REGION - 1)
    dense = np.bincount(runs)[runs] > REGION
    if dense.any():
        within(runs, 1 << 62, far)
        unsigned = place.view(np.uint64)
        for shift in (48, 32, 16, 0):
            deep = unsigned >> np.uint64(shift)
            cuts = np.concatenate([[0], np.cumsum((region[1:] != region[:-1]) | (deep[1:] != deep[:-1]))])
            within(cuts, REGION if far > 1 else 0, REGION - 1)
        at = np.flatnonzero(dense)
        at = at[np.lexsort((part[at], runs[at]))]
        meet = np.flatnonzero((runs[at[:-1]] == runs[at[1:]]) & (part[at[:-1]] != part[at[1:]]))
        left.append(at[meet])
        right.append(at[meet + 1])
    return np.concatenate(left), np.concatenate(right)


def open_in(region: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Positions of sorted leaves not compared with their whole region: those of dense regions of several parts, and of the first and last region, which may go on in another partition."""
    first = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    size = np.diff(np.append(first, len(region)))
    found = (size > REGION) & (np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first))
    found[[0, -1]] = True
    return np.flatnonzero(np.repeat(found, size))


def meetings(whole: pa.Table, i: np.ndarray, j: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, region): pairs of keys without region, and keys that are left over with theirs."""
    keys, region = whole.column("key").combine_chunks(), whole.column("region").combine_chunks()
    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), keys.take(pa.array(j)), pa.nulls(len(i), pa.int64())], names=["x", "y", "region"])
    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rest)), pa.nulls(len(rest), pa.binary()), region.take(pa.array(rest))], names=["x", "y", "region"])


MEETINGS = "x binary, y binary, region long"


def distinct(met: DataFrame) -> DataFrame:
    """Distinct rows of meetings as (a, b, region), a the smaller key; b is null where a is left over in its region."""
    pair = F.col("y").isNotNull()
    ordered = met.select(F.when(pair, F.least("x", "y")).otherwise(F.col("x")).alias("a"), F.when(pair, F.greatest("x", "y")).alias("b"), "region")
    return ordered.where("b is null or a <> b").distinct()


def unsettled(met: DataFrame, labels: DataFrame, put) -> DataFrame:
    """(key, part) of the keys left over in regions that are of several parts still."""
    rest = met.where("b is null").select(F.col("a").alias("key"), "region")
    placed = rest.join(labels.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "region", F.xxhash64(F.coalesce("root", "key")).alias("part"))
    placed = put(placed, "near-placed")
    several = put(placed.groupBy("region").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("region"), "near-several")
    return put(placed.join(several, "region").select("key", "part").distinct(), "near-unsettled")


def candidates(nodes: DataFrame, trees: int, far: int) -> DataFrame:
    """Distinct pairs of keys (a, b) of other parts that are neighbours in some tree's order; and as rows (a, null, region) the leaves left over."""
    grown = leaves(nodes, trees)
    rows = nodes.count() * trees
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_PARTITION)
    ordered = grown.repartitionByRange(parts, "region", "place").sortWithinPartitions("region", "place", "key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]  # leaves of one range partition: fixed size each
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        region, place, s1, s2, part = (whole.column(c).to_numpy() for c in ("region", "place", "s1", "s2", "part"))
        i, j = pairs_in(region, place, part, far)
        same = 128 - sum(np.bitwise_count((s[i] ^ s[j]).view(np.uint64)).astype(int) for s in (s1, s2))
        i, j = i[same >= SKETCH_BITS], j[same >= SKETCH_BITS]
        yield from meetings(whole, i, j, open_in(region, part))

    return distinct(ordered.mapInArrow(meet, MEETINGS))


def linked(docs: DataFrame, found: DataFrame, pairs: DataFrame, id_col: str, text_col: str, put=cut) -> DataFrame:
    """The pairs confirmed on the full sets of their documents."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    return shingles.confirmed(pairs, sets_of(docs, found, ends, id_col, text_col, put))


def sets_of(docs: DataFrame, found: DataFrame, ends: DataFrame, id_col: str, text_col: str, put) -> DataFrame:
    """(key, values): the full sets of the classes asked for, read again from the texts."""
    wanted = put(found.select("key", "rep_id", "rep_mark").join(ends, "key"), "near-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    rows = rows.join(wanted, (F.xxhash64("text") == F.col("rep_mark")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("key", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v.tobytes() for v in shingles.shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["key", "values"])

    return put(rows.mapInArrow(shingle, "key binary, values binary").dropDuplicates(["key"]), "near-sets")


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, mark, n_shingles, component_id.

    Documents with one set of shingles are one class.  Every class lies in TREES sorted orders of
    signature values; neighbours by longest common prefix are candidates, compared on their full sets,
    and confirmed links join classes to components.  A first round over a few trees joins the bulk of
    dense regions; the second round, over all trees, only meets classes that are still apart, so a
    group of copies costs work in proportion to its size.  Classes of regions not compared whole that are
    of several parts even then meet where they share rare shingles, which misses no link among them.

    A pair of similarity s shares no tree's prefix with probability (1 - s ** DEPTH) ** TREES, 5e-6 at
    0.75.  Links are exact up to equal 64-bit hashes.

    Null, empty and blank texts have no shingles, are linked with nothing and form components of their
    own; component_id is the smallest identifier of the component, nulls aside, null where it has none.
    Rows that repeat an identifier or text share a class.  An empty table gives an empty table.  Other
    columns are not looked at.
    """
    with scratch() as put:
        return cut(_components(docs, id_col, text_col, put), "near-result")


def _components(docs: DataFrame, id_col: str, text_col: str, put) -> DataFrame:
    signed = put(signatures(docs, id_col, text_col), "near-signed")
    found = put(classes(signed), "near-classes")
    alone = found.withColumn("part", F.xxhash64("key"))
    first = put(candidates(alone, FIRST_TREES, 1).where("b is not null").select("a", "b"), "near-first")
    links = put(linked(docs, found, first, id_col, text_col, put), "near-links")
    labels = components(links)
    parts = found.join(labels, found["key"] == labels["node"], "left").select("key", "sig", F.xxhash64(F.coalesce("root", "key")).alias("part"))
    second = put(candidates(parts, TREES, 2), "near-second")
    more = put(linked(docs, found, second.where("b is not null").select("a", "b"), id_col, text_col, put), "near-more")
    first_labels, labels = labels, extended(labels, more, put)
    drop_table(first_labels)
    rest = unsettled(second, labels, put)
    if rest.limit(1).count():
        sets = sets_of(docs, found, rest.select("key"), id_col, text_col, put)
        third = put(shingles.sharing(sets.join(rest, "key"), put), "near-third")
        last = put(shingles.confirmed(third, sets), "near-last")
        labels = extended(labels, last, put)
    named = labels.join(found.select(F.col("key").alias("node"), "rep_id"), "node")
    smallest = named.groupBy("root").agg(F.min("rep_id").alias("cid"))
    of_class = named.join(smallest, "root").select(F.col("node").alias("key"), "cid")
    of_class = found.select("key", "rep_id").join(of_class, "key", "left").select("key", F.coalesce("cid", "rep_id").alias("cid"))
    # a written table on either side lets Spark split the join where one class has many documents
    of_class = put(of_class, "near-classed")
    with_class = signed.select("doc_id", "mark", "n_shingles", "key").join(of_class, "key", "left")
    return with_class.select("doc_id", "mark", "n_shingles", F.coalesce("cid", "doc_id").alias("component_id"))


def near_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return near_components(docs, **options).select("doc_id", "n_shingles", "component_id", same.alias("kept"))


def near_deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the smallest identifier, with the columns of the input.

    Rows that repeat an identifier and a text stay once.  A null identifier stays only where its
    component has no other.  Null, empty and blank texts stay.  An empty table stays empty; other columns
    are kept, whatever their names.
    """
    mark, kept_id, kept_mark = free(docs, "mark", "kept_id", "kept_mark")
    kept = near_components(docs, id_col=id_col, text_col=text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = cut(kept.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")), "near-kept")
    marked = docs.withColumn(mark, F.xxhash64(body(text_col)))
    names = kept.select(F.col("doc_id").alias(kept_id), F.col("mark").alias(kept_mark))
    left = marked.join(names, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(mark) == F.col(kept_mark)), "left_semi")
    if kept.where("n > 1").limit(1).count():
        left = left.dropDuplicates([id_col, mark])
    return left.select(*docs.columns)
