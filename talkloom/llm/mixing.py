"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.llm.common import body

#: Expected copies are kept as whole numbers of this part, so sums do not depend on their
#: order; a source of 4e12 rows, all taken twice, still fits 64 bits.
UNIT_BITS = 20
UNIT = 1 << UNIT_BITS
#: Source tables up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Rows that one bucket of the two-level prefix sum holds on average.
ROWS_PER_BUCKET = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(body(text), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, *, weights=(5.0, 2.0, 1.0), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): total_share of all sizes by weight, no target above most times its source.

    Weights go round the sources in code point order, null last.  Resharing the excess until nothing is
    above its limit ends at target = min(limit, level * weight); sorting by limit over weight finds the
    level in one pass.  One row per source is all that is gathered here.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = per.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(total_share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    # in this order the sources at their limit come first; the first source below its limit has the level
    tried = ranked.withColumn("level", level)
    below = F.when(F.col("level") * F.col("w") < F.col("limit"), F.col("level"))
    found = tried.withColumn("found", F.first(below, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return found.select("source", "source_size", F.least("limit", F.coalesce(F.col("found") * F.col("w"), F.col("limit"))).alias("target"))


def mix(docs: DataFrame, *, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, **shares) -> DataFrame:
    """All rows with __size, __source_size, __target and __copies: how often the mix takes each document.

    Every document of a source expects target / source_size copies.  Within a source the documents lie in
    order of falling size class, then hash of the identifier; prefix sums of the expectations plus one
    offset per source (from the seed) cross a whole number once for each copy.  Copies are the expectation
    rounded down or up, never above `most`.  Prefix sums have three levels: size classes of a source (a few
    hundred), buckets of a class and rows of a bucket, so that one source may hold any share of the rows.

    Nulls: a null source is a source of its own, null texts have size 0, null identifiers hash alike.
    A source of size 0 has target 0 and no copies.  Rows that repeat an identifier are rows of their own.
    Texts of any length count as they are.  Empty tables stay empty.  All columns of the input are kept,
    but those named like one of the four new ones, which replace them.
    """
    size = word_count() if size is None else size
    most = float(shares.get("most", 2.0))
    kept = [c for c in docs.columns if c.lower() not in ("__size", "__source_size", "__target", "__copies")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), size.cast("long").alias("size"), F.col(source_col).alias("source"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("hash"), F.col(id_col).alias("id"),
    )
    aims = targets(rows.select("source", "size"), **shares)
    buckets = max(1, docs.select(id_col).count() // ROWS_PER_BUCKET) * 4
    # about eight classes for each doubling, the largest first
    rows = rows.withColumns({"class": -F.floor(F.log2(F.col("size") + 1) * 8).cast("int"), "bucket": F.pmod(F.shiftrightunsigned("hash", 20), F.lit(buckets)).cast("int")})
    key = ["source", "class", "bucket"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    aims = aims.select(F.col("source").alias("s"), "source_size", "target")
    aims = F.broadcast(aims) if aims.count() <= BROADCAST_SOURCES else aims
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most)) * UNIT).otherwise(0)
    offset = F.pmod(F.xxhash64("source", F.lit(seed + 1)), F.lit(UNIT))
    earlier = W.unboundedPreceding, -1
    # rows of the classes before, then of the buckets before
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("class").rowsBetween(*earlier)), F.lit(0))
    classes = classes.select(F.col("source").alias("cs"), F.col("class").alias("cc"), before.alias("ahead"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "class").orderBy("bucket").rowsBetween(*earlier)), F.lit(0))
    starts = (
        counts.withColumn("inner", before)
        .join(classes, F.col("source").eqNullSafe(F.col("cs")) & (F.col("class") == F.col("cc")))
        .join(aims, F.col("source").eqNullSafe(F.col("s")))
        .select(
            F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("b"), "source_size", "target", F.round(each).cast("long").alias("each"),
            (F.col("ahead") + F.col("inner")).alias("before"), offset.alias("offset"),
        )
    )
    placed = rows.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("hash", "id")).cast("long"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("bucket") == F.col("b"))
    copies = crossings(F.col("before") + F.col("rank"), F.col("each"), F.col("offset"))
    return placed.join(starts, same).select(
        "row.*", F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), copies.cast("int").alias("__copies")
    )


def crossings(place: Column, each: Column, offset: Column) -> Column:
    """Whole numbers between the sum before a row and the sum with it; place counts rows from 1, each is an expectation in UNITs."""
    upto = place * each + offset
    return F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - each, UNIT_BITS)


def mixed_documents(docs: DataFrame, *, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of the input, whatever their names."""
    size = word_count() if size is None else size
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("words"))
    taken = mix(packed, size=F.col("words"), id_col="id", **options).where("__copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("doc.*")
