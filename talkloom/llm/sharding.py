"""A uniform shuffle into shards of exact sizes by a random communication matrix, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.llm.common import cut, drop_table, partitions_for

#: Places of a row inside its partition, as monotonically_increasing_id() lays them out.
PLACE_BITS = 33
#: Rows of the communication matrix up to which it is broadcast (some 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_PARTS = 500_000
#: Cells for each partition of the exchange, so that their number evens out.
CELLS = 4
#: Levels of the matrix that one written table adds.
LEVELS_A_TABLE = 4
#: Standard deviations, and counts besides, from the mode that a draw looks at.  What lies beyond has, by
#: Bernstein's bound, less weight than the last of the 53 bits a draw is made with.
REACH, BESIDES = 12, 30
NEW = ("__shard", "__slot")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def uniform(*of: Column) -> Column:
    """A number from 0 to below 1 with 53 bits, fixed by the columns."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") * F.lit(2.0**-53)


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """How many of `draws` rows, taken from good + bad ones without putting back, are good: the value at which the uniform u lands.

    Weights follow from the mode outwards by their ratios, so no factorials are needed.
    """
    given = F.struct(good.cast("double").alias("g"), bad.cast("double").alias("b"), draws.cast("double").alias("d"))

    def bounds(p: Column) -> Column:
        g, b, d = p["g"], p["b"], p["d"]
        n = g + b
        whole = F.greatest(n, F.lit(1.0))
        spread = F.sqrt(d * (g / whole) * (b / whole) * F.greatest(n - d, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0)))
        least, most = F.greatest(F.lit(0.0), d - b), F.least(d, g)
        mode = F.least(most, F.greatest(least, F.floor((d + 1) * (g + 1) / (n + 2)).cast("double")))
        reach = F.ceil(spread * REACH).cast("double") + BESIDES
        return F.struct(
            *[p[k].alias(k) for k in "gbd"], mode.cast("long").alias("mode"),
            F.greatest(least, mode - reach).cast("long").alias("lo"), F.least(most, mode + reach).cast("long").alias("hi"),
        )

    def drawn(p: Column) -> Column:
        g, b, d, mode = p["g"], p["b"], p["d"], p["mode"]
        none = F.array().cast("array<bigint>")
        places = F.concat(F.sequence(mode, p["hi"]), F.when(mode > p["lo"], F.sequence(mode - 1, p["lo"])).otherwise(none))

        def weight(before: Column, place: Column) -> Column:
            x = place.cast("double")
            up = (g - x + 1) * (d - x + 1) / (x * (b - d + x))
            down = (x + 1) * (b - d + x + 1) / ((g - x) * (d - x))
            return F.when(place == mode, F.lit(1.0)).when(place > mode, before * up).when(place == mode - 1, down).otherwise(before * down)

        def add(a: Column, x: Column) -> Column:
            return let(weight(a["w"], x), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s")))

        def seek(a: Column, x: Column) -> Column:
            here = lambda w: F.when((a["x"] < 0) & (a["s"] < w), x).otherwise(a["x"])
            return let(weight(a["w"], x), lambda w: F.struct(w.alias("w"), (a["s"] - w).alias("s"), here(w).alias("x")))

        def found(xs: Column) -> Column:
            total = F.aggregate(xs, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")), add)["s"]
            start = F.struct(F.lit(1.0).alias("w"), (u * total).alias("s"), F.lit(-1).cast("bigint").alias("x"))
            return let(F.aggregate(xs, start, seek)["x"], lambda x: F.when(x < 0, mode).otherwise(x))

        return let(places, found)

    return let(let(given, bounds), drawn)


def split_sizes(sizes: Column, draws: Column, *mark: Column) -> Column:
    """How many of `draws` rows fall to each shard with so many places left: one exact draw for each shard, given those before."""
    start = F.struct(draws.alias("left"), F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("rest"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, size: Column) -> Column:
        u = uniform(F.size(a["out"]), *mark)
        draw = lambda x: F.struct((a["left"] - x).alias("left"), (a["rest"] - size).alias("rest"), F.concat(a["out"], F.array(x)).alias("out"))
        return let(hypergeometric(u, size, a["rest"] - size, a["left"]), draw)

    return F.aggregate(sizes, start, step)["out"]


def communication_matrix(counts: DataFrame, shards: int, seed: int = 23, name: str = "matrix") -> DataFrame:
    """(part, n, sizes): of counts (part, n), how many rows of each partition go to each shard.

    The matrix is drawn as chance would give it to a uniform shuffle: its rows add up to the partitions'
    counts, its columns to shard sizes that differ by one at most.  Partitions are halved again and again;
    each level splits what its ranges of partitions owe to the shards by one multivariate draw a range, so
    the steps are as many as the logarithm of the number of partitions and no draw waits for all others.
    """
    height = max(1, int(counts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]).bit_length())
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    levels = counts.select(F.explode(F.sequence(F.lit(1), F.lit(height))).alias("level"), "part", "n")
    levels = levels.groupBy("level", F.expr(f"shiftright(part, {height} - level)").alias("place")).agg(F.sum("n").alias("m"))
    levels = cut(levels, f"{name}-counts")
    nodes, written = counts.sparkSession.range(1).select(F.col("id").alias("node"), F.array(*[F.lit(s).cast("bigint") for s in sizes]).alias("sizes")), []
    for level in range(1, height + 1):
        here = levels.where(F.col("level") == level).select("place", "m")
        met = nodes.join(here, F.col("node") * 2 == F.col("place"), "left").select("node", "sizes", F.coalesce("m", F.lit(0).cast("bigint")).alias("m"))
        lower = split_sizes(F.col("sizes"), F.col("m"), F.lit(seed), F.lit(level), F.col("node"))
        halves = met.withColumn("lower", lower).withColumn("upper", F.zip_with("sizes", "lower", lambda a, b: a - b))
        nodes = halves.select(F.posexplode(F.array("lower", "upper")).alias("half", "sizes"), "node").select((F.col("node") * 2 + F.col("half")).alias("node"), "sizes")
        if level % LEVELS_A_TABLE == 0 or level == height:
            nodes = cut(nodes, f"{name}-{level}")
            written.append(nodes)
    for table in (levels, *written[:-1]):
        drop_table(table)
    return counts.join(nodes, F.col("part") == F.col("node")).select("part", "n", "sizes")


def sharded(docs: DataFrame, *, shards: int = 8, seed: int = 23) -> DataFrame:
    """All rows with __shard (0 to shards - 1) and __slot (gapless from 0 in each shard): a uniform shuffle with exact sizes.

    Each partition of the input is permuted locally (sorted by a hash of its rows' places) and written.  A
    communication matrix says how many of its rows go to each shard: the first ones to shard 0, the next to
    shard 1 and so on.  After the exchange rows are permuted again: a second hash spreads a shard over cells
    and orders each cell; a row's slot is the number of rows in the cells before and in front of it.  Shard
    sizes differ by one at most, whatever the rows hold.

    The shuffle depends on the seed and on how Spark splits the input: the same files read with the same
    settings give the same shards and slots again.  No value of a row is looked at, so nulls, ties, repeated rows, very long and empty
    texts make no difference, and no key can make a cell larger than others.  An empty table gives an empty
    table; shards may be empty where rows are few.  All columns are kept, but those named like one of the two
    new ones, which replace them.
    """
    kept = [c for c in docs.columns if c.lower() not in NEW]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")).withColumn("key", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    permuted = cut(packed.sortWithinPartitions("key").select("row", F.monotonically_increasing_id().alias("at")), "shard-permuted")
    part, rank = F.shiftright("at", PLACE_BITS), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = cut(permuted.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    matrix = communication_matrix(counts, shards, seed, "shard-matrix")
    sums = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    ends = matrix.select(F.col("part").alias("of"), sums.alias("ends"))
    ends = F.broadcast(ends) if counts.count() <= BROADCAST_PARTS else ends
    parts = partitions_for(permuted)
    cells = math.ceil(CELLS * parts / shards)
    dealt = permuted.join(ends, part == F.col("of")).select("row", "at", F.size(F.filter("ends", lambda e: e <= rank)).alias("shard"), F.xxhash64("at", F.lit(seed + 1)).alias("key"))
    dealt = dealt.withColumn("cell", F.pmod("key", F.lit(cells)).cast("int"))
    filled = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("m"))
    ahead = F.coalesce(F.sum("m").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cut(filled.select(F.col("shard").alias("s"), F.col("cell").alias("c"), ahead.alias("ahead")), "shard-cells")
    place = F.row_number().over(W.partitionBy("shard", "cell").orderBy("key", "at")) - 1
    exchanged = dealt.repartition(parts, "shard", "cell").withColumn("place", place)
    slots = exchanged.join(starts, (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))
    return slots.select("row.*", F.col("shard").alias(NEW[0]), (F.col("ahead") + F.col("place")).alias(NEW[1]))


def write_shards(docs: DataFrame, path: str, *, shards: int = 8, seed: int = 23) -> None:
    """The shards as folders __shard=0, 1, ... of Parquet files; rows of a file ascend by __slot, and files hold runs of cells."""
    sharded(docs, shards=shards, seed=seed).sortWithinPartitions(*NEW).write.partitionBy(NEW[0]).parquet(path)
