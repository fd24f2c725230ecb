"""Helpers shared by the corpus operators: shared-folder tables, words, components."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Input bytes that one shuffle partition of whole texts should hold.
TEXT_PARTITION_BYTES = 32 << 20
#: Partitions from which on they rather grow, the bytes that one holds then at most, and estimates that mean nothing.
MANY_PARTITIONS, MOST_PARTITION_BYTES, UNKNOWN_BYTES = 200_000, 512 << 20, 1 << 60
#: Nodes of a graph up to which its tables of labels are broadcast; beyond, they are joined by shuffle.
BROADCAST_NODES = 100_000


def body(text: str | Column = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where the frame has such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where none is named a local one is set in local mode (tests), elsewhere it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="talkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Shuffle files go when the job that wrote a table is done; until then a lost executor's part is made again from them.
CLEAN = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, **CLEAN):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that cut() wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch():
    """cut() for tables that only the block reads: they go at its end, so its result must be written inside."""
    tables: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        tables.append(cut(df, name))
        return tables[-1]

    try:
        yield put
    finally:
        for made in tables:
            drop_table(made)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the jobs started inside; names use __ for dots."""
    old = {}
    for key, value in values.items():
        key = key.replace("__", ".")
        old[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def input_bytes(df: DataFrame) -> int:
    """The size Catalyst estimates for a frame's leaves; only used to choose numbers of partitions."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, each: int = TEXT_PARTITION_BYTES, expand: float = 3.0) -> int:
    """Enough partitions that each holds about `each` bytes, never fewer than the session's own number.

    Beyond MANY_PARTITIONS of them partitions grow, up to MOST_PARTITION_BYTES; from there on their number
    grows again.  Frames whose size Catalyst does not know (rows from the driver) get the session's number.
    """
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    if size >= UNKNOWN_BYTES:
        return least
    each = max(each, min(MOST_PARTITION_BYTES, size * expand / MANY_PARTITIONS))
    return max(least, math.ceil(size * expand / each))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node, root its smallest node.

    Each round joins every node's label with its neighbours' labels and then jumps to the label's
    own label, so chains shorten geometrically.  Each round is one written table; only two counters
    reach the driver.  Loops and repeated edges do no harm; no edges give no rows; nulls are dropped.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-0")
    side = F.broadcast if labels.count() <= BROADCAST_NODES else lambda df: df
    step = 0
    while True:
        step += 1
        near = (
            both.join(side(labels.select(F.col("node").alias("b"), F.col("root").alias("r"))), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("r").alias("r"))
        )
        seen = labels.join(side(near), "node", "left").select("node", F.col("root").alias("old"), F.least("root", "r").alias("r"))
        # every root hears of the smallest label any of its members has met
        hooks = seen.where("r < old").groupBy(F.col("old").alias("h")).agg(F.min("r").alias("hr"))
        hooked = seen.join(side(hooks), seen["old"] == hooks["h"], "left").select("node", "old", F.least("r", "hr").alias("r"))
        jump = labels.select(F.col("node").alias("j"), F.col("root").alias("jr"))
        moved = hooked.join(side(jump), hooked["r"] == jump["j"], "left").select("node", "old", F.least("r", "jr").alias("root"))
        new = cut(moved, f"{name}-{step}")
        changed = new.where("root <> old").limit(1).count()
        drop_table(labels)
        labels = new.select("node", "root")
        if not changed:
            break
    drop_table(both)
    return labels


def extended(labels: DataFrame, edges: DataFrame, put, name: str = "components") -> DataFrame:
    """(node, root) of components() once further edges (a, b) join some of them: only their roots are searched again."""
    side = F.broadcast if labels.count() <= BROADCAST_NODES else lambda df: df
    ends = side(labels.select(F.col("node").alias("n"), "root"))
    met = edges.select("a", "b")
    for end in ("a", "b"):
        met = met.join(ends, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("root", end)).drop("n", "root")
    moved = components(put(met.where("a <> b").distinct(), f"{name}-roots"), name)
    to = moved.select(F.col("node").alias("n"), F.col("root").alias("new"))
    to = F.broadcast(to) if moved.count() <= BROADCAST_NODES else to
    known = labels.join(to, F.col("root") == F.col("n"), "left").select("node", F.coalesce("new", "root").alias("root"))
    out = put(known.union(moved.join(side(labels), "node", "left_anti")), f"{name}-extended")
    drop_table(moved)
    return out
