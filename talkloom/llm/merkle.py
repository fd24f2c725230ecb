"""A manifest of hash trees over the rows of a dataset: levels are built bottom up and proofs pushed top down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkloom.llm.common import cut, drop_table, partitions_for, scratch

#: Children that one row of a persisted table of levels holds at most.
BLOCK = 256
#: Places of a row inside its partition, as monotonically_increasing_id() lays them out.
PLACE_BITS = 33
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value with its UTF-8 byte count in front, so that no two lists of values read alike; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*[framed(v) for v in values])


@dataclass(frozen=True)
class Shape:
    """Runs of `arity` nodes become one; a block holds the nodes below one node `levels` higher."""

    arity: int
    levels: int

    @classmethod
    def of(cls, arity: int) -> Shape:
        if arity < 2:
            raise ValueError("a run needs two nodes or more")
        levels = 1
        while arity ** (levels + 1) <= BLOCK:
            levels += 1
        return cls(arity, levels)

    @property
    def span(self) -> int:
        return self.arity**self.levels

    def height(self, n: Column) -> Column:
        """Levels above the children inside a block of a tree of n nodes: all of them, or up to the only node left."""
        return sum((F.when(n > self.arity**k, 1).otherwise(0) for k in range(self.levels)), F.lit(0))

    def built(self, hashes: Column, n: Column) -> Column:
        """The levels of a block, children first: each run's digest, the last run shorter, until the height is reached."""

        def above(below: Column) -> Column:
            runs = F.ceil(F.size(below) / F.lit(self.arity)).cast("int")
            return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.array_join(F.slice(below, i * self.arity + 1, self.arity), ""), 256))

        steps = F.slice(F.sequence(F.lit(1), F.lit(self.levels)), F.lit(1), self.height(n))
        return F.aggregate(steps, F.array(hashes), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))

    def siblings(self, levels: Column, child: Column) -> Column:
        """The proof of a child inside its block: at each level its place in the run and the others of the run."""

        def of(below: Column, k: Column) -> Column:
            place = F.floor(child / F.pow(F.lit(float(self.arity)), k)).cast("int")
            at = F.pmod(place, F.lit(self.arity))
            others = F.filter(F.slice(below, place - at + 1, self.arity), lambda _, i: i != at)
            return F.struct(at.alias("at"), others.alias("others"))

        return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), of)


def numbered(rows: DataFrame, put) -> DataFrame:
    """Rows (tree, order, hash, load) as nodes (tree, idx, n, hash, load): idx counts a tree's rows in order, n all of them.

    Rows are range-partitioned and sorted, and their places written with them, so one tree may hold any
    share of the rows; the prefix sums run over one row for each tree and partition.
    """
    keys = ["tree", "order", "hash"]
    laid = rows.repartitionByRange(partitions_for(rows), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    laid = put(laid, "merkle-order")
    part = F.shiftright("at", PLACE_BITS)
    per = laid.groupBy("tree", part.alias("part")).agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first"))
    tree = W.partitionBy("tree")
    ahead = F.coalesce(F.sum("m").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = per.select(F.col("tree").alias("t"), F.col("part").alias("p"), (ahead - F.col("first")).alias("shift"), F.sum("m").over(tree).alias("n"))
    placed = laid.join(shifts, F.col("tree").eqNullSafe(F.col("t")) & (part == F.col("p")))
    return placed.select("tree", (F.col("at") + F.col("shift")).alias("idx"), "n", "hash", "load")


def grown(nodes: DataFrame, shape: Shape, put, name: str) -> list[DataFrame]:
    """Written tables (tree, block, n, levels, loads), the leaves' first; a tree ends in the table where n is one block."""
    span, tables = shape.span, []
    while True:
        block = F.floor(F.col("idx") / F.lit(span)).cast("long")
        children = F.sort_array(F.collect_list(F.struct("idx", "hash", "load")))
        gathered = nodes.groupBy("tree", block.alias("block")).agg(F.first("n").alias("n"), children.alias("c"))
        tables.append(put(gathered.select("tree", "block", "n", shape.built(F.col("c.hash"), F.col("n")).alias("levels"), F.col("c.load").alias("loads")), f"{name}-{len(tables)}"))
        higher = tables[-1].where(F.col("n") > span)
        if not higher.limit(1).count():
            return tables
        upper = F.ceil(F.col("n") / F.lit(span)).cast("long")
        nodes = higher.select("tree", F.col("block").alias("idx"), upper.alias("n"), F.element_at("levels", -1)[0].alias("hash"), F.lit(None).cast("int").alias("load"))


def tops(tables: list[DataFrame], shape: Shape) -> DataFrame:
    """(tree, hash, step): the last node of each tree and the table it ends in."""
    ends = [t.where(F.col("n") <= shape.span).select("tree", F.element_at("levels", -1)[0].alias("hash"), F.lit(k).alias("step")) for k, t in enumerate(tables)]
    out = ends[0]
    for more in ends[1:]:
        out = out.union(more)
    return out


def pushed(tables: list[DataFrame], ends: DataFrame, shape: Shape, put, name: str) -> DataFrame:
    """(tree, load, hash, proof, heir): each leaf's proof, pushed down from ends (tree, step, proof, heir).

    A block's row meets the proof of its uppermost node, and every child puts its siblings before it.  Each
    table of proofs but the last is written.
    """
    above = None
    for step in range(len(tables) - 1, -1, -1):
        met = ends.where(F.col("step") == step).select(F.col("tree").alias("t"), F.lit(0).cast("long").alias("b"), "proof", "heir")
        met = met if above is None else met.union(above)
        blocks = tables[step].join(met, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")))
        each = blocks.select("*", F.posexplode(F.col("levels")[0]).alias("child", "hash"))
        proof = F.concat(shape.siblings(F.col("levels"), F.col("child")), F.col("proof"))
        if step:
            place = F.col("block") * shape.span + F.col("child")
            above = put(each.select("tree", place.alias("b"), proof.alias("proof"), "heir"), f"{name}-proofs-{step}")
        else:
            return each.select("tree", F.col("loads")[F.col("child")].alias("load"), "hash", proof.alias("proof"), "heir")
    raise ValueError("no tables of levels")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def up(node: Column, step: Column) -> Column:
        before, behind = F.slice(step["others"], F.lit(1), step["at"]), F.slice(step["others"], step["at"] + 1, F.size(step["others"]) + 1)
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(behind, "")), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda step: step["others"])), ""), 256)


def manifest(docs: DataFrame, *, tree_col: str = "lang", order_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """One row per document: tree, id, leaf, subroot, root, proof and the carried columns.

    A leaf hashes the named fields, each with its length in front.  The leaves of a tree (one for each value
    of tree_col) ascend by order_col; while there are several nodes, every `arity` consecutive ones become
    their digest, the last run being shorter, and what remains is the tree's subroot.  The subroots, ordered
    by tree, give the root in the same way.  proof is an array of (at, others), from the leaf to the root:
    the node's place in its run and the others of the run; folded() gives the root again.

    Bottom up, levels are persisted in tables whose rows hold blocks of at most BLOCK children with all
    levels above them; top down, blocks meet the proof of their uppermost node and children put their
    siblings before it.  No table has more rows than the one below, and the number of tables is the
    logarithm of the largest tree's size to the base BLOCK.

    Nulls: a null field is a dash, a null tree is the first tree, null order comes first.  Rows of equal
    order follow by leaf; wholly equal rows are leaves of their own whose places are interchangeable.  The
    empty text differs from null.  Texts of any length are hashed whole, one at a time.  A single leaf is
    its subroot, a single subroot the root.  An empty table gives an empty table.  Other columns of the
    input, whatever their names, are not looked at.
    """
    shape = Shape.of(arity)
    load = F.struct(F.col(f"`{order_col}`").alias("id"), *[c.alias(n) for n, c in (carry or {}).items()])
    leaves = docs.select(F.col(f"`{tree_col}`").alias("tree"), F.col(f"`{order_col}`").alias("order"), leaf_of(*[F.col(f"`{f}`") for f in fields]).alias("hash"), load.alias("load"))
    with scratch() as put:
        trees = grown(numbered(put(leaves, "merkle-leaves"), put), shape, cut, "merkle-levels")
    subroots = cut(tops(trees, shape), "merkle-subroots")
    with scratch() as put:
        rows = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("order"), "hash", F.struct("tree", "step").alias("load"))
        crown = grown(numbered(rows, put), shape, cut, "merkle-crown")
        step = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("others"))
        nothing = F.filter(F.array(step), lambda _: F.lit(False))
        root = tops(crown, shape).select("tree", "step", nothing.alias("proof"), F.col("hash").alias("heir"))
        heirs = pushed(crown, root, shape, put, "merkle-crown")
        ends = cut(heirs.select("load.tree", "load.step", "proof", F.struct(F.col("hash").alias("subroot"), F.col("heir").alias("root")).alias("heir")), "merkle-ends")
    for table in (*crown, subroots):
        drop_table(table)
    found = pushed(trees, ends, shape, cut, "merkle")
    return found.select("tree", "load.*", F.col("hash").alias("leaf"), "heir.subroot", "heir.root", "proof")
