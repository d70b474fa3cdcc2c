"""Merkle manifest of a table: one tree for each group of rows, one tree over their roots.

A row's leaf is the sha256 of its fields, each as byte count, colon and value, or `-` for null.
In a group the leaves ascend by id, and while a tree has more than one node, every `FANOUT`
consecutive ones (the last run may be shorter, even one) become the sha256 of their digests in
hexadecimal. Group roots, ordered by group with null first, are the leaves of the last tree.

A level is a slot pivot: conditional aggregates spread the children of each parent over one
column for every slot. All columns in a row, concatenated, hash to the parent; the columns
without a child's own are its siblings. Paths run down from the root: the table of a level
holds the path above each node once, and only the leaves carry it for every row.

Positions come from rows that are sorted in ranges of (group, id) and written, plus an offset
for each group and range, so no group has to fit in one task. A parent has at most `FANOUT`
children, and no later step is keyed by group alone but for one row of each group. Joins with a
table of paths are sorted ones at every size: its files are a hundredth of its rows in memory, as
the digests of siblings repeat, so their size would have Spark gather it in the driver.

Defined cases: a null in any field, the id and the group included, is hashed as `-`; null ids
come first; equal ids, also of repeated rows, are ordered by leaf, which makes the tree the same
whatever order they are read in; texts of any length are hashed whole; a group of one row has
its leaf as root, and where all rows are one there are no siblings, whose hash is that of the
empty text; an empty table gives no rows. Columns of any name may follow.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskscope.scaling import join_on
from riskscope.session import materialise

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SLOTS = [f"c{i}" for i in range(FANOUT)]
# A task's number in the positions that Spark gives to rows, above the row's own.
_TASK_BITS = 33


def leaf_hash(fields: Sequence[Column]) -> Column:
    """sha256 over the fields, each as UTF-8 byte count, colon, value; null is a dash."""
    values = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


@dataclass
class Tree:
    """leaves: tree, at, pos, n, node and further columns; levels: tree, pos, n, node and the slots of the children."""

    leaves: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, node) of each tree."""
        found = self.leaves.where("n = 1").select("tree", "node")
        for level in self.levels:
            found = found.union(level.where("n = 1").select("tree", "node"))
        return found


def _placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `pos`, the place from 0 in the tree, and `n`, the tree's nodes; both hold for the stored rows.

    The last order is the place where a row was read, which only parts equal rows.
    """
    by = [F.col(c).asc_nulls_first() for c in ["tree", *order, "__read"]]
    stored = materialise(nodes.withColumn("__read", F.monotonically_increasing_id()))
    ranged = stored.repartitionByRange(*by).sortWithinPartitions(*by).drop("__read")
    stored = materialise(ranged.withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", _TASK_BITS)
    runs = stored.groupBy("tree", task.alias("task")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "tree", "task", (F.col("first") - F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("from"), F.sum("size").over(whole).alias("n")
    )
    placed = join_on(stored.withColumn("task", task), runs, ["tree", "task"])
    return placed.withColumn("pos", F.col("at") - F.col("from")).drop("task", "from")


def _level(nodes: DataFrame) -> DataFrame:
    """The parents of the nodes of unfinished trees, with their children spread over the slots."""
    slot = F.col("pos") % FANOUT
    spread = [F.max(F.when(slot == i, F.col("node"))).alias(c) for i, c in enumerate(_SLOTS)]
    parents = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos"), "n").agg(*spread)
    return parents.withColumn("n", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}")).withColumn(
        "node", F.sha2(F.concat_ws("", *_SLOTS), 256)
    )


def build(nodes: DataFrame, order: Sequence[str]) -> Tree:
    """The trees over `nodes` (tree, node, the columns of `order`, further ones), each level written once."""
    leaves = materialise(_placed(nodes, order))
    most = leaves.agg(F.max("n")).head()[0] or 0
    levels, below = [], leaves
    while most > 1:
        below = materialise(_level(below))
        levels.append(below)
        most = -(-most // FANOUT)
    return Tree(leaves, levels)


def _step(slot: Column) -> Column:
    """The siblings of one slot: digests to the left and to the right, in order."""
    side = lambda keep: F.concat_ws("", *[F.when(keep(i), F.col(c)) for i, c in enumerate(_SLOTS)])
    return F.array(F.struct(side(lambda i: slot > i).alias("l"), side(lambda i: slot < i).alias("r")))


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves with `path`, the siblings on the way to the top, and what `above` says of their tree.

    `above` holds one row for each tree: tree, path (the way on from its root) and further columns.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    above = above.hint("merge")
    known = None
    for level in reversed(tree.levels):
        found = join_on(level.where("n = 1"), above, ["tree"])
        if known is not None:
            child = F.posexplode(F.array(*_SLOTS)).alias("slot", "child")
            down = known.select("*", child).where("child IS NOT NULL")
            down = down.select(
                "tree",
                (F.col("pos") * FANOUT + F.col("slot")).alias("pos"),
                F.concat(_step(F.col("slot")), F.col("path")).alias("path"),
                *extra,
            )
            found = found.unionByName(join_on(level.where("n > 1"), down.hint("merge"), ["tree", "pos"]))
        known = materialise(found.drop("node", "n"))
    lone = join_on(tree.leaves.where("n = 1"), above, ["tree"])
    if known is None:
        return lone
    placed = tree.leaves.where("n > 1").withColumn("slot", (F.col("pos") % FANOUT).cast("int"))
    placed = placed.withColumn("own", F.col("pos")).withColumn("pos", F.expr(f"pos div {FANOUT}"))
    joined = join_on(placed, known.hint("merge"), ["tree", "pos"])
    joined = joined.withColumn("path", F.concat(_step(F.col("slot")), F.col("path"))).withColumn("pos", F.col("own"))
    return lone.unionByName(joined.drop("slot", "own", *_SLOTS))


def proof_hash(path: Column) -> Column:
    """sha256 of all digests on the path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def manifest_proofs(
    docs: DataFrame,
    id_column: str = "doc_id",
    group: str = "source",
    fields: Sequence[str] = FIELDS,
    presented: Sequence[Column] | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, path, presented) of every row.

    `presented` stands for the fields as somebody else holds them; it is their leaf, and the row
    itself where none are given. Fold it along `path` and compare with `root` to verify it.
    """
    own = [F.col(f"`{f}`") for f in fields]
    leaves = docs.select(
        F.col(f"`{group}`").alias("tree"),
        F.col(f"`{id_column}`").alias("__id"),
        leaf_hash(own).alias("node"),
        leaf_hash(own if presented is None else presented).alias("presented"),
    )
    tree = build(leaves, ["__id", "node"])
    tops = build(tree.roots().select(F.lit(0).alias("tree"), F.col("tree").alias("group"), "node"), ["group"])
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    top = tops.roots().select("tree", F.col("node").alias("root"), nothing.alias("path"))
    above = paths(tops, top).select(F.col("group").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    found = paths(tree, materialise(above))
    return found.select(F.col("__id").alias(id_column), F.col("node").alias("leaf"), "subroot", "root", "path", "presented")
