"""Merkle manifest of a dataset: a tree of digests per source, one tree over the sources' roots, a proof per row.

Every level of a tree is a table of nodes (tree, number, digest). A node's siblings are found by equi-joins of the level with
itself on computed sibling numbers: one join on ``number xor 1`` for binary trees, else one per slot offset. Rows in slot
zero then emit the parents. All trees of a table climb together; a tree is done when its node 0 has no sibling. Levels
shrink by the fan-out, so the whole climb exchanges about ``fanout / (fanout - 1)`` times the leaves, which are 32 bytes and a few numbers
each. Keys are (tree, number) pairs, so a source with a third of all rows spreads like any other.

Proofs come down the same tables: each node takes its siblings and joins its parent's proof, level by level, so a row's
siblings are never gathered by a group. Levels are written to the shared folder; texts are read once, for the digests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import stored

FIELDS, FANOUT = ("doc_id", "source", "lang", "n_chars", "text"), 3
_DIGEST = 32
_TREE = "manifest"


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (32 bytes) of the values: each ``-`` if null, else its UTF-8 length in bytes, ``:`` and its text."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return _sha(F.concat(*[part(v) for v in values]))


def tree_key(source: Column) -> Column:
    """A string that orders sources by their bytes, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def numbered(rows: DataFrame, order: list[str], tree: str = "tree") -> DataFrame:
    """The rows with ``number``: 0, 1, ... in each tree, ascending by ``order``; written out.

    Rows are sorted by range partitions; only counts per partition and tree are added up, so no tree passes through one task.
    Ties in ``order`` must be indifferent.
    """
    keys = [tree, *order]
    at = stored(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33).cast("int")),
        "sorted", compression="zstd",
    )
    runs = at.groupBy("part", tree).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select("part", tree, (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    met = at.join(shift, ["part", tree])
    return stored(met.select(*rows.columns, (F.col("place") + F.col("shift")).alias("number")), "numbered", compression="zstd")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes (tree, number, digest) with ``slot``, ``run``, ``siblings`` (their digests, left to right) and ``top`` (no parent).

    A level meets itself on the number each sibling must have.
    """
    number = F.col("number")
    slot = (number % fanout).cast("int")
    level = nodes.select("tree", "number", "digest", slot.alias("slot"), ((number - slot) / fanout).cast("long").alias("run"))
    met = level
    for shift in range(1, fanout):
        sought = F.col("number").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("number") - F.col("slot") + (F.col("slot") + shift) % fanout
        other = nodes.select(F.col("tree").alias("_tree"), F.col("number").alias("_number"), F.col("digest").alias(f"_digest{shift}"))
        met = met.withColumn("_sought", sought).join(other, (F.col("tree") == F.col("_tree")) & (F.col("_sought") == F.col("_number")), "left")
        met = met.drop("_tree", "_number", "_sought")
    none = F.lit(b"")
    # shift s leads to slot + s, or around to slot + s - fanout
    left = [F.when(F.col("slot") + s >= fanout, F.col(f"_digest{s}")) for s in range(1, fanout)]
    right = [F.when(F.col("slot") + s < fanout, F.col(f"_digest{s}")) for s in range(1, fanout)]
    siblings = F.concat(*[F.coalesce(c, none) for c in (*left, *right)])
    return met.select(
        "tree", "number", "digest", "slot", "run", siblings.alias("siblings"),
        ((F.col("number") == 0) & (F.length(siblings) == 0)).alias("top"),
    )


def folded(digest: Column, slot: Column, siblings: Column) -> Column:
    """The parent's digest, from a node's own and its siblings'."""
    left, right = F.substring(siblings, F.lit(1), slot * _DIGEST), F.substring(siblings, slot * _DIGEST + 1, F.lit(1 << 30))
    return _sha(_hex(F.concat(left, digest, right)))


def climb(leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """The levels from the leaves (tree, number, digest) up, as written tables, until every tree has one node."""
    levels = []
    nodes = leaves.select("tree", "number", "digest")
    while True:
        level = stored(with_siblings(nodes, fanout), f"{name}-{len(levels)}", compression="zstd")
        levels.append(level)
        open_ = level.where("slot = 0 and not top")
        if open_.isEmpty():
            return levels
        nodes = open_.select("tree", F.col("run").alias("number"), folded(F.col("digest"), F.col("slot"), F.col("siblings")).alias("digest"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest, level): the one remaining node of every tree."""
    found = [level.where("top").select("tree", "digest", F.lit(i).alias("level")) for i, level in enumerate(levels)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, number, subroot, root, path) of the leaves.

    ``above``: (tree, level, subroot, root, path) of the trees' tops. A path lists (slot, siblings) from the leaf to the root.
    """
    step = F.array(F.struct("slot", "siblings"))
    carried = None
    for i in range(len(levels) - 1, -1, -1):
        here = above.where(F.col("level") == i).select("tree", F.lit(0).cast("long").alias("number"), "subroot", "root", "path")
        if carried is not None:
            parents = carried.select(F.col("tree").alias("_tree"), F.col("number").alias("_run"), "subroot", "root", F.col("path").alias("_path"))
            inner = levels[i].where("not top").join(parents, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run")))
            here = inner.select("tree", "number", "subroot", "root", F.concat(step, "_path").alias("path")).unionByName(here)
        carried = here
    return carried


@dataclass
class Manifest:
    """``leaves``: (tree, number, digest, ...) with the columns carried along; ``levels`` are the sources' trees, ``upper`` is the tree over
    ``upper_leaves`` (source_tree, number, digest). All are written out."""

    leaves: DataFrame
    levels: list[DataFrame]
    upper_leaves: DataFrame
    upper: list[DataFrame]

    def proofs(self) -> DataFrame:
        """The leaves with ``subroot``, ``root`` and ``path``, an array of (slot, siblings) from leaf to root."""
        ends = tops(self.upper).select("tree", "level", F.col("digest").alias("root"))
        seeds = ends.select("tree", "level", F.lit(None).cast("binary").alias("subroot"), "root", F.array().cast("array<struct<slot:int,siblings:binary>>").alias("path"))
        over = descend(self.upper, seeds).select(F.col("number").alias("_number"), "root", "path")
        # subroots in the order of their sources are the leaves of the upper tree
        named = self.upper_leaves.select(F.col("source_tree").alias("tree"), F.col("number").alias("_number"), F.col("digest").alias("subroot"))
        above = tops(self.levels).select("tree", "level").join(named, "tree").join(over, "_number").select("tree", "level", "subroot", "root", "path")
        paths = descend(self.levels, stored(above, "subroots"))
        return self.leaves.join(paths.withColumnsRenamed({"tree": "_tree", "number": "_number"}), (F.col("tree") == F.col("_tree")) & (F.col("number") == F.col("_number"))).drop("_tree", "_number")


def build(rows: DataFrame, fanout: int = FANOUT) -> Manifest:
    """A manifest of rows (tree, key, digest, ...): leaves ascend by ``key`` in each tree, null first.

    Rows with equal keys ascend by digest; rows equal in both are interchangeable. Other columns are carried along. An empty table has a
    manifest without rows.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fan-out of at least 2")
    leaves = numbered(stored(rows, "leaves", compression="zstd"), ["key", "digest"])
    levels = climb(leaves, fanout, "level")
    roots = tops(levels).select(F.lit(_TREE).alias("tree"), F.col("tree").alias("source_tree"), "digest")
    upper_leaves = numbered(roots, ["source_tree"])
    return Manifest(leaves, levels, upper_leaves, climb(upper_leaves, fanout, "upper"))


def folded_root(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, digest, lambda d, p: folded(d, p["slot"], p["siblings"]))


def proof_digest(path: Column) -> Column:
    """SHA-256, as hex, of all siblings' hex digests from leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: _hex(p["siblings"])), "").cast("binary"), 256)


def document_manifest(docs: DataFrame, fanout: int = FANOUT, fields: tuple[str, ...] = FIELDS, source: str = "source", key: str = "doc_id", altered: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, altered_leaf, subroot, root, path) of every row; digests have 32 bytes.

    ``altered`` replaces fields to compute ``altered_leaf``, the digest of a changed row; without it both are equal. Nulls in any
    field count as such in the digests; a null source is a source of its own, which comes first. Texts of any length are hashed whole.
    Repeated rows are leaves of their own. Further columns of the input are ignored.
    """
    changed = altered or {}
    own = [F.col(f"`{f}`") for f in fields]
    rows = docs.select(
        tree_key(F.col(f"`{source}`")).alias("tree"), F.col(f"`{key}`").alias("key"), leaf_digest(*own).alias("digest"),
        leaf_digest(*[changed.get(f, c) for f, c in zip(fields, own, strict=True)]).alias("altered"),
    )
    return build(rows, fanout).proofs().select(F.col("key").alias(key), F.col("digest").alias("leaf"), F.col("altered").alias("altered_leaf"), "subroot", "root", "path")
