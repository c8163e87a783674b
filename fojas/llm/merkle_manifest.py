"""A Merkle manifest of a dataset: one digest proves that no row was changed, lost or added.

Rows are leaves, ordered within their group. A level is a table (g, i, n, h): node i of the n that group g
has there. Each level equijoins its nodes with their siblings' computed places - i XOR 1 where runs are of
two, else the run's other slots by their offsets - and the rows in slot zero emit the parents. The nodes
left, one a group, are the leaves of a tree over the groups. Back down, every node takes its own siblings
in front of its parent's, so a leaf's proof is the list of what stands left and right of it, level by level.

Keys of the joins are (group, place), so a group of any size is spread evenly; levels and paths are
written to the shared folder. The driver learns how high the trees are and the root, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fojas.llm.common import written

#: Levels joined in one job on the way down.
STRIDE = 6
PATH = "array<struct<left string, right string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another; digests count as their hex text."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(*columns: Column) -> Column:
    """One string per group that sorts as the columns do: nulls first, strings bytewise (for a single column)."""
    marked = [F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0")) for c in columns]
    return marked[0] if len(marked) == 1 else F.concat(*[F.concat(F.length(m).cast("string"), F.lit(":"), m) for m in marked])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """(g, ...) plus ``i``, the row's place in its group from 0, and ``n``, the group's rows.

    Rows are dealt in ranges of (g, order) and places are counted by range, so no group is gathered. Rows
    equal in all of ``order`` are dealt over several ranges as well; which of them comes first is open.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["g", *order, "tie_"]
    dealt = rows.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("tie_")
    dealt = written(dealt.withColumn("at_", F.monotonically_increasing_id()), "ordered").withColumn("range_", F.shiftright("at_", 33))
    runs = dealt.groupBy("g", "range_").agg(F.min("at_").alias("from_"), F.count("*").alias("n_"))  # ranges + groups rows
    group = Window.partitionBy("g")
    runs = runs.withColumn("n", F.sum("n_").over(group)).withColumn("before_", F.sum("n_").over(group.orderBy("range_")) - F.col("n_"))
    return dealt.join(runs, ["g", "range_"]).withColumn("i", F.col("at_") - F.col("from_") + F.col("before_")).drop("at_", "range_", "from_", "n_", "before_")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes plus ``left`` and ``right``: the digests of the run's nodes before and after, one after another."""
    slot = F.col("i") % fanout
    left, right = [], []
    for step in range(1, fanout):
        if fanout == 2:
            place = F.col("i").bitwiseXOR(F.lit(1).cast("long"))
        else:  # of the node that looks ``step`` slots ahead, round the run's end
            place = F.col("i") - slot + F.pmod(slot - step, F.lit(fanout))
        other = nodes.select("g", place.cast("long").alias("i"), F.col("h").alias(f"h{step}_"))
        nodes = nodes.join(other, ["g", "i"], "left")
        found = F.coalesce(F.col(f"h{step}_"), F.lit(""))
        left.append(F.when(slot + step >= fanout, found).otherwise(""))
        right.append(F.when(slot + step < fanout, found).otherwise(""))
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)}).drop(*[f"h{step}_" for step in range(1, fanout)])


class Tree:
    """The levels of a forest, a tree for each group, and its roots (g, depth, h)."""

    def __init__(self, leaves: DataFrame, fanout: int):
        """``leaves``: (g, i, n, h, ...), with places as ``numbered`` gives them; other columns stay at the leaves."""
        if fanout < 2:
            raise ValueError("a run has two nodes at least")
        self.fanout, self.levels, self.leaves = fanout, [], written(leaves, "leaves")
        widths = [fanout**j for j in range(63) if fanout**j < 2**62]
        height = F.expr(f"size(filter(array({', '.join(f'{w}L' for w in widths)}), w -> n > w))")
        #: The depths at which some tree ends: one for each level at most.
        self.ends = {r[0] for r in self.leaves.filter("i = 0").select(height).distinct().collect()}
        nodes, roots = self.leaves, self.leaves.limit(0).select("g", F.lit(0).alias("depth"), "h")
        for depth in range(max(self.ends, default=0) + 1):
            if depth in self.ends:
                roots = roots.unionByName(nodes.filter("n = 1").select("g", F.lit(depth).alias("depth"), "h"))
            if depth == max(self.ends, default=0):
                break
            level = written(with_siblings(nodes.filter("n > 1"), fanout), f"level{depth}")
            self.levels.append(level)
            nodes = level.filter(F.col("i") % fanout == 0).select(
                "g", (F.col("i") / fanout).cast("long").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), digest(F.col("h"), F.col("right")).alias("h"),
            )
        self.roots = written(roots, "roots")

    def paths(self, tops: DataFrame) -> DataFrame:
        """The leaves plus ``path`` and all columns of ``tops`` but ``path``'s own end.

        ``tops`` has one row for each root: g, path (what follows above the root) and more columns.
        """
        more = [c for c in tops.columns if c not in ("g", "path")]
        tops = written(self.roots.select("g", "depth").join(tops, "g"), "tops")
        below = lambda depth: tops.filter(F.col("depth") == depth).select("g", F.lit(0).cast("long").alias("i"), "path", *more)
        up = below(len(self.levels))
        for depth in reversed(range(len(self.levels))):
            up = up.withColumnsRenamed({"i": "above_", "path": "path_"})
            level = self.levels[depth].withColumn("above_", (F.col("i") / self.fanout).cast("long")).join(up, ["g", "above_"])
            path = F.concat(F.array(F.struct("left", "right")), F.col("path_"))
            level = level.withColumn("path", path).drop("above_", "path_", "left", "right")
            if depth:
                up = level.select("g", "i", "path", *more)
                up = up.unionByName(below(depth)) if depth in self.ends else up
                up = written(up, f"paths{depth}") if depth % STRIDE == 0 else up
        single = self.leaves.filter("n = 1").join(below(0).drop("i"), "g")
        return level.unionByName(single) if self.levels else single


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["left"], h, x["right"]))


def manifest(leaves: DataFrame, order: list[str], fanout: int = 2) -> DataFrame:
    """(g, h, ...) to the same rows plus i, n, path array<struct<left, right>>, subroot and root.

    Leaves ascend by ``order`` within g, nulls first, and at the end by their digest, so equal rows are
    the only ties. While several nodes remain, each run of ``fanout`` (the last may be shorter, even one)
    becomes the digest of its nodes; a lone leaf is its group's subroot. Subroots in order of g give the
    root in the same way. A table without rows has no root and gives no rows.
    """
    if {"i", "n", "path", "subroot", "root", "left", "right"} & set(leaves.columns):
        raise ValueError("the leaves' own columns must not be named like those added")
    tree = Tree(numbered(leaves, [*order, "h"]), fanout)
    groups = tree.roots.select(F.lit("").alias("g"), F.col("g").alias("group"), "h")
    forest = Tree(numbered(groups, ["group"]), fanout)
    root = forest.roots.first()
    tops = forest.paths(forest.roots.select("g", F.array().cast(PATH).alias("path")))
    tops = tops.select(F.col("group").alias("g"), "path", F.col("h").alias("subroot"), F.lit(root["h"] if root else None).cast(T.StringType()).alias("root"))
    return tree.paths(tops)


def document_leaf(n_chars: Column | None = None) -> Column:
    """The leaf of a row of documents, with another ``n_chars`` if one is given."""
    count = F.col("n_chars") if n_chars is None else n_chars
    return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), count, F.col("text"))])


def verified(docs: DataFrame, tampered: Column, fanout: int = 2) -> DataFrame:
    """Rows (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Groups are languages. For rows where ``tampered`` holds, the leaf folded along the path has n_chars + 1
    in place of n_chars. Any column may be null (a null doc_id comes first and is not an error); texts of
    any length are hashed whole; rows that repeat are leaves each; without rows there are none; other
    columns are not read.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    bent = F.when(F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull(), document_leaf(more))
    rows = docs.select("doc_id", group_key(F.col("lang")).alias("g"), document_leaf().alias("h"), bent.alias("bent"))
    rows = manifest(written(rows, "digests"), ["doc_id"], fanout)
    fold = folded(F.coalesce("bent", "h"), F.col("path"))
    rows = rows.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
