"""Merkle manifest of a table: a tree a part, a tree over the parts' roots, proofs by coordinate.

A node is named by its coordinate (tree, level, idx). Since a tree's number of
leaves fixes how many nodes each level has, the coordinates that a proof needs
follow from a leaf's index and that number alone: no tree is walked. Every node
explodes the coordinates of its siblings, these are joined with the table of
nodes, and each node gets the digests left and right of it in order. All leaves
below a node need the same siblings of it, so they are looked up once per node
(15 rows a node at most, 16 a leaf over all levels) and handed down from a
node to its children, 16 at most: no coordinate is asked for by many rows.

Leaves get their index without a window over a part: rows are sorted over all
tasks by part and order, so an index is the place in the task's share of the
part plus what earlier tasks hold of it.

Defined results: a null field is ``-``; null parts and null ids come first; rows
alike in part and id stand in the order of their leaf, and rows alike in all
are interchangeable. One row, or one part, is its own root and has the digest
of the empty text as proof. An empty table gives no rows. Further columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import written

#: How many consecutive nodes make one of the next level.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value: no two lists of fields read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """The digest of a row's fields; ``changed`` gives fields other values."""
    return digest(*[field(changed.get(c, F.col(c))) for c in fields])


@dataclass
class Manifest:
    """``leaves`` and the ``levels`` above them (tree, idx, n: nodes of this tree on this level, digest) and the same over the trees' roots, as tree 0."""

    levels: list[DataFrame]
    top: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, digest) of each part's root."""
        return tops(self.levels)


def tops(levels: list[DataFrame]) -> DataFrame:
    """The nodes that stand alone on their level."""
    return reduce(DataFrame.unionByName, [x.where("n = 1").select("tree", "digest") for x in levels])


def numbered(rows: DataFrame, part: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``tree`` (number of the part, from 0), ``idx`` (place in it by ``order``) and ``n`` (its size). ``rows`` must be a written table."""
    by = [F.col(part).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    placed = written(dealt.withColumn("place", F.monotonically_increasing_id()), "sorted").withColumn("task", F.shiftright("place", 33))
    runs = placed.groupBy("task", part).agg(F.count(F.lit(1)).alias("held"), F.min("place").alias("begin"))
    of_part = Window.partitionBy(part)
    ahead = of_part.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("task", part, "held", "begin", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"), F.sum("held").over(of_part).alias("n"))
    runs = written(runs.withColumn("opens", (F.col("before") == 0).cast("long")), "runs")
    # a task holds few parts or few rows of each; one row a task is left for the window over all tasks
    tasks = runs.groupBy("task").agg(F.sum("opens").alias("opened"))
    earlier = tasks.select("task", F.coalesce(F.sum("opened").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    in_task = Window.partitionBy("task").orderBy(F.col(part).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    opening = runs.withColumn("at", F.sum("opens").over(in_task) - 1).join(earlier, "task").withColumn("number", F.when(F.col("opens") == 1, F.col("at") + F.col("earlier")))
    told = opening.select(F.col("task").alias("_task"), F.col(part).alias("_part"), "begin", "before", "n", F.max("number").over(of_part).alias("tree"))
    both = placed.join(told, (F.col("task") == F.col("_task")) & F.col(part).eqNullSafe(F.col("_part")))
    return both.select("tree", (F.col("before") + F.col("place") - F.col("begin")).alias("idx"), "n", *rows.columns)


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The leaves and the tables of nodes above them, each written, until every tree has one node."""
    out, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        above = out[-1].where("n > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("idx")).agg(digest(F.array_join(ordered, "")).alias("digest"), F.expr(f"(max(n) + {FAN - 1}) div {FAN}").alias("n"))
        out.append(written(above, "nodes"))
        most = math.ceil(most / FAN)
    return out


def build(rows: DataFrame, part: str = "source", order: Sequence[str] = ("doc_id", "digest")) -> Manifest:
    """The manifest of ``rows``: ``part``, the columns of ``order``, ``digest`` and whatever leaves shall carry."""
    leaves = written(numbered(written(rows, "digests"), part, order), "leaves")
    trees = levels(leaves)
    roots = written(tops(trees).select("tree", "digest"), "roots")
    # parts are numbered in their order, so a root's index in the tree over the parts is its tree's number
    n = roots.count()
    return Manifest(trees, levels(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("n"), "digest")))


def siblings(nodes: DataFrame) -> DataFrame:
    """(tree, idx, step): what stands left and right of a node in its run, by exploding the coordinates and looking them up."""
    begin = F.col("idx") - F.col("idx") % FAN
    coordinates = F.sequence(begin, F.least(begin + FAN - 1, F.col("n") - 1))
    asked = nodes.where("n > 1").select("tree", "idx", F.explode(coordinates).alias("at")).where("at <> idx")
    found = asked.join(nodes.select("tree", F.col("idx").alias("at"), F.unhex("digest").alias("digest")), ["tree", "at"])
    runs = found.groupBy("tree", "idx").agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run"))
    side = lambda cond: F.array_join(F.transform(F.filter("run", cond), lambda x: F.lower(F.hex(x["digest"]))), "")
    step = F.struct(side(lambda x: x["at"] < F.col("idx")).alias("left"), side(lambda x: x["at"] > F.col("idx")).alias("right"))
    return runs.select("tree", "idx", step.alias("step"))


_PATH = "array<struct<left:string,right:string>>"


def handed_down(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The lowest level with ``path`` (steps from a node up to the root), ``subroot`` (its own tree's) and ``root``.

    ``above``: (tree, path, root) of each tree's root in the tree over it; none: the tree's root is the root.
    """
    known = None
    for nodes in reversed(levels):
        alone = nodes.where("n = 1").withColumn("subroot", F.col("digest"))
        if above is None:
            here = alone.withColumns({"path": F.array().cast(_PATH), "root": F.col("digest")})
        else:
            here = alone.join(above, "tree")
        if known is not None:
            parents = known.select("tree", F.col("idx").alias("parent"), F.col("path").alias("rest"), "subroot", "root")
            # a node alone in its run has no siblings
            step = F.coalesce("step", F.struct(F.lit("").alias("left"), F.lit("").alias("right")))
            lower = nodes.where("n > 1").join(siblings(nodes), ["tree", "idx"], "left").withColumn("parent", F.expr(f"idx div {FAN}"))
            lower = lower.join(parents, ["tree", "parent"]).withColumn("path", F.concat(F.array(step), "rest")).drop("step", "rest", "parent")
            here = lower.unionByName(here.select(*lower.columns))
        known = here
    return known


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its ``path`` to the root, ``subroot`` and ``root``."""
    upper = handed_down(manifest.top).select(F.col("idx").alias("tree"), "path", "root")
    return handed_down(manifest.levels, upper)


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(start: Column, path: str = "path") -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda acc, x: digest(x["left"], acc, x["right"]))


def verified(documents: DataFrame, presented: Column, fields: Sequence[str] = FIELDS, part: str = "source", order: str = "doc_id") -> DataFrame:
    """Per row: leaf, subroot, root, digest of the proof, and whether the ``presented`` leaf (null: the row's own) folds to the root."""
    rows = documents.select(F.col(part).alias("part"), F.col(order).alias("doc_id"), leaf(fields).alias("digest"), presented.alias("presented"))
    told = proofs(build(rows, "part", ("doc_id", "digest"))).withColumn("folded_root", folded(F.coalesce("presented", "digest")))
    return told.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
