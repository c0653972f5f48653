"""A Merkle manifest of a table: nodes are labelled by the interval of leaf ranks that they cover.

Leaves are ranked within a group (a tree), and every WIDTH consecutive nodes of a level become one above it. A node is
(grp, level, lo, hi, hash, children): the ranks lo to hi that it covers, and of each child the same. Ancestors and
siblings follow from intervals alone: an ancestor's interval contains the node's, and the siblings of a node are what
its parent's interval holds outside its own. So ancestors are attached from the root down, a level at a time, by a join
on (grp, the bucket lo div WIDTH^level) whose condition is containment: a bucket of a level is met by at most WIDTH
nodes of the level below, so no key is hot, and the path to the root is handed on only by what lies under it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

WIDTH = 8
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CHILD = "array<struct<lo:bigint,hi:bigint,hash:string,body:struct<doc_id:bigint,changed:string>>>"
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """- for null, else the count of its bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of a row's fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with rank, their place from 0 in their group in this order, and size, the rows of the group.

    Rows are sorted by ranges of (group, order) and written, so each part counts alone and is moved by what earlier
    parts hold of its group: no window spans more than the parts. Rows alike in all of order are told
    apart by their place in the input, so copies do not meet in one part.
    """
    spread = fresh(rows, "spread")
    at = [group, *(f"{spread}{i}" for i in range(len(order))), spread]
    keyed = rows.withColumns({**dict(zip(at[1:-1], order)), spread: F.monotonically_increasing_id()})
    parts = keyed.repartitionByRange(*at).sortWithinPartitions(*at).drop(*at[1:])
    placed = materialize(parts.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "manifest-leaves")
    held = placed.groupBy(group, "part").agg(F.count("*").alias("held"), F.min("row").alias("first"))
    by_part = Window.partitionBy(group).orderBy("part")
    ahead = F.coalesce(F.sum("held").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col(group).alias("of"), F.col("part").alias("in"), (ahead - F.col("first")).alias("shift"), F.sum("held").over(Window.partitionBy(group)).alias("size"))
    same = F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))
    return placed.join(held, same).withColumn("rank", F.col("row") + F.col("shift")).drop("of", "in", "part", "row", "shift")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of each level above the leaves, from the lowest: grp, level, lo, hi, size, hash, children, root.

    leaves: grp, rank, size, hash, body. A level holds only trees of which the level below has more than one node.
    """
    sizes = leaves.agg(F.max("size")).first()[0] or 0
    below = leaves.select("grp", "size", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "hash", "body")
    found: list[DataFrame] = []
    span = 1
    while sizes > span:
        child = F.struct("lo", "hi", "hash", "body")
        open_ = below.filter(F.col("size") > span).withColumn("bucket", F.floor(F.col("lo") / (span * WIDTH)))
        nodes = open_.groupBy("grp", "bucket").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(child)).cast(_CHILD).alias("children"))
        span *= WIDTH
        level = len(found) + 1
        nodes = nodes.select(
            "grp", F.lit(level).alias("level"), F.get("children", F.lit(0))["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), "size",
            F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), ""), 256).alias("hash"), "children", (F.col("size") <= span).alias("root"),
        )
        found.append(materialize(nodes, f"manifest-level-{level}"))
        below = found[-1].select("grp", "size", "lo", "hi", "hash", F.lit(None).cast("struct<doc_id:bigint,changed:string>").alias("body"))
    return found


def contains(outer: str, inner: str) -> Column:
    """Whether one node's interval holds another's."""
    return (F.col(f"{outer}.lo") <= F.col(f"{inner}.lo")) & (F.col(f"{inner}.hi") <= F.col(f"{outer}.hi"))


def _siblings(children: Column, lo: Column, hi: Column) -> Column:
    """left and right: hashes of what the parent's interval holds before and after this one."""
    joined = lambda keep: F.array_join(F.transform(F.filter(children, keep), lambda c: c["hash"]), "")
    return F.struct(joined(lambda c: c["hi"] < lo).alias("left"), joined(lambda c: c["lo"] > hi).alias("right"))


def subroots(leaves: DataFrame, found: list[DataFrame]) -> DataFrame:
    """of (a group), subroot: the hash that remains of each tree; a lone leaf is its own."""
    every = leaves.filter("size = 1").select(F.col("grp").alias("of"), F.col("hash").alias("subroot"))
    for nodes in found:
        every = every.unionByName(nodes.filter("root").select(F.col("grp").alias("of"), F.col("hash").alias("subroot")))
    return every


def paths(leaves: DataFrame, found: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """hash, body, subroot, root, path of every leaf (grp, rank, size, hash, body) under the nodes found.

    path holds, from the leaf's level up, the joined hashes of its siblings on either side. above (of, rest, root) is
    what follows a tree's root: its own siblings, and the root over all. Trees of one leaf have no level of their own.
    """

    def rooted(nodes: DataFrame) -> DataFrame:
        """Nodes that remain of their trees, a row a tree."""
        if above is None:
            return nodes.withColumns({"subroot": F.col("hash"), "root_hash": F.col("hash"), "path": F.array().cast(_PATH)})
        follows = above.select("of", F.col("rest").alias("path"), F.col("root").alias("root_hash"))
        return nodes.withColumn("subroot", F.col("hash")).join(follows, nodes["grp"].eqNullSafe(follows["of"])).drop("of")

    handed = ["subroot", "root_hash", "path"]
    child_path = F.concat(F.array(_siblings(F.col("children"), F.col("lo"), F.col("hi"))), "path").alias("path")
    known = None
    for level in range(len(found), 0, -1):
        nodes = found[level - 1].select("grp", "lo", "hi", "hash", "children", "root")
        mine = rooted(nodes.filter("root").drop("root"))
        if known is not None:
            # the children of the level above, each met by its own node: one bucket, and an interval within the child's
            bucket = lambda lo: F.floor(F.col(lo) / WIDTH**level)  # noqa: B023, E731
            down = known.select("grp", F.inline("children"), "children", *handed)
            down = down.select(F.col("grp").alias("of"), F.struct("lo", "hi").alias("outer"), bucket("lo").alias("at"), "subroot", "root_hash", child_path)
            own = nodes.filter("not root").drop("root").withColumns({"bucket": bucket("lo"), "inner": F.struct("lo", "hi")})
            under = own.join(down, own["grp"].eqNullSafe(down["of"]) & (F.col("bucket") == F.col("at")) & contains("outer", "inner"))
            mine = mine.select("grp", "lo", "hi", "hash", "children", *handed).unionByName(under.select("grp", "lo", "hi", "hash", "children", *handed))
        known = mine
    single = leaves.filter("size = 1").select("grp", "hash", "body")
    out = rooted(single).select("hash", "body", *handed)
    if known is not None:
        each = known.select(F.inline("children"), "children", *handed)
        out = out.unionByName(each.select("hash", "body", "subroot", "root_hash", child_path))
    return out.withColumnRenamed("root_hash", "root")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof(path: Column) -> Column:
    """The hash of all siblings from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def _bytewise(text: Column) -> Column:
    """Orders as the UTF-8 bytes do, whatever the collation; null is first."""
    return text.cast("binary")


def manifest(docs: DataFrame, changed: Column, where: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, path, changed of every row of docs (FIELDS, any others), a tree for each lang.

    changed is another text, and the column of that name the row's hash with it, for rows of which `where` holds; null for
    all others and for null texts. Within a lang leaves ascend by doc_id (null first), equal ones by their hash, so
    repeated rows are leaves of their own. Null and empty fields hash apart; texts are whole; a null lang is a tree of its
    own, and the first; an empty table gives none.
    """
    other = F.when(where & F.col("text").isNotNull(), leaf(*map(F.col, FIELDS[:-1]), changed))
    rows = docs.select(F.col("lang").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*map(F.col, FIELDS)).alias("hash"), other.alias("changed"))
    leaves = ranked(rows, "grp", F.col("doc_id"), F.col("hash")).select("grp", "rank", "size", "hash", F.struct("doc_id", "changed").alias("body"))
    found = levels(leaves)
    langs = subroots(leaves, found).select(F.lit("").alias("grp"), F.col("of").alias("changed"), F.col("subroot").alias("hash"))
    top = ranked(langs, "grp", _bytewise(F.col("changed"))).select("grp", "rank", "size", "hash", F.struct(F.lit(None).cast("long").alias("doc_id"), "changed").alias("body"))
    above = materialize(paths(top, levels(top)).select(F.col("body.changed").alias("of"), F.col("path").alias("rest"), "root"), "manifest-top")
    return paths(leaves, found, above).select("body.doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", "body.changed")
