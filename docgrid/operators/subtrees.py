"""Subtrees: digests from the leaves up, equal ones found, and two trees compared from the root down.

Trees are tables (doc, node, parent, and fields of their own); node names are unique within a doc. Levels are folders of a
table, and each step reads those of its own level only and writes what it made, so no lineage grows with the depth and
each node is handled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import forget, written
from .recursion import DEEPEST, recursive

#: Parts in which the digests of one node's children are gathered first.
PARTS = 256


def levelled(nodes: DataFrame) -> DataFrame:
    """nodes with level: 0 for roots. Nodes under no root, those of cycles among them, are left out."""
    ids = nodes.select("doc", "node", "parent")
    start = ids.where("parent is null").select("doc", "node", F.lit(0).alias("level"))
    levels = recursive(start, ids, "t.doc <=> e.doc AND t.node = e.parent", DEEPEST, node="e.node", level="t.level + 1")
    own = levels.select(F.col("doc").alias("_doc"), F.col("node").alias("_node"), "level")
    return written(nodes.join(own, nodes["doc"].eqNullSafe(own["_doc"]) & (nodes["node"] == own["_node"])).drop("_doc", "_node"), "level")


def _gathered(children: DataFrame) -> DataFrame:
    """(doc, parent, kids, size): a digest of the children's digests, whatever their order. Equal digests are counted and
    the distinct ones gathered in parts by their first digits, so no task holds all children of a node."""
    counted = children.groupBy("doc", "parent", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    part = F.conv(F.substring("digest", 1, 2), 16, 10).cast("int") % PARTS
    listed = lambda *c: F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*c)))), 256)
    parts = counted.groupBy("doc", "parent", part.alias("part")).agg(listed("digest", "n").alias("digest"), F.sum("size").alias("size"))
    return parts.groupBy(F.col("doc").alias("_doc"), F.col("parent").alias("_node")).agg(listed("part", "digest").alias("_kids"), F.sum("size").alias("_size"))


def digests(nodes: DataFrame, fields: list[Column]) -> DataFrame:
    """nodes with level, digest (of the node's fields and its children's digests) and size (the nodes of its subtree)."""
    own = levelled(nodes.withColumn("_own", F.to_json(F.struct(*[f.alias(f"f{k}") for k, f in enumerate(fields)]))))
    deepest = own.agg(F.max("level")).first()[0]
    done: list[DataFrame] = []
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = own.where(F.col("level") == level)
        if done:
            kids = _gathered(done[-1])
            here = here.join(kids, here["doc"].eqNullSafe(kids["_doc"]) & (here["node"] == kids["_node"]), "left").drop("_doc", "_node")
        else:
            here = here.withColumns({"_kids": F.lit(None).cast("string"), "_size": F.lit(None).cast("bigint")})
        made = here.withColumns({"digest": F.sha2(F.concat_ws("|", "_own", "_kids"), 256), "size": (F.coalesce("_size", F.lit(0)) + 1).cast("bigint")})
        done.append(written(made.drop("_kids", "_size", "_own")))
    if not done:
        return own.drop("_own").withColumns({"digest": F.lit(None).cast("string"), "size": F.lit(None).cast("bigint")})
    found = written(reduce(DataFrame.unionByName, done), "level")
    for table in [*done, own]:
        forget(table)
    return found


def equal_subtrees(digested: DataFrame) -> DataFrame:
    """(digest, size, copies, doc, node): each subtree that occurs more than once, with its first place. Subtrees within
    larger equal ones are not told again."""
    many = digested.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.min(F.struct("doc", "node")).alias("first")).where("copies > 1")
    # A subtree whose every copy lies in a copy of one larger subtree goes with it.
    up = digested.select(F.col("doc").alias("_doc"), F.col("node").alias("_node"), F.col("digest").alias("_up"))
    above = digested.join(up, digested["doc"].eqNullSafe(up["_doc"]) & (digested["parent"] == up["_node"]), "left")
    over = above.groupBy("digest").agg(F.count_distinct(F.coalesce("_up", F.lit(""))).alias("_kinds"), F.max("_up").alias("_up"))
    repeated = many.select(F.col("digest").alias("_up"))
    inner = over.where("_kinds = 1 and _up is not null").join(repeated, "_up", "left_semi").select("digest")
    return many.join(inner, "digest", "left_anti").select("digest", "size", "copies", "first.doc", "first.node")


def _labelled(kids: DataFrame, pair: list[str], label: str) -> DataFrame:
    """Children numbered among those of one label, in the order of their digests."""
    return kids.withColumn("_nth", F.row_number().over(Window.partitionBy(*pair, label).orderBy("digest", "node")))


def _rounds(left: DataFrame, right: DataFrame, label: str, own: str) -> Iterator[DataFrame]:
    """The differing nodes level by level: (doc, l_node, r_node, what; equal if only something below differs)."""

    def side(df: DataFrame, level: int, name: str) -> DataFrame:
        return df.where(F.col("level") == level).select(F.col("doc").alias("_doc"), "node", "parent", "digest", label, F.col(own).alias("_own_" + name))

    pairs, level = None, 0
    while True:
        a, b = side(left, level, "l"), side(right, level, "r")
        on = ["_doc"]
        if pairs is not None:
            opened = pairs.where("l_node is not null and r_node is not null").select("doc", "l_node", "r_node")
            child = lambda df, n: df.join(opened, df["_doc"].eqNullSafe(opened["doc"]) & (df["parent"] == opened[n])).drop("doc", "parent")
            on = ["_doc", "l_node", "r_node"]
            a, b = child(a, "l_node"), child(b, "r_node")
        # Siblings with equal digests go first, so that what differs is matched with what differs.
        copies = lambda df: df.withColumn("_copy", F.row_number().over(Window.partitionBy(*on, label, "digest").orderBy("node")))
        a, b, shared = copies(a), copies(b), [*on, label, "digest", "_copy"]
        less = lambda x, y: x.join(y.select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(shared)]), [F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(shared)], "left_anti")
        at, bt = _labelled(less(a, b), on, label), _labelled(less(b, a), on, label)
        keys = [*on, label, "_nth"]
        x = at.select(*[F.col(c).alias(f"_a{k}") for k, c in enumerate(keys)], F.col("node").alias("_ln"), F.col("digest").alias("_ld"), "_own_l")
        y = bt.select(*[F.col(c).alias(f"_b{k}") for k, c in enumerate(keys)], F.col("node").alias("_rn"), F.col("digest").alias("_rd"), "_own_r")
        met = x.join(y, [F.col(f"_a{k}").eqNullSafe(F.col(f"_b{k}")) for k in range(len(keys))], "full").where("not (_ld <=> _rd)")
        what = F.when(F.col("_ln").isNull(), "added").when(F.col("_rn").isNull(), "removed").when(F.col("_own_l").eqNullSafe(F.col("_own_r")), "equal").otherwise("changed")
        doc = F.when(F.col("_ln").isNull(), F.col("_b0")).otherwise(F.col("_a0"))
        pairs = written(met.select(doc.alias("doc"), F.col("_ln").alias("l_node"), F.col("_rn").alias("r_node"), what.alias("what")))
        if pairs.isEmpty():
            forget(pairs)
            return
        yield pairs
        level += 1


def difference(left: DataFrame, right: DataFrame, label: str, fields: list[Column]) -> DataFrame:
    """(doc, l_node, r_node, what): where two trees (nodes with a label; docs are matched by doc) differ: `changed` nodes,
    whose own fields differ, and `added` and `removed` subtrees, which are told by their topmost node only.

    Digests are compared from the roots down and only branches that differ are opened. Siblings are matched by label; of
    several with one label, equal subtrees are matched first and the rest in the order of their digests. fields: of each
    node, its label among them.
    """
    own = F.to_json(F.struct(*[f.alias(f"f{k}") for k, f in enumerate(fields)]))
    a, b = (digests(df.withColumn("_fields", own), fields) for df in (left, right))
    rounds = list(_rounds(a, b, label, "_fields"))
    for table in (a, b):
        forget(table)
    if not rounds:
        return a.limit(0).select("doc", F.col("node").alias("l_node"), F.col("node").alias("r_node"), F.lit("").alias("what"))
    return reduce(DataFrame.unionByName, rounds).where("what <> 'equal'")
