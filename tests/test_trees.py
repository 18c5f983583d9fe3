"""Recursive queries, subtree digests and tree differences, against plain loops."""

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docgrid.operators import recursion, registers, subtrees, tree

C = F.col
NODES = "doc bigint, node bigint, parent bigint, ord int, name string, depth int, text string"


def test_deep_trees_and_cycles(spark):
    chain = [(1, k, k - 1 if k else None, 0, "para", None, None) for k in range(45)]
    ring = [(2, 0, 2, 0, "a", None, None), (2, 1, 0, 0, "b", None, None), (2, 2, 1, 0, "c", None, None), (2, 9, None, 0, "r", None, None)]
    n = spark.createDataFrame(chain + ring, NODES)
    found = tree.paths(n)
    assert rows(found.select("doc", "node", F.size("path"))) == sorted([(1, k, k + 1) for k in range(45)] + [(2, 9, 1)], key=repr)
    assert found.columns == [*n.columns, "path"]
    assert rows(tree.at_depth(n, 3).select("doc", "node", "level")) == sorted([(1, k, k) for k in range(4)] + [(2, 9, 0)], key=repr)
    with pytest.raises(ValueError, match="deeper than 43"):
        tree.paths(n, 43)


def test_recursion_visits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", None)], "p string, c string")
    start = edges.select(C("p").alias("root"), C("p").alias("at"), F.array("p").alias("seen")).distinct()
    found = recursion.recursive(start, edges, "t.at = e.p AND NOT array_contains(t.seen, e.c)", at="e.c", seen="concat(t.seen, array(e.c))")
    assert rows(found.select("root", "at")) == sorted([(r, x) for r in "abc" for x in "abc"], key=repr)


def test_structures_to_any_depth(spark):
    nest = [("f", f"T{k}", 0, f"T{k + 1}" if k < 40 else "uint8_t", "m", 0) for k in range(41)] + [("f", f"T{k}", 1, "uint8_t", f"x{k}", 0) for k in range(41)]
    schema = "file string, type string, ord int, member_type string, name string, count int"
    flat = registers.flattened(spark.createDataFrame(nest, schema), ["file"])
    top = [tuple(r) for r in flat.where("type = 'T0'").orderBy("ord").select("name", "byte_offset").collect()]
    assert top == [("m", 0), *((f"x{40 - k}", k + 1) for k in range(41))]
    assert flat.where("type = 'T40'").count() == 2
    other = spark.createDataFrame([(None, "A", 0, "B", "b", 2), (None, "A", 1, "int", "i", 0), (None, "B", 0, "char", "reserved1", 3), (None, "B", 1, "uint16_t", "w", 2)], schema)
    assert [tuple(r) for r in registers.flattened(other, ["file"]).where("type = 'A'").orderBy("ord").collect()] == [(None, "A", k, n, at, s) for k, (n, at, s) in enumerate([("b.0.w.0", 3, 2), ("b.0.w.1", 5, 2), ("b.1.w.0", 10, 2), ("b.1.w.1", 12, 2), ("i", 14, 4)])]
    with pytest.raises(ValueError, match="unknown type Q"):
        registers.flattened(spark.createDataFrame([("f", "A", 0, "Q", "q", 0)], schema), ["file"])


TREE = "doc bigint, node string, parent string, label string, v int"


def some_trees(rng, docs):
    out = []
    for doc in docs:
        names = []
        for k in range(rng.randint(1, 14)):
            out.append((doc, f"n{k}", rng.choice(names) if names else None, rng.choice("ab"), rng.randint(0, 1)))
            names.append(f"n{k}")
    return out


def canon(nodes):
    """{(doc, node): its subtree as nested tuples}"""
    below = {}
    for doc, node, parent, label, v in nodes:
        below.setdefault((doc, parent), []).append((doc, node, parent, label, v))
    made = {}

    def walk(n):
        made[n[0], n[1]] = (n[3], n[4], tuple(sorted(walk(c) for c in below.get((n[0], n[1]), []))))
        return made[n[0], n[1]]

    for key, ns in below.items():
        if key[1] is None:
            for n in ns:
                walk(n)
    return made


def test_digests(spark):
    rng = random.Random(2)
    nodes = some_trees(rng, range(25)) + [(99, "x", "y", "a", 0), (99, "y", "x", "a", 0), (None, "r", None, None, None), (None, "s", "r", None, None)]
    df = spark.createDataFrame(nodes, TREE)
    found = subtrees.digests(df, [C("label"), C("v")])
    made = canon([(d, n, p, l or "", -1 if v is None else v) for d, n, p, l, v in nodes if d != 99])
    got = {(r.doc, r.node): r for r in found.collect()}
    size = lambda t: 1 + sum(map(size, t[2]))
    assert set(got) == set(made) and all(got[k]["size"] == size(made[k]) for k in made)
    by_digest, by_tree = {}, {}
    for k in made:
        by_digest.setdefault(got[k].digest, set()).add(k)
        by_tree.setdefault(made[k], set()).add(k)
    assert sorted(map(sorted, [map(repr, s) for s in by_digest.values()])) == sorted(map(sorted, [map(repr, s) for s in by_tree.values()]))
    told = {(r.doc, r.node): r.copies for r in subtrees.equal_subtrees(found).collect()}
    parent = {(d, n): made.get((d, p)) for d, n, p, *_ in nodes}
    order = lambda k: (k[0] is not None, k[0] or 0, k[1])
    wanted = {}
    for t, places in by_tree.items():
        ups = {parent[p] for p in places}
        if len(places) > 1 and not (len(ups) == 1 and None not in ups and len(by_tree[next(iter(ups))]) > 1):
            wanted[min(places, key=order)] = len(places)
    assert told == wanted
    assert subtrees.digests(df.limit(0), [C("label")]).count() == 0


def test_difference(spark):
    base = [(1, "r", None, "root", 0), (1, "a", "r", "x", 1), (1, "a1", "a", "y", 5), (1, "b", "r", "x", 2), (1, "b1", "b", "y", 6), (1, "b2", "b", "z", 6), (2, "r", None, "root", 0), (3, "r", None, "root", 0)]
    # Siblings in another order, one value changed, one subtree gone, one new, one document gone and one new.
    other = [(1, "R", None, "root", 0), (1, "B", "R", "x", 2), (1, "B1", "B", "y", 7), (1, "C", "R", "w", 0), (1, "C1", "C", "y", 0), (1, "A", "R", "x", 1), (1, "A1", "A", "y", 5), (2, "R", None, "root", 0), (4, "R", None, "root", 0)]
    make = lambda n: spark.createDataFrame(n, TREE)
    found = subtrees.difference(make(base), make(other), "label", [C("label"), C("v")])
    assert rows(found) == sorted([(1, "b1", "B1", "changed"), (1, "b2", None, "removed"), (1, None, "C", "added"), (3, "r", None, "removed"), (4, None, "R", "added")], key=repr)
    assert subtrees.difference(make(base), make(base), "label", [C("label"), C("v")]).count() == 0
    back = subtrees.difference(make(other), make(base), "label", [C("label"), C("v")])
    assert Counter(r.what for r in back.collect()) == Counter({"changed": 1, "added": 2, "removed": 2})


def test_difference_of_one_leaf_opens_one_branch(spark):
    """Of a tree of 1,000 leaves only the changed one and nothing else is told."""
    nodes = [(1, "r", None, "r", 0)] + [(1, f"k{k}", "r", str(k), 0) for k in range(10)] + [(1, f"k{k}-{j}", f"k{k}", str(j), j) for k in range(10) for j in range(100)]
    df = spark.createDataFrame(nodes, TREE)
    changed = df.withColumn("v", F.when(C("node") == "k3-7", 0).otherwise(C("v")))
    assert rows(subtrees.difference(df, changed, "label", [C("label"), C("v")])) == [(1, "k3-7", "k3-7", "changed")]
