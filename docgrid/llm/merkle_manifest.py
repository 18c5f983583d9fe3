"""Merkle manifest of a dataset: one root for all rows, and for each row the siblings that prove it.

Rows become leaves (SHA-256 of their fields). Within a group (a language, a shard) leaves follow one another by id, and
neighbours are hashed in pairs, level by level, up to the group's subroot; the subroots, ordered by group, give the root
in the same way. A node without a neighbour is hashed alone; a lone leaf is its group's subroot as it stands.

The work is done from both ends. Executors reduce aligned blocks of BLOCK neighbouring nodes to one digest each, again
and again until at most TOP digests are left. The driver builds the tree above these and broadcasts, for each, the path
from it to the root. Executors then go through the blocks once more, join each row's path within its block with that
suffix, and fold the row up to the root. Ranks come from a range partitioning with one count a partition and group, so
neither a group that holds most rows nor one task gathers more than a block.

Defined results: null fields are leaves' `-`; a null group comes first; null ids come first within a group; rows with
equal ids follow their leaves, and equal rows are interchangeable and each get a proof; any number of groups and rows
(there are more rounds of blocks); an empty table gives no rows; other columns are not read, and extra ones may have any
name but those of the result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import forget, written

#: log2 of the nodes that one block reduces to one.
LEVELS = 10
#: Digests that the driver may hold; each is broadcast with a path of at most 2 * log2(TOP) + 1 siblings, under 10 MB in all.
TOP = 4096
#: Rows of partition offsets that are broadcast; with more, they are joined by key.
OFFSETS = 100_000
STEPS = "array<struct<sib:string,left:boolean>>"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its UTF-8 length and value, or a dash for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def group_key(group: Column) -> Column:
    """A string that is never null and sorts as the groups do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with a column grp) with pos, their rank from 0 within the group by order, and n, the rows of the group."""
    at = written(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("_place", F.monotonically_increasing_id()), "merkle-placed")
    at = at.withColumn("_part", F.shiftright("_place", 33))
    parts = at.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    ahead = parts.selectExpr("grp", "_part", "sum(_rows) over (partition by grp order by _part) - _rows - _first as _shift", "sum(_rows) over (partition by grp) as n")
    ahead = written(ahead, "merkle-offsets")
    if ahead.count() <= OFFSETS:
        ahead = F.broadcast(ahead)
    return at.join(ahead, ["grp", "_part"]).withColumn("pos", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def _blocks(nodes: DataFrame, levels: int, payload: list[str]) -> DataFrame:
    """A row a block: grp, block, its nodes in order, and tree: its digests level by level, the leaves first."""
    block = nodes.withColumn("block", F.expr(f"shiftright(pos, {levels})"))
    held = block.groupBy("grp", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", *payload))).alias("nodes"))
    # As many levels as the block has below its own root; in a group of one block that is the group's height.
    height = f"least({levels}, if(n = 1, 0, length(bin(n - 1))))"
    over = "element_at(tree, -1)"
    pair = f"sha2(concat(get({over}, 2 * j), coalesce(get({over}, 2 * j + 1), '')), 256)"
    level = f"transform(sequence(0, (size({over}) - 1) div 2), j -> {pair})"
    tree = f"aggregate(if({height} = 0, array(), sequence(1, {height})), cast(array(nodes.digest) as array<array<string>>), (tree, i) -> concat(tree, array({level})))"
    return held.withColumn("tree", F.expr(tree))


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes one round of blocks up: grp, pos, n, digest."""
    roots = _blocks(nodes, levels, []).selectExpr("grp", "block as pos", f"shiftright(n - 1, {levels}) + 1 as n", "get(element_at(tree, -1), 0) as digest")
    return written(roots, "merkle-roots")


def proved(nodes: DataFrame, suffixes: DataFrame, levels: int, payload: list[str]) -> DataFrame:
    """Each node with its steps to the root: those within its block, then its block's suffix."""
    blocks = _blocks(nodes, levels, payload).join(suffixes.withColumnRenamed("pos", "block"), ["grp", "block"])
    rows = blocks.select("grp", "tree", "steps", "subroot", "root", F.explode("nodes").alias("node"))
    # A shift of the global place is as good as one within the block: blocks are aligned.
    sib = f"get(get(tree, i), cast(shiftright(node.pos & {(1 << levels) - 1}, i) ^ 1 as int))"
    own = f"transform(if(size(tree) = 1, array(), sequence(0, size(tree) - 2)), i -> struct({sib} as sib, (shiftright(node.pos, i) & 1) = 1 as left))"
    return rows.select("grp", "node.pos", "node.digest", *[F.col("node")[p].alias(p) for p in payload], "subroot", "root", F.concat(F.expr(own).cast(STEPS), F.col("steps")).alias("steps"))


def _paths(level: list[str]) -> tuple[str, list[list[tuple[str | None, bool]]]]:
    """(the root over these digests, the steps of each to it)."""
    steps: list[list[tuple[str | None, bool]]] = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for k, p in enumerate(at):
            steps[k].append((level[p ^ 1] if p ^ 1 < len(level) else None, bool(p & 1)))
        at = [p >> 1 for p in at]
        level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0], steps


def _top(nodes: DataFrame) -> DataFrame:
    """The suffixes of at most TOP nodes, from the tree above them, which is built here on the driver."""
    groups: dict[str, list[str]] = {}
    for row in sorted(nodes.select("grp", "pos", "digest").collect(), key=lambda r: (r.grp.encode(), r.pos)):
        groups.setdefault(row.grp, []).append(row.digest)
    trees = {g: _paths(digests) for g, digests in groups.items()}
    rows = []
    if trees:
        root, above = _paths([sub for sub, _ in trees.values()])
        rows = [(g, pos, own + up, sub, root) for (g, (sub, steps)), up in zip(trees.items(), above) for pos, own in enumerate(steps)]
    return F.broadcast(nodes.sparkSession.createDataFrame(rows, f"grp string, pos bigint, steps {STEPS}, subroot string, root string"))


def suffixes(nodes: DataFrame, levels: int, top: int) -> DataFrame:
    """(grp, pos, steps, subroot, root) of nodes (grp, pos, n, digest): each node's path to the root."""
    if nodes.count() <= top:
        return _top(nodes)
    if nodes.where("n > 1").isEmpty():  # more groups than the driver may hold: their subroots become the leaves of one group
        subroots = placed(nodes.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest"), ["key"])
        above = proved(subroots, suffixes(block_roots(subroots, levels), levels, top), levels, ["key"])
        return above.select(F.col("key").alias("grp"), F.lit(0).cast("bigint").alias("pos"), "steps", F.col("digest").alias("subroot"), "root")
    return proved(nodes, suffixes(block_roots(nodes, levels), levels, top), levels, []).drop("digest")


def manifest(df: DataFrame, id_col: str, fields: list[str], group: str, extra: dict[str, Column] | None = None, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """Each row of df: id_col, group, the extra columns, leaf, slot (its place within the group), subroot, root, and steps: its siblings on the way to the root."""
    extra = extra or {}
    payload = ["_id", "_group", *(f"_x{k}" for k in range(len(extra)))]
    columns = [F.col(id_col).alias("_id"), F.col(group).alias("_group"), *(c.alias(f"_x{k}") for k, c in enumerate(extra.values()))]
    # Written before it is dealt by range, so that no text is read and hashed a second time for the ranges' bounds.
    leaves = written(df.select(group_key(F.col(group)).alias("grp"), leaf([F.col(f) for f in fields]).alias("digest"), *columns), "merkle-leaves")
    nodes = placed(leaves, ["_id", "digest"])
    forget(leaves)
    rows = proved(nodes, suffixes(block_roots(nodes, levels), levels, top), levels, payload)
    return rows.select(F.col("_id").alias(id_col), F.col("_group").alias(group), *[F.col(f"_x{k}").alias(n) for k, n in enumerate(extra)], F.col("digest").alias("leaf"), F.col("pos").alias("slot"), "subroot", "root", "steps")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf comes to by its steps."""
    up = lambda at, s: F.sha2(F.when(s["left"], F.concat(F.coalesce(s["sib"], F.lit("")), at)).otherwise(F.concat(at, F.coalesce(s["sib"], F.lit("")))), 256)
    return F.aggregate(steps, start, up)


def proof_digest(steps: Column) -> Column:
    """SHA-256 of the siblings of a proof, from the leaf up."""
    return F.sha2(F.concat_ws("", steps["sib"]), 256)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under one root by language, and each row folded once more after some of them were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf([F.expr("try_add(n_chars, 1)") if f == "n_chars" else F.col(f) for f in FIELDS])
    rows = manifest(docs, "doc_id", FIELDS, "lang", {"changed": F.when(touched, changed)})
    fold = folded(F.coalesce("changed", "leaf"), F.col("steps"))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The CRC is taken bit by bit over the digits of the id.
SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, n_chars,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295, [unicode(c) FOR c IN string_split(doc_id::varchar, '')]),
      lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 7 = 0 AS touched
  FROM documents),
e AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + touched::int)::varchar) || ':' || (n_chars + touched::int), '-') || tail) AS changed
  FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM e),
t AS (
  SELECT 0 AS lvl, g, pos, n, leaf AS h FROM l
  UNION ALL SELECT lvl + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, g, pos // 2, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
f AS (
  SELECT doc_id, leaf, g, 0 AS lvl, pos, n, coalesce(changed, leaf) AS h, '' AS proof FROM l
  UNION ALL SELECT doc_id, leaf, f.g, f.lvl + 1, f.pos // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN t.h || f.h ELSE f.h || coalesce(t.h, '') END), proof || coalesce(t.h, '')
  FROM f LEFT JOIN t ON t.g = f.g AND t.lvl = f.lvl AND t.pos = xor(f.pos, 1) WHERE f.n > 1),
k AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, s.pos, s.n, f.h, proof FROM f JOIN s USING (g) WHERE f.n = 1
  UNION ALL SELECT doc_id, leaf, subroot, k.lvl + 1, k.pos // 2, (k.n + 1) // 2,
    sha256(CASE WHEN k.pos % 2 = 1 THEN u.h || k.h ELSE k.h || coalesce(u.h, '') END), proof || coalesce(u.h, '')
  FROM k LEFT JOIN u ON u.lvl = k.lvl AND u.pos = xor(k.pos, 1) WHERE k.n > 1)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, k.h AS folded_root, k.h = u.h AS verified FROM k, u WHERE k.n = 1 AND u.n = 1"""
