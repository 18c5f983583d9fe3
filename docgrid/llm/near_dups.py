"""MinHash near-dedup with SetSketch registers.

Every document's set of word shingles is summarised by REGISTERS registers. Each holds the smallest of the set's
exponential variates, truncated on an exponential scale of base BASE (K = floor(1 - log_b h)); registers of a union are
the larger ones of its parts. Bands of registers bring likely neighbours into one bucket; the joint likelihood of the
registers that agree, are larger or are smaller estimates the Jaccard similarity; what may reach the threshold is
confirmed on the full sets.

Groups of any size stay distributed, and pairs never become rows. Equal sets are one class from the start. Members of a
bucket are first compared with a central pivot (of a member's pivots, with the one it shares the most buckets with, then
with the others), in stars of at most BLOCK members a task, and the links found are contracted to components. What is
left are buckets that still hold several components. Their members are compared by registers, in blocks; this hands on
the members that have a likely partner in another component, together with a spanning forest of who is near whom. Each
cluster of that forest is dealt to cells of at most two blocks of members, such that any two meet in just one cell. A
cell estimates its pairs by joint likelihood, best first, confirms them on the full sets, and passes over pairs that a
link found before has already brought together. So no link between different components is lost, a member travels once
a cell and not once a pair, and no group is expanded into its pairs.

With bands of 5 of 220 registers, a pair at the threshold of 0.75 meets in at least one bucket with probability
1 - (1 - 0.75**5)**44 > 0.99999; truncation only raises it. A pair is given up before the full check only if its
estimate lies MARGIN standard deviations below the threshold.

Defined results: texts without words, and null texts, have the empty set and are linked with nothing; shorter texts
than SHINGLE words have one shingle, their whole sequence; repeated rows and equal sets share a component; rows that
share an id count as one node; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import forget, pieces, portions, window_sets, written

SHINGLE = 5
THRESHOLD = 75  # per cent
ROWS, BANDS = 5, 44
REGISTERS = ROWS * BANDS
#: Base of the registers' scale and rate of the exponential variates.
#: A base near 1 makes registers of unrelated sets differ, so buckets do not fill by chance as the corpus grows.
BASE, RATE = 1.001, 20.0
#: Members of a block: of a star, of a bucket, of a cell's side.
BLOCK = 512
CELL = 256
#: Standard deviations that an estimate may lie below the threshold before a pair is given up.
MARGIN = 5.0
#: Equal low bytes of registers below which blocks give a pair up: as many deviations below what the threshold lets expect.
EQUAL = REGISTERS * THRESHOLD / 100 - MARGIN * np.sqrt(REGISTERS * THRESHOLD * (100 - THRESHOLD)) / 100
#: Ids that are broadcast at most (8 bytes each), to leave out other rows before a shuffle; more are joined by shuffle.
FEW = 500_000
_CHUNK = 1024


def shingle_sets(texts: list[bytes | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; A-Z lower-cased."""
    return window_sets([(t or b"").lower() for t in texts], n)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(9))
    return rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


_A, _B = _factors()


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set: uint16 registers."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(x), _CHUNK):
        part = np.multiply.outer(_A, x[at : at + _CHUNK])
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    variate = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, 65535).astype(np.uint16)


def packed(regs: np.ndarray) -> bytes:
    """Registers as bytes: the low ones first, then the high ones."""
    return (regs & 255).astype(np.uint8).tobytes() + (regs >> 8).astype(np.uint8).tobytes()


def unpacked(column: pa.Array) -> np.ndarray:
    """Rows of registers of a binary column made by packed()."""
    planes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2, REGISTERS)
    return planes[:, 0] | planes[:, 1].astype(np.uint16) << 8


def _p(x: np.ndarray) -> np.ndarray:
    """Probability that one sketch's register exceeds the other's, x being the share of the union in its set alone."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0, 1, 201)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets, given their registers (pairs x REGISTERS) and sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (na / (na + nb))[:, None]
    top = np.minimum(u / (1 - u), (1 - u) / u)  # the similarity that these sizes allow
    j = _GRID[None, :] * top
    tiny = 1e-12
    plus, minus = _p(np.clip(u - (1 - u) * j, 0, 1)), _p(np.clip(1 - u - u * j, 0, 1))
    score = more * np.log(plus + tiny) + less * np.log(minus + tiny) + (REGISTERS - more - less) * np.log(np.maximum(1 - plus - minus, tiny))
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (equal for equal sets), registers."""

    def sketch(batches):
        for batch in pieces(batches, 1024):
            n, ids, regs = [], [], []
            for run in portions([t or b"" for t in batch.column(1).to_pylist()]):
                for found in shingle_sets(run):
                    n.append(len(found))
                    ids.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                    regs.append(packed(registers(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "registers"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(sketch, "doc_id bigint, n_shingles bigint, set_id string, registers binary")


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose rep is wanted (a written table of one column)."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "rep", "left_semi")


def whole_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the wanted representatives, equal rows once."""
    rows = _only(docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("binary").alias("text")), wanted)
    return written(rows.repartition("rep").dropDuplicates(["rep", "text"]), "texts")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """(bucket, rep): one row a band."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, *(F.substring(F.col("registers"), i * ROWS + 1 + plane * REGISTERS, F.lit(ROWS)) for plane in (0, 1))))
    return reps.select(F.explode(keys).alias("bucket"), "rep")


class Joined(dict):
    """Components that have been joined: each knows a smaller one, or itself."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)


def _pairs(sides: np.ndarray, within: bool, comps: np.ndarray, sizes: np.ndarray):
    """For each member its partners in other components (as places) whose sizes allow the threshold."""
    for k in range(len(sides)) if within else np.flatnonzero(sides == 0).tolist():
        other = np.arange(k + 1, len(sides)) if within else np.flatnonzero(sides == 1)
        other = other[comps[other] != comps[k]]
        other = other[100 * np.minimum(sizes[other], sizes[k]) >= THRESHOLD * np.maximum(sizes[other], sizes[k])]
        if len(other):
            yield k, other


def _by_cell(batches, width: int):
    """Lists of rows with equal first `width` columns; rows come sorted by them."""
    held: list[tuple] = []
    for batch in pieces(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:width] != row[:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _links(rows: list[tuple]) -> list[tuple[int, int]]:
    """Links (a, b) that join the components of a cell's members; rows: (key, i, j, side, rep, comp, n, registers, text).

    Pairs whose joint estimate does not rule the threshold out are confirmed on the full sets, the likeliest first,
    unless links found before have joined their components.
    """
    sides, comps, sizes = (np.array([r[c] for r in rows]) for c in (3, 5, 6))
    regs = unpacked(pa.array([r[7] for r in rows], pa.binary()))
    likely, sizes = [], sizes.astype(float)
    for k, other in _pairs(sides, rows[0][1] == rows[0][2], comps, sizes):
        other = other[(regs[other] == regs[k]).sum(axis=1) >= EQUAL]
        for part in np.array_split(other, 1 + len(other) // 1024):
            if len(part):
                j = joint_estimate(np.broadcast_to(regs[k], (len(part), REGISTERS)), regs[part], np.full(len(part), sizes[k]), sizes[part])
                fit = j + MARGIN * np.sqrt(np.maximum(j * (1 - j), 0.01) / REGISTERS) >= THRESHOLD / 100
                likely += [(-e, k, o) for e, o in zip(j[fit].tolist(), part[fit].tolist())]
    wanted = sorted({x for _, k, o in likely for x in (k, o)})
    sets = dict(zip(wanted, shingle_sets([rows[x][8] for x in wanted])))
    joined, out = Joined(), []
    for _, k, o in sorted(likely):
        if joined.root(rows[k][5]) != joined.root(rows[o][5]):
            a, b = sets[k], sets[o]
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= THRESHOLD * (len(a) + len(b) - common):
                joined.join(rows[k][5], rows[o][5])
                out.append((rows[k][4], rows[o][4]))
    return out


def confirmed(cells: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) that join the components within each cell (key, i, j, side, rep); i = j: of all its members, else
    of those of side 0 with those of side 1."""

    def check(batches):
        for rows in _by_cell(batches, 3):
            found = _links(rows)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = cells.join(labels, "rep").join(known, "rep").select("key", "i", "j", "side", "rep", "comp", "n", "registers", "text")
    return written(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(check, "a bigint, b bigint"), "links")


def _stars(pairs: DataFrame) -> DataFrame:
    """Cells of pivots p and the members rep to be compared with them, at most about BLOCK members a cell."""
    sizes = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("k"))
    cell = lambda rep, j, side: [F.col("p").alias("key"), F.lit(0).alias("i"), j.alias("j"), F.lit(side).alias("side"), F.col(rep).alias("rep")]
    pivots = sizes.withColumn("j", F.explode(F.sequence(F.lit(1), "k"))).select(cell("p", F.col("j"), 0))
    return pivots.union(pairs.join(sizes, "p").select(cell("rep", 1 + F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"), 1)))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for every node of an edge that is not a root itself.

    Alternating large and small stars; each step is a grouped minimum and a join, so no component is gathered anywhere.
    """
    star = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "star")
    while True:
        both = star.select(F.col("u").alias("x"), F.col("v").alias("y")).union(star.select("v", "u"))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        forget(star)
        star = new
        several = star.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        inner = star.join(star.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
        if several.isEmpty() and inner.isEmpty():
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, comp) after the components at both ends of each link have become one."""
    if links.isEmpty():
        return labels
    ends = links.join(labels.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b")
    roots = connected(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
    moved = labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
    return written(moved.select("rep", F.coalesce("root", "comp").alias("comp")), "labels")


def _blocks(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of open buckets, dealt to the pairs (i, j) of blocks that have to be compared, as side 0 or 1.

    A bucket's major component (its pivot's) is known to hold together, so its blocks are compared with the others'
    only. Blocks have about BLOCK members, whatever the bucket's size.
    """
    rows = members.join(groups, "bucket")
    minor = F.col("comp") != F.col("pc")
    few, many = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("n_minor", "n_major"))
    at = lambda n: F.pmod(F.xxhash64("rep", "bucket"), n).cast("int")
    to = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    within = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda y: to(F.least(F.col("x"), y), F.greatest(F.col("x"), y), F.when(F.col("x") <= y, 0).otherwise(1)))
    across = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda y: to(F.col("x"), F.col("few") + y, F.lit(0)))
    back = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda x: to(x, F.col("few") + F.col("x"), F.lit(1)))
    rows = rows.withColumns({"few": few, "many": many}).withColumn("x", F.when(minor, at(F.col("few"))).otherwise(at(F.col("many"))))
    rows = rows.select("bucket", "rep", "comp", "n", "low", F.explode(F.when(minor, F.concat(within, across)).otherwise(back)).alias("to"))
    return rows.select("bucket", "to.i", "to.j", "to.side", "rep", "comp", "n", "low")


def _near(blocks: DataFrame) -> DataFrame:
    """(rep, comp, hub): members that have a likely partner in another component within their blocks, with a component
    that these partners lead to.

    The low bytes of two registers are equal if the registers are, so their count rules no pair out that the registers would not.
    """

    def compare(batches):
        for rows in _by_cell(batches, 3):
            regs = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(-1, REGISTERS)
            sides, comps, sizes = (np.array([r[c] for r in rows]) for c in (3, 5, 6))
            joined, near = Joined(), np.zeros(len(rows), bool)
            for k, other in _pairs(sides, rows[0][1] == rows[0][2], comps, sizes):
                other = other[(regs[other] == regs[k]).sum(axis=1) >= EQUAL]
                if len(other):
                    near[k] = near[other] = True
                    for comp in set(comps[other].tolist()):
                        joined.join(int(comps[k]), comp)
            found = [(rows[k][4], rows[k][5], joined.root(rows[k][5])) for k in np.flatnonzero(near).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["rep", "comp", "hub"])

    dealt = blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(compare, "rep bigint, comp bigint, hub bigint")


def _cells(near: DataFrame) -> DataFrame:
    """Cells in which any two members of a cluster meet just once, with at most about CELL members a side."""
    roots = connected(near.select(F.col("comp").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct())
    members = near.select("rep", "comp").distinct().join(roots.withColumnRenamed("node", "comp"), "comp", "left")
    members = members.select(F.coalesce("root", "comp").alias("root"), "rep").distinct()
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("k"))
    rows = members.join(sizes, "root").withColumn("x", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select(F.col("root").alias("key"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("int").alias("side"), "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row a row of docs."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = written(sketches(docs), "sketches")
    # Equal sets are one class, named by its smallest id.
    reps = written(sketched.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "reps")
    labels = reps.select("rep", F.col("rep").alias("comp")).distinct()
    # Both sides of the join read the same exchange: it has the same columns in each.
    rows = bucket_rows(reps).repartition("bucket")
    crowded = rows.groupBy("bucket").agg(F.count("rep").alias("size")).where("size > 1")
    rows = written(rows.join(crowded, "bucket"), "buckets")
    # A text from which many others were made shares more buckets than they share among each other: it makes the best pivot.
    central = rows.groupBy("rep").agg(F.sum("size").alias("central"))
    crowd = written(central.select("rep"), "crowd")
    texts = whole_texts(docs, crowd)
    known = written(_only(reps.select("rep", "n", "registers"), crowd).join(texts, "rep"), "known")
    pivot = F.max(F.struct("central", -F.col("rep"), "rep")).alias("pivot")
    pivots = rows.join(central, "rep").groupBy("bucket").agg(pivot).select("bucket", F.col("pivot.rep").alias("p"))
    # The pivot that shares the most buckets with a member comes first; the others only where components still differ.
    shared = written(rows.join(pivots, "bucket").where("rep <> p").groupBy("rep", "p").agg(F.count(F.lit(1)).alias("k")), "shared")
    best = shared.groupBy("rep").agg(F.max(F.struct("k", -F.col("p"), "p")).alias("best")).select("rep", F.col("best.p").alias("p"))
    for first in (True, False):
        pairs = best if first else shared.select("rep", "p").join(best, ["rep", "p"], "left_anti").join(labels, "rep").join(labels.toDF("p", "pc"), "p").where("comp <> pc").select("rep", "p")
        labels = _merged(labels, confirmed(_stars(pairs), labels, known))
    members = rows.join(labels, "rep")
    groups = members.join(pivots.join(labels.toDF("p", "pc"), "p"), "bucket").groupBy("bucket", "pc").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if(F.col("comp") != F.col("pc")).alias("n_minor"), F.count_if(F.col("comp") == F.col("pc")).alias("n_major"))
    # A bucket of two members has been settled by its pivot.
    groups = written(groups.where("lo < hi and n_minor + n_major > 2").select("bucket", "pc", "n_minor", "n_major"), "groups")
    low = known.select("rep", "n", F.substring("registers", 1, REGISTERS).alias("low")).dropDuplicates(["rep"])
    near = written(_near(_blocks(members.join(low, "rep"), groups)).distinct(), "near")
    if not near.isEmpty():
        labels = _merged(labels, confirmed(_cells(near), labels, known))
    for done in (rows, crowd, texts, known, shared, groups, near):
        forget(done)
    classes = reps.join(labels, "rep").select("set_id", "comp")
    found = sketched.join(classes, "set_id", "left")
    component = F.coalesce("comp", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their near-duplicate components."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n_shingles + nb.n_shingles - k)),
r(doc_id, t) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.t = e.a),
m AS (SELECT doc_id, min(t) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, n.n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m JOIN n ON n.doc_id = m.doc_id"""
