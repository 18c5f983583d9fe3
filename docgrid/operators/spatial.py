"""Spatial and theta joins."""

from __future__ import annotations

import heapq
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import intersects
from ..lineage import written

#: A side is broadcast only if the optimizer's estimate of its size in bytes, which errs upwards, is no more than this.
BROADCAST_BYTES = 64 << 20
#: Boxes, counted by a job, that are few enough to be broadcast with their cells.
BROADCAST_ROWS = 50_000
#: Pairs of boxes of one key up to which they are compared without cells.
KEY_PAIRS = 1 << 18
#: Nested cells: the finest are so wide, those of each level STEP times as wide as those below, and the last level is one cell.
FINEST, STEP, LEVELS = 2.0**-10, 4.0, 31
#: Cells that a box is cut into at most where it is moved to finer levels than its own.
CUT = 1 << 18


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small enough; as it is otherwise."""
    return F.broadcast(df) if estimated_bytes(df) <= size else df


def cell_level(width: Column, finest: float) -> Column:
    """The level of nested cells at which an interval is no wider than a cell; LEVELS, where all is one cell, if none is so wide."""
    # A sum of comparisons, which is compiled; a filter over an array of the sizes is not.
    return reduce(lambda a, b: a + b, [F.when(F.lit(finest * STEP**k) < width, 1).otherwise(0) for k in range(LEVELS)])


def cell_of(x: Column, level: Column, finest: float) -> Column:
    return F.when(level == LEVELS, F.lit(0)).otherwise(F.floor(x.cast("double") / (finest * F.pow(F.lit(STEP), level))))


def _levelled(df: DataFrame, l: Column, b: Column, r: Column, t: Column, finest: float) -> DataFrame:
    wide = lambda lo, hi: cell_level(F.abs(hi.cast("double") - lo.cast("double")), finest)
    return df.withColumn("_own", F.struct(wide(l, r).alias("x"), wide(b, t).alias("y")))


def _as_array(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in pairs]) if pairs else F.array().cast("array<struct<x:int,y:int>>")


def _levels(df: DataFrame) -> tuple[Column, int]:
    """The pairs of levels that occur as one array, fetched by a job: (LEVELS + 1) ** 2 at most; and the number of rows."""
    found = df.groupBy("_own.x", "_own.y").agg(F.count(F.lit(1)).alias("n")).collect()
    return _as_array([(r.x, r.y) for r in found]), sum(r.n for r in found)


def _fewer_levels(df: DataFrame, spans: list[tuple[Column, Column]], extent: list[float], points: int, finest: float) -> dict[tuple[int, int], tuple[int, int]]:
    """For each pair of levels of the boxes the pair (itself or a finer one) at which they are cut, such that points, once for
    each pair that is left, and cut boxes make few rows. spans: the boxes' ends on both axes; extent: the places' widths."""
    widths = [F.avg(hi.cast("double") - lo.cast("double")) for lo, hi in spans]
    found = df.groupBy("_own.x", "_own.y").agg(F.count(F.lit(1)), *widths).collect()  # (LEVELS + 1) ** 2 rows at most
    known = {(i, j): (n, w) for i, j, n, *w in found}
    pairs = sorted(known)

    def rows(own: tuple[int, int], at: tuple[int, int]) -> float:
        (n, width), most = known[own], 1.0
        for a, b, w, e in zip(own, at, width, extent):
            if a == LEVELS or b == LEVELS:  # a single cell is left whole
                n, most = n, most if a == b else math.inf
            else:
                n, most = n * (1 + w / (finest * STEP**b)), most * min(STEP ** (a - b), 1 + e / (finest * STEP**b))
        return n if most < CUT else math.inf

    cost = {p: {q: rows(p, q) for q in pairs if q[0] <= p[0] and q[1] <= p[1]} for p in pairs}
    # The pair whose loss saves most goes first, while any saves rows.
    left = set(pairs)
    while True:
        best = {p: heapq.nsmallest(2, ((c, q) for q, c in cost[p].items() if q in left)) for p in pairs}
        more = dict.fromkeys(left, -float(points))
        for (c, q), *other in best.values():
            more[q] += (other[0][0] if other else math.inf) - c
        q = min(more, key=more.get, default=None)
        if q is None or more[q] >= 0:
            return {p: b[0][1] for p, b in best.items()}
        left.remove(q)


def _cut(df: DataFrame, lo: Column, hi: Column, level: Column, name: str, finest: float) -> DataFrame:
    """df for each cell of the level that the interval touches: two at most if it is no wider than a cell."""
    ends = [cell_of(F.least(lo, hi), level, finest), cell_of(F.greatest(lo, hi), level, finest)]
    return df.withColumn(name, F.explode(F.sequence(*ends)))


def _split_heavy(left: DataFrame, right: DataFrame, on: list[str], most: int | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides, with keys of more than `most` rows on either side dealt to a grid of tasks: each row of one side meets
    each row of the other in one of them, and none gathers more than about `most` rows a side."""
    if most is None:
        return left, right, on
    count = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    parts = lambda n: F.ceil(F.col(n) / most).cast("int")
    heavy = count(left, "_nl").join(count(right, "_nr"), on).where((F.col("_nl") > most) | (F.col("_nr") > most)).select(*on, parts("_nl").alias("_nl"), parts("_nr").alias("_nr"))
    heavy = written(heavy)  # at most one row for each `most` rows of a side
    if heavy.isEmpty():
        return left, right, on

    def dealt(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        found = df.join(bounded(heavy), on, "left").withColumn(i, F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int"))
        return found.withColumn(j, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_nl", "_nr")

    return dealt(left, "_nl", "_nr", "_i", "_j"), dealt(right, "_nr", "_nl", "_j", "_i"), [*on, "_i", "_j"]


def range_join(points: DataFrame, boxes: DataFrame, x: str, y: str, keys: list[str] | None = None, cell: float = FINEST, most: int | None = None) -> DataFrame:
    """Points within closed boxes (columns l, b, r, t) of any widths: an equi-join on keys and nested cells, then the exact test.

    A box lies in at most four cells of its own level, whatever its width; a point probes one cell for each level that the
    boxes have. Where both sides are moved, boxes of a level are cut into cells of a finer one if that makes fewer rows than
    to move the points once more, and boxes and cells beyond the points' places are left out. Boxes with a null corner or
    with l > r or b > t hold nothing. cell: the finest cells' width; most: rows of a cell (of either side) above which it
    is dealt to several tasks. Up to BROADCAST_ROWS boxes are broadcast, so that no
    cell gathers the points in it; more of them are never broadcast, however small the optimizer takes them to be. Then
    points and boxes of a key with up to KEY_PAIRS pairs are compared as they are, without cells; sides that are already
    partitioned by the keys alike stay where they are.
    """
    keys = keys or []
    pair = (F.col("_own.x") * (LEVELS + 1) + F.col("_own.y")).alias("_pair")
    side = _levelled(boxes.where("l <= r and b <= t"), F.col("l"), F.col("b"), F.col("r"), F.col("t"), cell).select("*", pair)
    levels, n = _levels(side)
    hit = F.col(x).between(F.col("l"), F.col("r")) & F.col(y).between(F.col("b"), F.col("t"))
    alone = None
    if keys and n > BROADCAST_ROWS:
        crowded = _crowded(points, side, keys)
        none = crowded.isEmpty()
        part = lambda how: (points, side) if none else (points.join(bounded(crowded), keys, how), side.join(bounded(crowded), keys, how))
        p, s = part("left_anti")
        alone = p.join(s.drop("_own", "_pair").hint("merge"), keys).where(hit)
        if none:
            return alone
        points, side = part("left_semi")
        levels, _ = _levels(side)
    spans = [(F.col("l"), F.col("r")), (F.col("b"), F.col("t"))]
    if n > BROADCAST_ROWS:
        places = [F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c).cast("double")) for c in (x, y)]
        # Two jobs: where the points lie, and how many boxes of what width have each pair of levels.
        least_x, most_x, least_y, most_y, count = points.agg(*[f(p) for p in places for f in (F.min, F.max)], F.count(places[0])).first()
        ends = [[F.lit(v).cast("double") for v in (least_x, most_x)], [F.lit(v).cast("double") for v in (least_y, most_y)]]
        side = side.where(reduce(lambda p, q: p & q, [(hi >= first) & (lo <= last) for (lo, hi), (first, last) in zip(spans, ends)]))
        spans = [(F.greatest(lo, first), F.least(hi, last)) for (lo, hi), (first, last) in zip(spans, ends)]
        to = _fewer_levels(side, spans, [most_x - least_x, most_y - least_y] if count else [0.0, 0.0], count, cell)
        number = lambda p: p[0] * (LEVELS + 1) + p[1]
        at = {number(p): number(q) for p, q in to.items()}
        side = side.withColumn("_pair", F.get(F.array(*[F.lit(at.get(k, k)) for k in range((LEVELS + 1) ** 2)]), F.col("_pair")))
        side = side.withColumn("_own", F.struct(F.expr(f"int(_pair div {LEVELS + 1})").alias("x"), (F.col("_pair") % (LEVELS + 1)).alias("y")))
        levels = _as_array(sorted(set(to.values())))
    tiled = _cut(_cut(side, *spans[0], F.col("_own.x"), "_cx", cell), *spans[1], F.col("_own.y"), "_cy", cell)
    placed = points.withColumn("_own", F.explode(levels)).select("*", pair)
    placed = placed.withColumn("_cx", cell_of(F.col(x), F.col("_own.x"), cell)).withColumn("_cy", cell_of(F.col(y), F.col("_own.y"), cell))
    # What merging sorts by first is a number that tells most rows apart; a struct, or a level, tells few.
    placed, tiled, on = placed.drop("_own"), tiled.drop("_own"), [*keys, "_cx", "_cy", "_pair"]
    if n <= BROADCAST_ROWS:
        tiled = F.broadcast(tiled)
    else:
        placed, tiled, on = _split_heavy(placed, tiled, on, most)
        tiled = tiled.hint("merge")
    met = placed.join(tiled, on).where(hit).drop("_pair", "_cx", "_cy", "_i", "_j")
    return met if alone is None else alone.unionByName(met)


def outside(points: DataFrame, boxes: DataFrame, x: str, y: str, keys: list[str] | None = None, cell: float = FINEST) -> DataFrame:
    """Points that lie in no box. Whether one does depends on its place (and keys) only, so places are looked up once each."""
    on = [*(keys or []), x, y]
    inside = range_join(points.select(*on).distinct(), boxes, x, y, keys, cell).select(*on).distinct()
    inside = inside.select([F.col(c).alias(f"_{k}") for k, c in enumerate(on)])
    same = [points[c].eqNullSafe(inside[f"_{k}"]) for k, c in enumerate(on)]
    return points.join(inside, same, "left_anti")


#: What is taken out of a pattern, in this order, before its literal runs are read off; each leaves a gap. What may be
#: missing from a match, or may stand for more than itself, is no literal.
_NO_LITERALS = [
    r"\\[QE]|\\[xupPcN0-9].*",  # quoted stretches and numbered characters: nothing behind them is read
    r"\\.[*+?{]?",  # classes, and escaped signs
    r"\[\^?\]?[^\]]*\][*+?{]?",
    r"[^)\]}](?:[*?]|\{)",  # a character that need not occur
    r"\{[^}]*\}|[0-9,]*\}",
    r"[.^$()+*?{}\[\]]",
]
#: Patterns with alternatives, inline flags, look-around or an optional group have no literals that are sure to occur.
_UNSURE = r"\||\(\?|\)[*?{]|&&|\[[^\]]*\["
#: Longest literals that the index holds.
GRAM = 4


def literal_runs(pattern: Column, ignore_case: bool = False) -> Column:
    """Runs of characters that every match of a regular expression must hold, longest first; empty if none is sure."""
    bare = pattern = F.replace(pattern, F.lit("(?:"), F.lit("("))
    for part in _NO_LITERALS:
        bare = F.regexp_replace(bare, part, "\0")
    runs = F.filter(F.split(F.lower(bare) if ignore_case else bare, "\0"), lambda r: r != "")
    none = F.array().cast("array<string>")
    # Letters outside ASCII may be equal without case although their lower case is not.
    sure = ~pattern.rlike(_UNSURE) & (F.lit(not ignore_case) | ~pattern.rlike(r"[^\x00-\x7F]"))
    return F.when(sure, F.array_sort(F.array_distinct(runs), lambda x, y: F.length(y) - F.length(x))).otherwise(none)


def _grams(text: Column, n: Column) -> Column:
    """Distinct runs of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))


def pattern_hits(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, anchored: bool = False, ignore_case: bool = False, gram: int = GRAM) -> DataFrame:
    """Distinct pairs of texts and the patterns (regular expressions) found in them.

    The literals that a match must hold make an index: of each pattern the rarest run of `gram` characters (shorter ones
    for patterns with no longer literal), counted over the texts; texts meet patterns by such a run and only then is the
    expression tried. Patterns without a sure literal are kept apart, in one row, and tried on every text.
    """
    both = texts.select(text).where(F.col(text).isNotNull()).distinct()
    known = patterns.select(pattern).where(F.col(pattern).isNotNull()).distinct()
    known = written(known.withColumn("_run", F.get(literal_runs(F.col(pattern), ignore_case), F.lit(0))).withColumn("_all", literal_runs(F.col(pattern), ignore_case)))
    form = f"concat('{'(?i)' * ignore_case}{'^' * anchored}(?:', `{pattern}`, ')')"
    out = None
    indexed = known.where("_run is not null").withColumn("_n", F.least(F.length("_run"), F.lit(gram)))
    if not indexed.isEmpty():
        keys = indexed.select(pattern, "_n", F.explode(F.flatten(F.transform(F.filter("_all", lambda r: F.length(r) >= F.col("_n")), lambda r: _grams(r, F.col("_n"))))).alias("_gram"))
        lengths = [r._n for r in indexed.select("_n").distinct().collect()]  # at most `gram` numbers
        cut = both.select(text, F.explode(F.array(*map(F.lit, lengths))).alias("_n")).where(F.length(text) >= F.col("_n"))
        held = cut.select(text, F.explode(_grams(F.lower(text) if ignore_case else F.col(text), F.col("_n"))).alias("_gram"))
        # Texts that hold each run; runs of patterns that no text holds stay, and find nothing.
        often = held.join(bounded(keys.select("_gram").distinct()), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
        rare = keys.join(often, "_gram", "left").groupBy(pattern).agg(F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), "_gram")).alias("_gram"))
        out = held.join(bounded(written(rare)), "_gram").where(F.expr(f"`{text}` rlike {form}")).select(text, pattern)
    apart = known.where("_run is null")
    if out is None or not apart.isEmpty():
        one = F.broadcast(apart.agg(F.collect_list(pattern).alias("_all")).withColumn("_one", F.lit(1)))
        tried = both.withColumn("_one", F.lit(1)).join(one, "_one").select(text, F.explode("_all").alias(pattern)).where(F.expr(f"`{text}` rlike {form}"))
        out = tried if out is None else out.unionByName(tried)
    return out


def pattern_join(df: DataFrame, patterns: DataFrame, text: str, pattern: str, how: str = "inner", anchored: bool = False, ignore_case: bool = False) -> DataFrame:
    """Rows of df with the patterns found in them, through the index of pattern_hits(). how: inner, left, left_semi or left_anti."""
    hits = pattern_hits(df, patterns, text, pattern, anchored, ignore_case)
    if how in ("left_semi", "left_anti"):
        return df.join(hits.select(text).distinct(), text, how)
    columns = [c for c in patterns.columns if c != pattern]
    return df.join(hits.join(patterns, pattern).select(text, *columns, pattern), text, how).select(*df.columns, *patterns.columns)


def exclusive(df: DataFrame, patterns: DataFrame, text: str, pattern: str, order: list, anchored: bool = False, ignore_case: bool = False) -> DataFrame:
    """Each text with the first pattern, in order, that it matches: patterns take their texts in turn and what one has
    taken is gone for those behind it. Texts that no pattern matches are left out."""
    from .sequence import best

    hits = pattern_hits(df, patterns, text, pattern, anchored, ignore_case).join(patterns, pattern)
    return best(hits, [text], *order, pattern).select(text, *patterns.columns)


def file_patterns(files: DataFrame, stem: str) -> tuple[DataFrame, list[Column]]:
    """(files with their pattern of device names, the order in which they take devices): longer names first, then fewer
    wildcards, then those whose wildcards begin earlier, then by name; wildcards at the end count for nothing."""
    name = F.regexp_replace(stem, "x+$", "")
    # What stands for what in the names of description files.
    form = F.replace(F.replace(F.replace(name, F.lit("x"), F.lit(".")), F.lit("_CM"), F.lit(".*?@m")), F.lit("...A"), F.lit(".....A"))
    order = [F.length("_name").desc(), F.length("_name") - F.length(F.replace("_name", F.lit("x"), F.lit(""))), F.greatest(F.instr("_name", "x") - 1, F.lit(0)), F.col("_name")]
    return files.withColumn("_name", name).withColumn("pattern", form), order


def devices_of_files(devices: DataFrame, files: DataFrame, device: str, stem: str) -> DataFrame:
    """(device, stem): each device with the file that describes it, by names with wildcards, whatever their case."""
    named, order = file_patterns(files.select(stem).distinct(), stem)
    # Names that differ in trailing wildcards only share a pattern; the first of them has the devices.
    from .sequence import best

    first = best(named, ["pattern"], *order, stem)
    return exclusive(devices, first, device, "pattern", order, anchored=True, ignore_case=True).select(device, stem)


def _crowded(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with more than KEY_PAIRS pairs, written: each has more than KEY_PAIRS ** 0.5 rows on one side, and only keys
    with so many are counted on both."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    often = lambda df: written(count(df, "_n").where(F.col("_n") > KEY_PAIRS**0.5).select(*keys))
    many = often(left).unionByName(often(right))
    if many.isEmpty():
        return many
    part = lambda df: df.join(bounded(many), keys, "left_semi")
    found = count(part(left), "_nl").join(count(part(right), "_nr").hint("merge"), keys).where(F.col("_nl") * F.col("_nr") > KEY_PAIRS)
    return written(found.select(*keys))


def box_join(left: DataFrame, right: DataFrame, keys: list[str] | None = None, cell: float = FINEST, names: tuple[str, str] = ("box", "other"), most: int | None = None) -> DataFrame:
    """Pairs of closed boxes (columns of structs l, b, r, t) of any widths that share a point.

    Along each axis the wider one of a pair owns the level at which they meet (the left one if they are of one level): it is
    cut into the at most two cells that it touches there, the other one into the at most two that it touches. So a box
    becomes at most four rows for each pair of levels of the other side, and many narrow boxes never gather in the wide cell
    of a wide one. A pair is kept in the cell of its common lower left corner only. Null corners meet nothing. Boxes of a
    key with up to KEY_PAIRS pairs are compared as they are, without cells.
    """
    keys, (a, o) = keys or [], names
    corners = lambda df, box: _levelled(df.where(" and ".join(f"{box}.{c} is not null" for c in "lbrt")), *[F.col(f"{box}.{c}") for c in "lbrt"], cell)
    boxes, others = corners(left, a), corners(right, o)
    alone = None
    if keys:
        crowded = _crowded(boxes, others, keys)
        part = lambda how: (boxes.join(bounded(crowded), keys, how), others.join(bounded(crowded), keys, how))
        none = crowded.isEmpty()
        x, y = (boxes, others) if none else part("left_anti")
        alone = x.drop("_own").join(y.drop("_own").hint("merge"), keys).where(intersects(F.col(a), F.col(o)))
        if none:
            return alone
        boxes, others = part("left_semi")

    def tiled(df: DataFrame, box: str, levels: Column, is_left: bool) -> DataFrame:
        def meet(axis):
            own, other = F.col(f"_own.{axis}"), lambda p: p[axis]
            owns = (lambda p: own >= other(p)) if is_left else (lambda p: other(p) >= own)
            return lambda p: (F.greatest(own, other(p)).alias(axis), owns(p).alias(f"left_{axis}"))

        places = F.array_distinct(F.transform(levels, lambda p: F.struct(*meet("x")(p), *meet("y")(p))))
        at = df.withColumn("_at", F.explode(places)).drop("_own")
        at = _cut(at, F.col(f"{box}.l"), F.col(f"{box}.r"), F.col("_at.x"), "_cx", cell)
        return _cut(at, F.col(f"{box}.b"), F.col(f"{box}.t"), F.col("_at.y"), "_cy", cell)

    x, y, on = _split_heavy(tiled(boxes, a, _levels(others)[0], True), tiled(others, o, _levels(boxes)[0], False), [*keys, "_at", "_cx", "_cy"], most)
    corner = lambda k, axis: cell_of(F.greatest(F.col(f"{a}.{k}"), F.col(f"{o}.{k}")), F.col(f"_at.{axis}"), cell)
    met = x.join(y.hint("merge"), on).where(intersects(F.col(a), F.col(o)) & (corner("l", "x") == F.col("_cx")) & (corner("b", "y") == F.col("_cy"))).drop("_at", "_cx", "_cy", "_i", "_j")
    return met if alone is None else alone.unionByName(met)


def prefix_join(df: DataFrame, prefixes: DataFrame, text: str, prefix: str, how: str = "inner") -> DataFrame:
    """Rows with the prefixes they start with, for any kind of join.

    Texts are cut at each length that occurs among the prefixes and joined on the cut; the lengths are one aggregated row.
    """
    lengths = prefixes.agg(F.collect_set(F.length(prefix)).alias("_lengths")).withColumn("_one", F.lit(1))
    texts = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn("_one", F.lit(1))
    cut = texts.join(F.broadcast(lengths), "_one").select(text, F.explode("_lengths").alias("_n")).where(F.length(text) >= F.col("_n"))
    hits = cut.withColumn("_cut", F.expr(f"left(`{text}`, _n)")).join(prefixes, F.col("_cut") == F.col(prefix)).drop("_cut", "_n")
    return df.join(hits, text, how)


def ranked_join(df: DataFrame, *candidates: tuple[DataFrame, Column], keys: list[str], order: list | None = None) -> DataFrame:
    """Candidates of several levels; for each key, those of the first level that has any (and of them the first in order)."""
    found = None
    for level, (other, on) in enumerate(candidates):
        hit = df.join(other, on).withColumn("level", F.lit(level))
        found = hit if found is None else found.unionByName(hit)
    from .sequence import best

    return best(found, keys, "level", *(order or []))


def assigned(df: DataFrame, prefixes: DataFrame, key: str, prefix: str) -> DataFrame:
    """Each key with the longest prefix it starts with, so that a shorter one never takes what a longer one has."""
    from .sequence import best

    return best(prefix_join(df, prefixes, key, prefix), [key], F.length(prefix).desc(), prefix)
