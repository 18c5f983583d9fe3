"""Layout analysis over glyph and path tables.

Ordered folds that carry state from row to row (line merging, border repair, span merging, first-fit clustering) run in
one group a page or table, which is small by nature; everything else is expressions and windows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written
from .sequence import ordered
from .spatial import BROADCAST_ROWS, bounded


def char_lines(chars: DataFrame, keys: list[str], y: str, order: list[str], value: str) -> DataFrame:
    """Characters by rounded height: (keys, y, chars in order)."""
    return chars.groupBy(*keys, F.round(y, 1).alias("y")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"]).alias("chars"))


def linked(chars: DataFrame, links: DataFrame, index: str) -> DataFrame:
    """Characters with the link whose half-open index range [lo, hi) holds them; of several, the last. Ranges of any
    length and characters meet in nested cells of the index, so none is compared with all."""
    from .spatial import range_join

    spans = links.where("lo < hi").select("url", "ord", F.col("lo").alias("l"), (F.col("hi") - 1).alias("r"), F.lit(0).alias("b"), F.lit(0).alias("t"))
    return range_join(chars.withColumn("_y", F.lit(0)), spans, index, "_y").groupBy(index).agg(F.max_by("url", "ord").alias("url"))


def gaps(df: DataFrame, keys: list[str], lo: str, hi: str, tie: str) -> DataFrame:
    """Stretches between the first and last interval of a key that no interval covers: (keys, since, until)."""
    reached = F.max(hi).over(ordered(keys, lo, tie).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("since", reached).where(F.col("since") < F.col(lo)).select(*keys, "since", F.col(lo).alias("until"))


def appended(rows: DataFrame, table: list[str], y: str, within: list[str] | None = None) -> DataFrame:
    """Tables one below the other: each row number is moved down by the rows of the tables before, in the order of the
    table's columns. within: what the tables belong to (a document); without it, all tables are one sequence.

    Only one count a table is summed up: per document, or else first within ranges of tables and then over the ranges.
    """
    counts = rows.groupBy(*(within or []), *table).agg((F.max(y) + 1).alias("_n"))
    since = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if within:
        counts = counts.withColumn("_before", since(ordered(within, *table)))
    else:
        counts = written(counts.repartitionByRange(*table).withColumn("_part", F.spark_partition_id()))
        parts = counts.groupBy("_part").agg(F.sum("_n").alias("_n")).withColumn("_one", F.lit(1))
        parts = parts.select("_part", since(ordered(["_one"], "_part")).alias("_base"))  # one row a range
        counts = counts.withColumn("_own", since(ordered(["_part"], *table))).join(parts, "_part").withColumn("_before", F.col("_own") + F.col("_base"))
    moved = rows.join(counts.select(*(within or []), *table, "_before"), [*(within or []), *table])
    return moved.withColumn(y, (F.col(y) + F.col("_before")).cast("bigint")).drop("_before")


def header_rows(cells: DataFrame, table: list[str], y: str, threshold: float) -> DataFrame:
    """Whether the share of bold cells in a row exceeds the threshold."""
    return cells.groupBy(*table, y).agg((F.avg(F.col("bold").cast("int")) > threshold).alias("header"))


def widened(cells: DataFrame, x: str, y: str, rows: int, by: int) -> DataFrame:
    """The lower half of a stacked table moved to the right of the upper one."""
    low = F.col(y) > rows
    return cells.withColumns({x: F.when(low, F.col(x) + by).otherwise(F.col(x)), y: F.when(low, F.col(y) - rows).otherwise(F.col(y))})


def grid_lines(lines: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Ruling lines less than gap apart as one, at their rounded mean; index counts them in each key."""
    from .sequence import gap_clusters

    c = gap_clusters(lines, keys, [at], F.col(at), gap, out="index")
    return c.groupBy(*keys, "index").agg(F.bround(F.avg(at)).alias("at")).withColumn("index", F.col("index") - 1)


def _folded(df: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(fold, schema)


def first_fit_clusters(df: DataFrame, keys: list[str], schema: str, tolerance: float = 0.0) -> DataFrame:
    """Column cluster: each interval (lo, hi), from the lowest, joins the first cluster that it overlaps and widens it.

    Greedy and order-dependent; merged_intervals() in sequence.py is the transitive form without Python.
    """

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["lo", "hi"], kind="stable")
        found: list[list[float]] = []
        at = []
        for lo, hi in zip(p.lo, p.hi):
            for k, c in enumerate(found):
                if c[1] + tolerance > lo and c[0] < hi + tolerance:
                    c[0], c[1] = min(c[0], lo), max(c[1], hi)
                    at.append(k)
                    break
            else:
                found.append([lo, hi])
                at.append(len(found) - 1)
        return p.assign(cluster=at)

    return _folded(df, keys, fold, schema + ", cluster int")


def merged_lines(df: DataFrame, keys: list[str], schema: str, rtol: float = 0.25) -> DataFrame:
    """Column line: glyph rows (origin, height, x) whose origins lie within rtol of the taller row's height are one line."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["origin", "x"], ascending=[False, True], kind="stable")
        line, origin, height, out = -1, None, 0.0, []
        for o, h in zip(p.origin, p.height):
            if origin is None or abs(o - origin) > rtol * max(h, height):
                line, origin, height = line + 1, o, h
            elif h > height:
                origin, height = o, h
            out.append(line)
        return p.assign(line=out).sort_values(["line", "x"], kind="stable")

    return _folded(df, keys, fold, schema + ", line int")


def repaired_borders(df: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Places (y up, x, l, b, r, t: border widths) whose open borders are closed where only one of both sides looks like a span.

    An open top is closed, for both neighbours, if the place is closed on its right but the place above is not closed on
    both sides, or the other way round; an open right side likewise by the tops and the place on the right. Beyond the
    grid, places count as open but for the side that faces away. Each change counts for the places after it, row by row.
    """

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        grid = {(y, x): {s: float(v) for s, v in zip("lbrt", sides)} for y, x, *sides in zip(p.y, p.x, p.l, p.b, p.r, p.t)}
        for y, x in sorted(grid):
            here = grid[y, x]
            above = grid.get((y + 1, x), {"l": 0, "b": 1, "r": 0, "t": 0})
            right = grid.get((y, x + 1), {"l": 0, "b": 0, "r": 1, "t": 0})
            if not here["t"] and bool(here["r"]) != bool(above["l"] and above["r"]):
                here["t"] = above["b"] = 1.0
            if not here["r"] and bool(here["t"]) != bool(right["b"] and right["t"]):
                here["r"] = right["l"] = 1.0
        return p.assign(**{s: [grid[q][s] for q in zip(p.y, p.x)] for s in "lbrt"})

    return _folded(df, keys, fold, schema)


def merged_spans(df: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Column cell: places joined to those on their right and above wherever the border between them is open."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        places = {(y, x): (r, t) for y, x, r, t in zip(p.y, p.x, p.r, p.t)}
        cell: dict[tuple[int, int], int] = {}
        for start in sorted(places):
            if start in cell:
                continue
            number, stack = len(set(cell.values())), [start]
            while stack:
                y, x = stack.pop()
                if (y, x) in cell:
                    continue
                cell[y, x] = number
                r, t = places[y, x]
                stack += [q for q, open_ in (((y, x + 1), r == 0), ((y + 1, x), t == 0)) if open_ and q in places and q not in cell]
        return p.assign(cell=[cell[y, x] for y, x in zip(p.y, p.x)])

    return _folded(df, keys, fold, schema + ", cell int")


def areas(pages: DataFrame, templates: DataFrame, template: Column) -> DataFrame:
    """Areas of each page: fractional boxes of its template (id, area, fl, fb, fr, ft, first_page_only) in page units."""
    placed = pages.withColumn("template", template).join(bounded(templates), "template")
    placed = placed.where("not first_page_only or page = 0")
    return placed.select("doc", "page", "area", (F.col("fl") * F.col("width")).alias("l"), (F.col("fb") * F.col("height")).alias("b"), (F.col("fr") * F.col("width")).alias("r"), (F.col("ft") * F.col("height")).alias("t"))


def captioned(captions: DataFrame, graphics: DataFrame, keys: list[str]) -> DataFrame:
    """Captions (cap, l, r, y) with the nearest graphic (graphic, gl, gr, top) below them in their columns; each graphic once."""
    met = captions.join(graphics, keys).where("top <= y and gl < r and l < gr")
    near = met.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "cap").orderBy(F.col("y") - F.col("top"), "graphic"))).where("_k = 1")
    return near.withColumn("_g", F.row_number().over(Window.partitionBy(*keys, "graphic").orderBy(F.col("y") - F.col("top"), "cap"))).where("_g = 1").drop("_k", "_g")


def prepared_chars(chars: DataFrame) -> DataFrame:
    """Characters without carriage returns, control characters and the registered sign, with soft hyphens and private
    bullets replaced, and the octant (0 to 7) that their line runs in."""
    code = F.col("unicode")
    char = F.when(code == 2, "-").when(code.isin(61623, 61664), "•").otherwise(F.col("char"))
    kept = chars.where(~((code < 32) & ~code.isin(2, 10) | (code == 174)))
    return kept.withColumns({"char": char, "octant": F.pmod(F.floor((F.col("rotation") + 22.5) / 45), F.lit(8)).cast("int")})


def built_lines(chars: DataFrame, keys: list[str], rtol: float = 0.25) -> DataFrame:
    """(keys, octant, line, chars, text) of prepared characters (x, origin, height): rows of equal rounded origin are
    merged while their origins lie close to each other; characters in order of x, line breaks last; blank lines go."""
    rows = chars.groupBy(*keys, "octant", F.round("origin", 1).alias("origin")).agg(F.max("height").alias("height"), F.min("x").alias("x"), F.collect_list(F.struct(F.when(F.col("char") == "\n", 1).otherwise(0).alias("last"), "x", "idx", "char")).alias("c"))
    types = dict(chars.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "octant int, origin double, height double, x double"])
    numbered = merged_lines(rows.select(*keys, "octant", "origin", F.col("height").cast("double").alias("height"), F.col("x").cast("double").alias("x")), [*keys, "octant"], schema, rtol)
    met = rows.select(*keys, "octant", "origin", "c").join(numbered.select(*keys, "octant", "origin", "line"), [*keys, "octant", "origin"])
    lines = met.groupBy(*keys, "octant", "line").agg(F.sort_array(F.flatten(F.collect_list("c"))).alias("c"))
    text = F.array_join(F.transform("c", lambda s: s["char"]), "")
    return lines.select(*keys, "octant", "line", F.size("c").alias("chars"), text.alias("text")).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")


def columns_of_text(chars: DataFrame, pages: DataFrame, keys: list[str], band: float = 0.02) -> DataFrame:
    """(keys, columns): two where text stands on both sides of the middle of a page but none across it. pages: (keys, width)."""
    middle, half = F.col("width") / 2, F.col("width") * band / 2
    sides = chars.join(pages.select(*keys, "width"), keys).groupBy(*keys).agg(F.max(F.col("r") < middle).alias("left"), F.max(F.col("l") > middle).alias("right"), F.max((F.col("l") < middle + half) & (F.col("r") > middle - half)).alias("across"))
    return pages.select(*keys).distinct().join(sides, keys, "left").select(*keys, F.when(F.col("left") & F.col("right") & ~F.col("across"), 2).otherwise(1).alias("columns"))


def graphic_clusters(boxes: DataFrame, keys: list[str], tie: str, atol: float = 0.0) -> DataFrame:
    """Boxes (struct box) in clusters of two levels, region by height and subregion by width: (..., region, subregion)."""
    from .sequence import merged_intervals

    flat = boxes.withColumns({"_b": F.col("box.b"), "_t": F.col("box.t"), "_l": F.col("box.l"), "_r": F.col("box.r")})
    by_height = merged_intervals(flat, keys, "_b", "_t", tie, atol, out="region")
    return merged_intervals(by_height, [*keys, "region"], "_l", "_r", tie, atol, out="subregion").drop("_b", "_t", "_l", "_r")


def split_around(areas: DataFrame, objects: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Areas (keys, lo, hi) cut by the objects (keys, olo, ohi) in them: (keys, kind, lo, hi), what the objects leave of an
    area if it is at least so high, as text, and the merged objects."""
    from .sequence import merged_intervals

    own = objects.withColumn("_id", F.xxhash64(*keys, "olo", "ohi"))
    merged = merged_intervals(own, keys, "olo", "ohi", "_id", out="_region").groupBy(*keys, "_region").agg(F.min("olo").alias("lo"), F.max("ohi").alias("hi")).drop("_region")
    ends = areas.select(*keys, F.col("lo").alias("_since"), F.col("hi").alias("_until")).join(merged, keys, "left")
    w = ordered(keys, "lo")
    spans = ends.withColumns({"_from": F.coalesce(F.lag("hi").over(w), F.col("_since")), "_last": F.lead("lo").over(w).isNull()})
    before = spans.select(*keys, F.col("_from").alias("lo"), F.coalesce("lo", "_until").alias("hi"))
    after = spans.where("_last and hi is not null").select(*keys, F.col("hi").alias("lo"), F.col("_until").alias("hi"))
    text = before.unionByName(after).where(F.col("hi") - F.col("lo") >= least).select(*keys, F.lit("text").alias("kind"), "lo", "hi")
    return text.unionByName(merged.select(*keys, F.lit("object").alias("kind"), "lo", "hi"))


def side_by_side(captions: DataFrame, keys: list[str], y: str, x: str, width: str) -> DataFrame:
    """Captions of one row (equal y) with the part of the page's width that each may take: (..., left, right), cut half way
    between one caption and the next."""
    w = ordered([*keys, y], x)
    return captions.withColumns({"left": F.coalesce((F.lag(x).over(w) + F.col(x)) / 2, F.lit(0.0)), "right": F.coalesce((F.lead(x).over(w) + F.col(x)) / 2, F.col(width))})


def graphic_class(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class): `figure` with an image or mostly other shapes, `table` where most lines are stroked or two thirds of
    the points are corners. paths: (keys, kind: image, line or other, stroked, corners, points)."""
    lines = F.count_if((F.col("kind") == "line") & F.col("stroked"))
    found = paths.groupBy(*keys).agg(F.max(F.col("kind") == "image").alias("_i"), (2 * lines > F.count(F.lit(1))).alias("_s"), (3 * F.sum("corners") >= 2 * F.sum("points")).alias("_c"))
    return found.select(*keys, F.when(F.col("_i"), "figure").when(F.col("_s") | F.col("_c"), "table").otherwise("figure").alias("class"))


def cell_borders(cells: DataFrame, lines: DataFrame, keys: list[str], cell: list[str], near: float) -> DataFrame:
    """Border widths of cells (keys, cell, l, b, r, t): on each side that of the first line (by ord) that spans the middle
    of the side and lies at most near from it, 0 without one. lines: (keys, ord, direction, at, lo, hi, width)."""
    middle = {"l": ("vertical", "b", "t"), "r": ("vertical", "b", "t"), "b": ("horizontal", "l", "r"), "t": ("horizontal", "l", "r")}
    each = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(d).alias("direction"), F.col(s).alias("place"), ((F.col(x) + F.col(y)) / 2).alias("middle")) for s, (d, x, y) in middle.items()])
    sides = cells.select(*keys, *cell, F.explode(each).alias("s")).select(*keys, *cell, "s.*")
    # Lines and sides meet in cells of the grid that the tolerance makes along the lines' direction of shift.
    step = F.lit(max(near, 1e-9) * 2)
    placed = sides.withColumn("_g", F.explode(F.sequence(F.floor((F.col("place") - near) / step), F.floor((F.col("place") + near) / step))))
    ruled = lines.withColumn("_g", F.floor(F.col("at") / step))
    # Lines, counted by a job, meet the sides without moving them if they are few.
    ruled = F.broadcast(ruled) if lines.count() <= BROADCAST_ROWS else ruled.hint("merge")
    met = placed.join(ruled, [*keys, "direction", "_g"]).where((F.abs(F.col("at") - F.col("place")) <= near) & F.col("middle").between(F.col("lo"), F.col("hi")))
    widths = met.groupBy(*keys, *cell).pivot("side", list("lbrt")).agg(F.min_by("width", "ord"))
    return cells.select(*keys, *cell).distinct().join(widths, [*keys, *cell], "left").na.fill(0, list("lbrt"))


def header_by_lines(cells: DataFrame, lines: DataFrame, table: list[str], y: str, threshold: float = 0.33) -> DataFrame:
    """(table, y, header): rows above the lowest of the thick lines (at least nine tenths of the widest) that follow the
    top, if their share of bold cells exceeds the threshold; tables without such lines by their bold cells alone, down to
    the first row that is not bold. lines: (table, below: the row that a line stands under, -1 for the top; width)."""
    widest = F.max("width").over(Window.partitionBy(*table))
    thick = lines.withColumn("_w", widest).where((F.col("width") >= 0.9 * F.col("_w")) & (F.col("below") >= 0)).groupBy(*table).agg(F.min("below").alias("_end"))
    share = cells.groupBy(*table, y).agg((F.avg(F.col("bold").cast("int")) > threshold).alias("_bold"))
    last = F.min(F.when(~F.col("_bold"), F.col(y))).over(Window.partitionBy(*table))
    rows = share.withColumn("_plain", last).join(thick, table, "left")
    by_bold = F.col("_bold") & (F.col("_plain").isNull() | (F.col(y) < F.col("_plain")))
    return rows.select(*table, y, F.when(F.col("_end").isNotNull(), (F.col(y) <= F.col("_end")) & F.col("_bold")).otherwise(by_bold).alias("header"))


def object_linked(chars: DataFrame, links: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, index, target): characters (x, y: their middle) within the box of a link (l, b, r, t, target, ord); of several, the last."""
    from .spatial import range_join

    return range_join(chars, links, "x", "y", keys).groupBy(*keys, index).agg(F.max_by("target", "ord").alias("target"))
