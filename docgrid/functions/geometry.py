"""Geometry as column expressions. Boxes are structs (l, b, r, t); x runs right, y up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(l: Column, b: Column, r: Column, t: Column) -> Column:  # noqa: E741
    """A box with its corners in order."""
    return F.struct(F.least(l, r).alias("l"), F.least(b, t).alias("b"), F.greatest(l, r).alias("r"), F.greatest(b, t).alias("t"))


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def direction(x0: Column, y0: Column, x1: Column, y1: Column, absolute: float = 1e-9) -> Column:
    """`vertical`, `horizontal`, `point` or `angled`."""
    same_x, same_y = is_close(x0, x1, absolute=absolute), is_close(y0, y1, absolute=absolute)
    return F.when(same_x & same_y, "point").when(same_x, "vertical").when(same_y, "horizontal").otherwise("angled")


def in_disc(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, tolerance: float = 0.0) -> Column:
    """Whether c lies in the disc over the segment from a to b (the compatible form of a line's `contains`)."""
    sq = lambda x0, y0, x1, y1: (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)
    return sq(ax, ay, cx, cy) + sq(cx, cy, bx, by) + F.lit(tolerance * tolerance) <= sq(ax, ay, bx, by)


def contains_point(a: Column, x: Column, y: Column) -> Column:
    return x.between(a["l"], a["r"]) & y.between(a["b"], a["t"])


def contains_box(a: Column, o: Column) -> Column:
    return contains_point(a, o["l"], o["b"]) & contains_point(a, o["r"], o["t"])


def overlaps_corner(a: Column, o: Column) -> Column:
    """The compatible, asymmetric form: the other's first or last corner lies inside."""
    return contains_point(a, o["l"], o["b"]) | contains_point(a, o["r"], o["t"])


def intersects(a: Column, o: Column) -> Column:
    """The exact form: the boxes share a point."""
    return (a["l"] <= o["r"]) & (o["l"] <= a["r"]) & (a["b"] <= o["t"]) & (o["b"] <= a["t"])


def midpoint(a: Column) -> tuple[Column, Column]:
    return (a["l"] + a["r"]) / 2, (a["b"] + a["t"]) / 2


def offset(a: Column, dx: Column, dy: Column) -> Column:
    """Grown by dx and dy on each side."""
    return F.struct((a["l"] - dx).alias("l"), (a["b"] - dy).alias("b"), (a["r"] + dx).alias("r"), (a["t"] + dy).alias("t"))


def translated(a: Column, dx: Column, dy: Column) -> Column:
    return F.struct((a["l"] + dx).alias("l"), (a["b"] + dy).alias("b"), (a["r"] + dx).alias("r"), (a["t"] + dy).alias("t"))


def joined(*boxes: Column) -> Column:
    side = lambda f, k: reduce(f, [x[k] for x in boxes[1:]], boxes[0][k])
    return F.struct(side(F.least, "l").alias("l"), side(F.least, "b").alias("b"), side(F.greatest, "r").alias("r"), side(F.greatest, "t").alias("t"))


def box_union(a: Column) -> Column:
    """Aggregate: the smallest box around all boxes of a group."""
    return F.struct(F.min(a["l"]).alias("l"), F.min(a["b"]).alias("b"), F.max(a["r"]).alias("r"), F.max(a["t"]).alias("t"))


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + b * y + e, c * x + d * y + f


def regions_overlap(lo0: Column, hi0: Column, lo1: Column, hi1: Column, tolerance: float = 0.0) -> Column:
    return (hi0 + F.lit(tolerance) > lo1) & (lo0 < hi1 + F.lit(tolerance))


def page_rotated(a: Column, rotation: Column, height: Column) -> Column:
    """(l, b, r, t) -> (b, H-r, t, H-l) on rotated pages."""
    turned = F.struct(a["b"].alias("l"), (height - a["r"]).alias("b"), a["t"].alias("r"), (height - a["l"]).alias("t"))
    return F.when(rotation != 0, turned).otherwise(a)


def glyph_rotation(page: Column, glyph: Column) -> Column:
    """A glyph's rotation as seen on its page, 0 to 359; upright text on quarter-turned pages counts as 0."""
    return F.when((page == 90) & (glyph == 90), 0).when((page == 270) & (glyph == 270), 0).otherwise(F.pmod(glyph - page, F.lit(360)))


def usable(loose: Column, tight: Column) -> Column:
    """The loose box, or the tight one where the loose one has no width or height."""
    return F.when((loose["l"] == loose["r"]) | (loose["b"] == loose["t"]), tight).otherwise(loose)


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    wide = lambda c: c.cast("bigint")
    return F.shiftleft(wide(r), 24).bitwiseOR(F.shiftleft(wide(g), 16)).bitwiseOR(F.shiftleft(wide(b), 8)).bitwiseOR(wide(a))


def classified(value: Column, classes: dict[str, float], default: str) -> Column:
    """The first class whose least value is reached; classes from the largest down."""
    out = F.lit(default)
    for name, least in sorted(classes.items(), key=lambda c: c[1]):
        out = F.when(value >= least, name).otherwise(out)
    return out


def script_style(origin: Column, line_origin: Column, height: Column) -> Column:
    """`super`, `sub` or `normal` by the distance of a glyph's origin from its line's."""
    d = origin - line_origin
    return F.when(d > 0.25 * height, "super").when(d < -0.15 * height, "sub").otherwise("normal")


def superscript(text: Column) -> Column:
    return F.translate(text, "0123456789+-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻")


def edges(a: Column) -> Column:
    """The four sides of a box as an array of structs (side, x0, y0, x1, y1)."""
    side = lambda n, x0, y0, x1, y1: F.struct(F.lit(n).alias("side"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.array(side("left", a["l"], a["b"], a["l"], a["t"]), side("right", a["r"], a["b"], a["r"], a["t"]), side("bottom", a["l"], a["b"], a["r"], a["b"]), side("top", a["l"], a["t"], a["r"], a["t"]))


def specialised(x0: Column, y0: Column, x1: Column, y1: Column, absolute: float = 1e-9) -> Column:
    """A line as struct (kind, at, lo, hi): where an upright or level line stands and its ends in order; null for others."""
    kind = direction(x0, y0, x1, y1, absolute)
    upright, level = kind == "vertical", kind == "horizontal"
    of = lambda v, h: F.when(upright, v).when(level, h)
    return F.when(upright | level, F.struct(kind.alias("kind"), of((x0 + x1) / 2, (y0 + y1) / 2).alias("at"), of(F.least(y0, y1), F.least(x0, x1)).alias("lo"), of(F.greatest(y0, y1), F.greatest(x0, x1)).alias("hi")))


def rotated(a: Column, degrees: int) -> Column:
    """A box turned about the origin by quarter turns, counter-clockwise, its corners in order."""
    turns = degrees // 90 % 4
    if degrees % 90:
        raise ValueError("boxes are turned by quarters only")
    if turns == 0:
        return a
    if turns == 2:
        return box(-a["l"], -a["b"], -a["r"], -a["t"])
    sign = 1 if turns == 1 else -1
    return box(-sign * a["b"], sign * a["l"], -sign * a["t"], sign * a["r"])


def rounded(a: Column, digits: int = 0) -> Column:
    return F.struct(*[F.round(a[k], digits).alias(k) for k in "lbrt"])


def colour_class(packed: Column, classes: dict[int, str]) -> Column:
    """The name of a packed colour, `unknown` for others."""
    out = F.lit("unknown")
    for value, name in classes.items():
        out = F.when(packed == F.lit(value), name).otherwise(out)
    return out


def char_style(font: Column, origin: Column, line_origin: Column, height: Column, linked: Column, upright: Column | None = None) -> Column:
    """Array of the styles of a glyph: b, i, u, sup, sub. On lines that run upwards (upright), scripts shift the other way."""
    shift = origin - line_origin if upright is None else F.when(upright, line_origin - origin).otherwise(origin - line_origin)
    script = script_style(shift, F.lit(0.0), height)
    marks = [F.when(font.contains("Bold"), "b"), F.when(font.rlike("Italic|Oblique"), "i"), F.when(linked, "u"), F.when(script == "super", "sup").when(script == "sub", "sub")]
    return F.array_compact(F.array(*marks))


def ruling_lines(a: Column, thin: float) -> Column:
    """Lines that a filled box draws, as array of structs (side, x0, y0, x1, y1): one through the middle of a thin box, the
    four edges of another."""
    x, y = midpoint(a)
    line = lambda name, x0, y0, x1, y1: F.array(F.struct(F.lit(name).alias("side"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
    narrow, low = a["r"] - a["l"] <= thin, a["t"] - a["b"] <= thin
    return F.when(low & (~narrow | (a["r"] - a["l"] >= a["t"] - a["b"])), line("level", a["l"], y, a["r"], y)).when(narrow, line("upright", x, a["b"], x, a["t"])).otherwise(edges(a))


def mean_origin(x: Column, y: Column) -> tuple[Column, Column]:
    """Aggregates: the mean origin of a group of glyphs."""
    return F.avg(x), F.avg(y)
