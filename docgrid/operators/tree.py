"""Document trees as node tables (doc, node, parent, ord, name, ...)."""

from __future__ import annotations

import html as _html

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written
from .recursion import recursive
from .sequence import ordered, running_key, runs

#: Kinds of lines by the first pattern that fits.
KINDS = [
    ("heading", r"^\d+(\.\d+)*\s+\S"),
    ("note", r"^(Note|Caution|Warning):?"),
    ("caption", r"^(Table|Figure) \d+\."),
    ("listb", r"^•\s"),
    ("lists", r"^[–-]\s"),
    ("lista", r"^[a-z]\)\s"),
    ("listn", r"^\d+[.)]\s"),
    ("bit", r"^Bits? \d+(:\d+)?\s"),
]


def line_kind(text: Column) -> Column:
    out = F.lit("para")
    for name, pattern in reversed(KINDS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def heading_depth(text: Column) -> Column:
    """Dots of the section number plus two."""
    return F.length(F.regexp_replace(F.regexp_extract(text, r"^(\d+(\.\d+)*)\s", 1), r"[^.]", "")) + 2


def sections(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines with the heading they stand under."""
    return lines.withColumn("section", running_key(F.when(F.col("name") == "heading", F.col(order)), ordered(keys, order)))


def list_groups(nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs of sibling list items of one kind: (first, name, members)."""
    own = runs(nodes, keys, [order], "name").where(F.col("name").startswith("list"))
    return own.groupBy(*keys, "island").agg(F.min(order).alias("first"), F.min("name").alias("name"), F.count(F.lit(1)).alias("members")).drop("island")


def collapsed(nodes: DataFrame) -> DataFrame:
    """Children of paragraphs that have no others take their parent's place."""
    only = nodes.groupBy("doc", "parent").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    paras = nodes.where("name = 'para'").select("doc", F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("ord").alias("_ord"))
    sole = only.join(paras, ["doc", "parent"]).select("doc", "parent", "_up", "_ord", F.lit(True).alias("_sole"))
    moved = nodes.join(sole, ["doc", "parent"], "left").withColumns({"parent": F.when(F.col("_sole"), F.col("_up")).otherwise(F.col("parent")), "ord": F.coalesce("_ord", "ord")}).drop("_up", "_ord", "_sole")
    return moved.join(sole.select("doc", F.col("parent").alias("node")), ["doc", "node"], "left_anti")


def attached_captions(nodes: DataFrame, keys: list[str], order: str, ahead: int = 5) -> DataFrame:
    """For each caption, the first table or figure among the ahead nodes after it (null: the caption goes)."""
    w = ordered(keys, order).rowsBetween(1, ahead)
    target = F.first(F.when(F.col("name").isin("table", "figure"), F.col("node")), ignorenulls=True).over(w)
    return nodes.withColumn("target", target).where("name = 'caption'")


def table_numbers(nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Tables over several pages share the number of the last caption."""
    return nodes.withColumn("number", running_key(F.col("number"), ordered(keys, order)))


def sorted_levels(nodes: DataFrame, key: Column) -> DataFrame:
    return nodes.withColumn("ord", F.row_number().over(Window.partitionBy("doc", "parent").orderBy(key)) - 1)


def at_depth(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes at most so many levels below the roots, with their level."""
    start = nodes.where("parent is null").withColumn("level", F.lit(0))
    step = {c: f"e.`{c}`" for c in nodes.columns} | {"level": "t.level + 1"}
    return recursive(start, nodes, f"t.doc = e.doc AND t.node = e.parent AND t.level < {most}", most + 1, **step)


def styled(runs_of: list[tuple[str, frozenset[str]]]) -> str:
    """Runs (text, styles) as nested tags; tags that go on are not closed between runs."""
    order, open_, out = ["p", "b", "i", "u", "sub", "sup"], [], []
    for text, styles in [*runs_of, ("", frozenset())]:
        keep = 0
        while keep < len(open_) and open_[keep] in styles:
            keep += 1
        out += [f"</{t}>" for t in reversed(open_[keep:])]
        new = [t for t in order if t in styles and t not in open_[:keep]]
        open_ = open_[:keep] + new
        out += [f"<{t}>" for t in new]
        out.append(_html.escape(text, quote=False).replace("\n", "<br>"))
    return "".join(out)


def paths(nodes: DataFrame, most: int = 500) -> DataFrame:
    """Nodes with path: the places (ord) of their ancestors and their own. Ascending paths are pre-order; descending ones
    are the reverse traversal, in which the last leaf comes first and children come before their parents.

    Nodes under no root, those of a cycle among them, are left out. Trees of more than `most` levels below their roots
    raise ValueError.
    """
    start = nodes.where("parent is null").withColumn("path", F.array(F.col("ord").cast("int")))
    step = {c: f"e.`{c}`" for c in nodes.columns} | {"path": "concat(t.path, array(CAST(e.ord AS INT)))"}
    found = written(recursive(start, nodes, f"t.doc = e.doc AND t.node = e.parent AND size(t.path) <= {most + 1}", most + 2, **step))
    if not found.where(F.size("path") > most + 1).isEmpty():
        raise ValueError(f"trees are deeper than {most} levels")
    return found


def reverse_order(pathed: DataFrame) -> DataFrame:
    """Column reverse: the place of each node in the reverse traversal of its document."""
    return pathed.withColumn("reverse", F.row_number().over(Window.partitionBy("doc").orderBy(F.col("path").desc())) - 1)


def stripped(values: Column, unwanted) -> Column:
    """An array without the unwanted values at both its ends."""
    flags = F.transform(values, lambda v: ~F.coalesce(unwanted(v), F.lit(False)))
    first, last = F.array_position(flags, True), F.size(values) - F.array_position(F.reverse(flags), True) + 1
    return F.when(first > 0, F.slice(values, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.slice(values, 1, 0))


def page_markers(pathed: DataFrame) -> DataFrame:
    """(doc, page, node): the first leaf of each page, which carries the page's mark. Nodes need path and page."""
    inner = pathed.select("doc", F.col("parent").alias("node")).where("node is not null").distinct()
    return pathed.join(inner, ["doc", "node"], "left_anti").groupBy("doc", "page").agg(F.min_by("node", "path").alias("node"))


def relative_x(nodes: DataFrame) -> DataFrame:
    """x relative to its area's left (column area_x): list items by the left of their first character (column left)."""
    return nodes.withColumn("x", F.when(F.col("name").startswith("list"), F.floor("left").cast("double")).otherwise(F.col("x")) - F.col("area_x"))


def merged_areas(nodes: DataFrame, em: float) -> DataFrame:
    """Areas of a document's pages as one tree: parents of the areas' top nodes are set.

    nodes: (doc, area, ord, node, parent, name, x, italic), nodes numbered in pre-order, x relative to the area. What an
    area holds before its first heading goes on where the document ended: list items below the nearest ancestor of the
    end that stands between one and four em to their left, or is a heading; slanted paragraphs behind a note into the
    note; the rest below the nearest heading. The first heading becomes a child of the document and takes what follows.
    The end is the last heading, list item or note, or else the last node. One document is one group.
    """
    schema = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    marks = ("head", "list", "note")

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([("area", "ascending"), ("node", "ascending")])
        listed = lambda c: t[c].to_pylist()
        nodes, parents = listed("node"), listed("parent")
        parent, name, italic = dict(zip(nodes, parents)), dict(zip(nodes, listed("name"))), dict(zip(nodes, listed("italic")))
        x = {n: float("nan" if v is None else v) for n, v in zip(nodes, listed("x"))}
        below: dict = {}
        for n, q in parent.items():
            below.setdefault(q, []).append(n)
        tops: dict = {}
        for area, n, q in zip(listed("area"), nodes, parents):
            if area is not None and q is None:
                tops.setdefault(area, []).append(n)

        last = marked = None  # of the nodes so far, in pre-order

        def ancestor(fits) -> int | None:
            n = end
            while n is not None and not fits(n):
                n = parent[n]
            return n

        for area in tops:
            heading = None
            for n in tops[area]:
                end = last if marked is None else marked
                if heading is not None:
                    parent[n] = heading
                elif name[n].startswith("head"):
                    heading, parent[n] = n, None
                elif name[n].startswith("list"):
                    parent[n] = ancestor(lambda c, n=n: name[c].startswith("head") or -4 * em < x[c] - x[n] < -em)
                elif name[n] == "para" and italic[n] and end is not None and name[end] == "note":
                    parent[n] = end
                else:
                    parent[n] = ancestor(lambda c: name[c].startswith("head"))
                stack = [n]
                while stack:
                    last = stack.pop()
                    marked = last if name[last].startswith(marks) else marked
                    stack += below.get(last, [])[::-1]
        k = t.schema.get_field_index("parent")
        return t.set_column(k, t.schema.field(k), pa.array([parent[n] for n in nodes], t.schema.field(k).type))

    return nodes.groupBy("doc").applyInArrow(fold, schema)


def printed(pathed: DataFrame) -> DataFrame:
    """(doc, text): the tree as indented lines, for looking at."""
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), "name", F.coalesce(F.concat(F.lit(": "), "text"), F.lit("")))
    return pathed.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", line.alias("l")))), lambda s: s["l"]), "\n").alias("text"))


def normalised(lines: DataFrame, *rules) -> DataFrame:
    """Rules (DataFrame to DataFrame) applied one after the other; without any, the usual ones: kinds of lines, depths of
    headings, and the heading that each line stands under."""
    usual = (
        lambda d: d.withColumn("name", line_kind(F.col("text"))),
        lambda d: d.withColumn("depth", F.when(F.col("name") == "heading", heading_depth(F.col("text")))),
        lambda d: sections(d, ["doc"], "ord"),
    )
    for rule in rules or usual:
        lines = lines.transform(rule)
    return lines


#: Elements of node kinds; lists are wrapped by serialised().
TAGS = {"heading": "h{depth}", "para": "p", "note": "div", "caption": "p", "listb": "li", "lists": "li", "lista": "li", "listn": "li"}
LISTS = {"listb": "ul", "lists": "ul", "lista": 'ol type="a"', "listn": "ol"}


def serialised(nodes: DataFrame) -> DataFrame:
    """(doc, html): each document's tree as HTML. One document is one group.

    Nodes may have a column runs (array of structs text, styles), which is written in place of the text with nested tags,
    and a column html (a table's cells, as tables.as_html() makes them), which is written as it is. Neighbouring list
    items of one kind are wrapped by one list.
    """
    for name, kind in (("runs", "array<struct<text:string,styles:array<string>>>"), ("html", "string")):
        if name not in nodes.columns:
            nodes = nodes.withColumn(name, F.lit(None).cast(kind))

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        children: dict = {}
        for r in p.sort_values("ord", kind="stable").itertuples():
            children.setdefault(None if pd.isna(r.parent) else r.parent, []).append(r)

        def framed(rows: list) -> list:
            """Nodes with the strings that open and close lists around them."""
            out, open_ = [], None
            for r in [*rows, None]:
                kind = LISTS.get(r.name_) if r is not None else None
                if kind != open_:
                    out += [f"</{open_.split(' ')[0]}>"] if open_ else []
                    out += [f"<{kind}>"] if kind else []
                    open_ = kind
                if r is not None:
                    out.append(r)
            return out

        out: list[str] = []
        stack = framed(children.get(None, []))[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if isinstance(x.html, str):
                out.append(x.html)
                continue
            tag = TAGS.get(x.name_, "div").format(depth=min(6, max(1, int(x.depth or 2) if not pd.isna(x.depth) else 2)))
            inner = styled([(r["text"] or "", frozenset(r["styles"])) for r in x.runs]) if x.runs is not None and len(x.runs) else _html.escape(x.text or "", quote=False)
            out.append(f"<{tag}>{inner}")
            stack.append(f"</{tag}>")
            stack += framed(children.get(x.node, []))[::-1]
        return pd.DataFrame({"doc": [p.doc.iloc[0]], "html": ["<html><body>" + "".join(out) + "</body></html>"]})

    return nodes.withColumnRenamed("name", "name_").groupBy("doc").applyInPandas(fold, "doc bigint, html string")
