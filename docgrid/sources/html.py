"""HTML documents as tables: items in document order, dense cell grids of tables, header domains, and look-ups on them.

Parsing is the one step that needs Python: a tolerant event parser runs once a document in Arrow batches. Everything
after it (domains, row iteration, unpivoting) is DataFrame expressions partitioned by document and table.
"""

from __future__ import annotations

import re
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADINGS = {f"h{i}" for i in range(1, 7)}
#: Elements that hold other blocks and are no items themselves; what text they hold loosely is an item.
CONTAINERS = {"html", "body", "article", "section", "main", "header", "footer", "nav", "div", "ul", "ol", "dl", "head", "aside", "figure", "form", "thead", "tbody", "tfoot"}
BLOCKS = {"p", "li", "dt", "dd", "blockquote", "pre", "address", "figcaption", "caption"} | HEADINGS
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "title", "template"}


class _Items(HTMLParser):
    """Items: dicts of type (heading, text, table), html, heading (number of the last heading item), cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] | None = None
        self.kind = ""
        self.open: list[str] = []  # inline elements within the open item
        self.hidden = 0
        self.heading: int | None = None
        self.tables: list[dict] = []

    def finish(self) -> None:
        if self.buffer is None:
            return
        self.buffer += [f"</{t}>" for t in reversed(self.open)]
        text = "".join(self.buffer).replace("\n", "").replace("\r", "").strip()
        kind, self.buffer, self.open = self.kind, None, []
        if kind in ("th", "td"):
            self.tables[-1]["cells"][-1]["html"] = text
        elif text or kind in HEADINGS:
            self.items.append({"type": "heading" if kind in HEADINGS else "text", "html": text, "heading": self.heading, "cells": None})
            if kind in HEADINGS:
                self.heading = len(self.items) - 1

    def begin(self, kind: str) -> None:
        self.finish()
        self.kind, self.buffer, self.open = kind, [], []

    def handle_starttag(self, tag, attrs):
        if self.hidden or tag in HIDDEN:
            self.hidden += tag in HIDDEN
            return
        if tag == "table":
            self.finish()
            self.tables.append({"type": "table", "html": "", "heading": self.heading, "cells": [], "y": -1})
        elif tag == "tr" and self.tables:
            self.finish()
            self.tables[-1]["y"] += 1
        elif tag in ("th", "td") and self.tables:
            self.begin(tag)
            table, found = self.tables[-1], dict(attrs)
            table["y"] = max(table["y"], 0)
            # The HTML standard clamps spans to these limits.
            span = lambda k, most: min(max(1, int(found[k])), most) if (found.get(k) or "").strip().isdigit() else 1
            table["cells"].append({"y": table["y"], "colspan": span("colspan", 1000), "rowspan": span("rowspan", 65534), "head": tag == "th", "html": ""})
        elif self.buffer is not None and self.kind in ("th", "td") and tag != "span":
            self._inline(tag)
        elif tag in BLOCKS:
            self.begin(tag)
        elif tag in CONTAINERS:
            self.finish()
        elif self.buffer is not None and tag != "span":
            self._inline(tag)
        elif tag not in VOID and tag != "span":
            self.begin(tag)

    def _inline(self, tag):
        if tag in VOID:
            self.buffer.append(f"<{tag}>")
        else:
            self.buffer.append(f"<{tag}>")
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == "table" and self.tables:
            self.finish()
            table = self.tables.pop()
            self._table(table)
        elif tag == "tr" or tag in CONTAINERS:
            if not (self.kind in ("th", "td") and self.buffer is not None and tag != "tr"):
                self.finish()
        elif self.buffer is not None and tag in self.open:
            while True:
                last = self.open.pop()
                self.buffer.append(f"</{last}>")
                if last == tag:
                    break
        elif self.buffer is not None and tag == self.kind:
            self.finish()

    def _table(self, table):
        cells = table["cells"]
        if cells and not (len(cells) == 1 and cells[0]["html"] == "(omitted)"):
            self.items.append({k: table[k] for k in ("type", "html", "heading", "cells")})

    def handle_data(self, data):
        if self.hidden:
            return
        if self.buffer is None:
            if not data.strip():
                return
            self.begin("#text")
        self.buffer.append(escape(data, quote=False))

    def close(self):
        super().close()
        self.finish()
        while self.tables:
            self._table(self.tables.pop())


#: An ampersand, with the character reference that it begins if that ends with a semicolon.
_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);|([A-Za-z][A-Za-z0-9]*;))?")


def _kept_open(html: str) -> str:
    """html with the ampersands that begin no whole, known reference escaped, so that they are read as they stand."""
    return _REFERENCE.sub(lambda m: m[0] if (m[1] in html5 if m[1] else len(m[0]) > 1) else f"&amp;{m[0][1:]}", html)


def parse(html: str | None, terminated: bool = False) -> list[dict]:
    """The items of a text. The HTML standard also reads some references without their semicolon (`&amp` at the end of a
    text that was cut off); with terminated these stay as they stand."""
    parser = _Items()
    parser.feed(_kept_open(html or "") if terminated else html or "")
    parser.close()
    return parser.items


def dense_grid(cells: list[dict]) -> tuple[list[list[int | None]], int]:
    """Numbers of the cells that cover each place of the table, and the number of header rows.

    The first row's spans give the width. Each column remembers the row down to which it is taken; a cell goes to the
    first column of its row that is free, or, in a full row, on the last cell's place, clipped to the grid.
    """
    width = sum(c["colspan"] for c in cells if c["y"] == cells[0]["y"])
    height = max(c["y"] + c["rowspan"] for c in cells)
    grid: list[list[int | None]] = [[None] * width for _ in range(height)]
    taken, left = [0] * width, 0
    for number, cell in enumerate(cells):
        top, bottom = cell["y"], min(height, cell["y"] + cell["rowspan"])
        left = next((x for x, until in enumerate(taken) if until <= top), left)
        columns = slice(left, left + cell["colspan"])
        for row in grid[top:bottom]:
            row[columns] = [number] * len(row[columns])
        taken[columns] = [max(until, bottom) for until in taken[columns]]
    return grid, max((c["y"] + 1 for c in cells if c["head"]), default=0)


def _mapped(df: DataFrame, id_col: str, html_col: str, rows_of, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [row for doc, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in rows_of(doc, html)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    return df.select(F.col(id_col).cast("bigint").alias("doc"), html_col).mapInArrow(run, schema)


def items(df: DataFrame, id_col: str, html_col: str, terminated: bool = False) -> DataFrame:
    """(doc, item, type, html, text, heading): items of each document in order; heading is the item number of the heading
    above. terminated: see parse()."""
    arrow = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("type", pa.string()), ("html", pa.string()), ("heading", pa.int64())])

    def rows(doc, html):
        for k, x in enumerate(parse(html, terminated)):
            yield doc, k, x["type"], x["html"], x["heading"]

    found = _mapped(df, id_col, html_col, rows, "doc bigint, item bigint, type string, html string, heading bigint", arrow)
    return found.withColumn("text", plain(F.col("html")))


def grids(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(doc, tab, y, x, cell, head, hrows, html): every place of every table."""
    arrow = pa.schema([("doc", pa.int64()), ("tab", pa.int64()), ("y", pa.int64()), ("x", pa.int64()), ("cell", pa.int64()), ("head", pa.bool_()), ("hrows", pa.int64()), ("html", pa.string())])

    def rows(doc, html):
        for t, table in enumerate(i for i in parse(html) if i["type"] == "table"):
            grid, hrows = dense_grid(table["cells"])
            for y, line in enumerate(grid):
                for x, k in enumerate(line):
                    if k is not None:
                        yield doc, t, y, x, k, table["cells"][k]["head"], hrows, table["cells"][k]["html"]

    return _mapped(df, id_col, html_col, rows, "doc bigint, tab bigint, y bigint, x bigint, cell bigint, head boolean, hrows bigint, html string", arrow)


def plain(html: Column) -> Column:
    """Text of an item: tags out, the escapes that the parser writes undone."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def domains_x(grid: DataFrame) -> DataFrame:
    """(doc, tab, x, domain): the header texts above each column, joined by colons; a spanning cell counts once."""
    w = Window.partitionBy("doc", "tab", "x").orderBy("y")
    head = grid.where("y < hrows").withColumn("prev", F.lag("cell").over(w)).where("prev is null or prev <> cell")
    named = head.groupBy("doc", "tab", "x").agg(F.sort_array(F.collect_list(F.struct("y", F.replace(plain(F.col("html")), F.lit(":"), F.lit("")).alias("n")))).alias("p"))
    columns = grid.select("doc", "tab", "x").distinct().join(named, ["doc", "tab", "x"], "left")
    return columns.select("doc", "tab", "x", F.coalesce(F.array_join(F.transform("p", lambda s: s["n"]), ":"), F.lit("")).alias("domain"))


def domains_y(grid: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, tab, y, domain): the texts of the key columns (doc, tab, x) of each data row, joined by colons."""
    w = Window.partitionBy("doc", "tab", "y").orderBy("x")
    rows = grid.where("y >= hrows").join(keys.select("doc", "tab", "x").distinct(), ["doc", "tab", "x"], "left_semi")
    rows = rows.withColumn("prev", F.lag("cell").over(w)).where("prev is null or prev <> cell")
    return rows.groupBy("doc", "tab", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", F.replace(plain(F.col("html")), F.lit(":"), F.lit("")).alias("n")))), lambda s: s["n"]), ":").alias("domain"))


def matching(domains: DataFrame, pattern: str) -> DataFrame:
    """Domains that the pattern is found in, ignoring case."""
    return domains.where(F.col("domain").rlike(f"(?i){pattern}"))


def cell_rows(grid: DataFrame, pattern: str = "") -> DataFrame:
    """(doc, tab, y, cells): for each data row a map from domain to the texts of its cells in column order."""
    own = matching(domains_x(grid), pattern)
    cells = grid.where("y >= hrows").join(own, ["doc", "tab", "x"]).groupBy("doc", "tab", "y", "domain").agg(F.sort_array(F.collect_list(F.struct("x", "cell", plain(F.col("html")).alias("t")))).alias("c"))
    cells = cells.withColumn("c", F.transform(F.filter("c", lambda s, i: (i == 0) | (F.get(F.col("c"), i - 1)["cell"] != s["cell"])), lambda s: s["t"]))
    return cells.groupBy("doc", "tab", "y").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "c")))).alias("cells"))


def unpivoted(grid: DataFrame, row_pattern: str, column_pattern: str) -> DataFrame:
    """(doc, tab, row, column, text): the cells where row keys (columns matching row_pattern) meet column domains."""
    x = domains_x(grid)
    y = domains_y(grid, matching(x, row_pattern)).withColumnRenamed("domain", "row")
    cols = matching(x, column_pattern).withColumnRenamed("domain", "column")
    met = grid.where("y >= hrows").join(y, ["doc", "tab", "y"]).join(cols, ["doc", "tab", "x"])
    return met.select("doc", "tab", "row", "column", "cell", plain(F.col("html")).alias("text")).distinct()


def plain_text(html: str) -> str:
    """plain() for one string."""
    text = re.sub("<[^>]*>", "", html)
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def heading_texts(found: DataFrame, pattern: str = "", text_pattern: str = "") -> DataFrame:
    """(doc, heading, title, texts): consecutive texts below each heading; texts above any heading stand under `-1`."""
    texts = found.where("type = 'text'").where(F.col("text").rlike(f"(?i){text_pattern}"))
    heads = found.where("type = 'heading'").select("doc", F.col("item").alias("heading"), F.col("text").alias("title"))
    grouped = texts.groupBy("doc", "heading").agg(F.transform(F.sort_array(F.collect_list(F.struct("item", "text"))), lambda s: s["text"]).alias("texts"))
    return grouped.join(heads, ["doc", "heading"], "left").withColumn("title", F.coalesce("title", F.lit("-1"))).where(F.col("title").rlike(f"(?i){pattern}"))


def tables(found: DataFrame, pattern: str) -> DataFrame:
    """Items that are tables whose caption (the caption item before them) matches, with it as column caption."""
    w = Window.partitionBy("doc").orderBy("item")
    before = F.lag(F.when(F.col("type").isin("caption", "text"), F.col("text"))).over(w)
    return found.withColumn("caption", before).where("type = 'table'").where(F.coalesce(F.col("caption"), F.lit("")).rlike(f"(?i){pattern}"))


def only(found: DataFrame, docs: DataFrame, doc: str, exempt: Column | None = None) -> DataFrame:
    """The rows of found, which fails at run time if a document has not exactly one; documents for which exempt holds may
    have none. docs: (doc, and what exempt reads)."""
    counted = docs.join(found.groupBy(F.col(doc)).agg(F.count(F.lit(1)).alias("_n")), doc, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    fine = (F.col("_n") == 1) | (F.coalesce(exempt, F.lit(False)) & (F.col("_n") == 0) if exempt is not None else F.lit(False))
    checked = F.assert_true(fine, F.concat(F.lit("not exactly one for "), F.col(doc).cast("string")))
    return found.join(counted.where(checked.isNull()).select(doc), doc, "left_semi")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc, version, chapter, number, html): HTML files in folders NAME-vVERSION."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    own = F.regexp_extract(at, r"/([^/]+)-v([^/]+)/([^/]+)\.html$", 1)
    stem = F.regexp_extract(at, r"/([^/]+)\.html$", 1)
    rows = files.select(own.alias("name"), F.regexp_extract(at, r"-v([^/]+)/[^/]+\.html$", 1).alias("version"), F.replace(stem, F.lit("_"), F.lit(" ")).alias("chapter"), F.regexp_extract(stem, r"^chapter_(\d+)", 1).cast("int").alias("number"), F.col("value").alias("html"))
    return rows.where("name <> ''")


def unescaped(text: str) -> str:
    return unescape(text)
