"""Tables as cell rows (y, x, rowspan, colspan, head, text): merging parts below and beside each other, and virtual tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import ordered, running_key, runs

#: Rows of a batch that a fold over many tables gives, at least.
ROWS = 10_000
CELL = "y int, x int, rowspan int, colspan int, head boolean, text string"


def _starts(part: list[dict]) -> list[int]:
    """Columns where header cells begin, and the table's width as the last."""
    return [*sorted({0, *(c["x"] for c in part if c["head"])}), max(c["x"] + c["colspan"] for c in part)]


def _moved(cells: list[dict], old: list[int], new: list[int]) -> list[dict]:
    """Cells on new column groups; a cell that reaches its group's end reaches the new end."""
    if old == new:
        return cells

    def place(x: int, end: bool) -> int:
        k = max(i for i, s in enumerate(old) if s < x or (s == x and not end))
        return new[k + 1] if end and x == old[k + 1] else new[k] + x - old[k]

    return [c | {"x": (left := place(c["x"], False)), "colspan": place(c["x"] + c["colspan"], True) - left} for c in cells]


def appended_below(cells: DataFrame, keys: list[str], part: str, headers: bool = True) -> DataFrame:
    """The parts of each table (keys) below each other: (keys, table, y, x, ...); table counts what could not be joined.

    Headers of later parts go. Parts may be cut into columns differently: the groups of columns that begin with a header
    cell are matched in order, each gets the width of the wider one, and a cell that reaches its group's end reaches the
    widened end. A part with another number of groups begins a new table. headers=False: parts are only put below.
    One table is held at a time; many small ones share a batch.
    """
    types = dict(cells.dtypes)
    names = [c.split(" ")[0] for c in CELL.split(", ")]

    def fold(group: list[dict]) -> list[dict]:
        parts: dict = {}
        for c in sorted(group, key=lambda c: (c[part], c["y"], c["x"])):
            parts.setdefault(c[part], []).append(c)
        done: list[list[dict]] = []
        starts: list[int] = []
        for one in parts.values():
            own = _starts(one)
            if not done or headers and len(own) != len(starts):
                done.append(one)
                starts = own
                continue
            if headers:
                widths = [max(b - a, d - c) for a, b, c, d in zip(starts, starts[1:], own, own[1:])]
                new = [sum(widths[:k]) for k in range(len(widths) + 1)]
                done[-1] = _moved(done[-1], starts, new)
                one, starts = _moved([c for c in one if not c["head"]], own, new), new
            if one:
                down = max(c["y"] + c["rowspan"] for c in done[-1]) - min(c["y"] for c in one)
                done[-1] = done[-1] + [c | {"y": c["y"] + down} for c in one]
        return [c | {"table": k} for k, cs in enumerate(done) for c in cs]

    def run(batches):
        group, at, out, schema = [], None, [], None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(k) for k in keys), pa.field("table", pa.int32()), *(batch.schema.field(n) for n in names)])
            for c in batch.to_pylist():
                own = [None if c[k] is None else ("nan" if c[k] != c[k] else c[k],) for k in keys]
                if group and own != at:
                    out += fold(group)
                    group = []
                at = own
                group.append(c)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if group:
            yield pa.RecordBatch.from_pylist(out + fold(group), schema=schema)

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "table int", CELL])
    wanted = cells.select(*dict.fromkeys([*keys, part, *names]))
    return wanted.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def appended_beside(cells: DataFrame, keys: list[str], part: str) -> DataFrame:
    """The parts of each table beside each other; the last row of a lower part is stretched to the table's height."""
    size = cells.groupBy(*keys, part).agg(F.max(F.col("x") + F.col("colspan")).alias("_w"), F.max(F.col("y") + F.col("rowspan")).alias("_h"))
    before = F.sum("_w").over(ordered(keys, part).rowsBetween(Window.unboundedPreceding, -1))
    size = size.withColumns({"_x": F.coalesce(before, F.lit(0)), "_all": F.max("_h").over(Window.partitionBy(*keys))})
    rows = cells.join(size, [*keys, part])
    last = F.col("y") + F.col("rowspan") == F.col("_h")
    rows = rows.withColumns({"x": (F.col("x") + F.col("_x")).cast("int"), "rowspan": (F.col("rowspan") + F.when(last, F.col("_all") - F.col("_h")).otherwise(0)).cast("int")})
    return rows.drop("_w", "_h", "_x", "_all")


def table_groups(nodes: DataFrame, keys: list[str], order: str, carry: bool = True) -> DataFrame:
    """Table nodes (name, type, number) with the group of parts they belong to: (..., group, part).

    Content tables of one number are one group wherever they stand; with carry, a table without a number (0) belongs to
    the last number while nothing but tables stands between. Register tables, and bit tables, are grouped while they follow each other.
    """
    is_table = F.col("name") == "table"
    staged = runs(nodes.withColumn("_t", is_table), keys, [order], "_t", out="_run")
    staged = runs(staged.withColumn("_kind", F.when(is_table, F.col("type")).otherwise(F.col("name"))), keys, [order], "_kind", out="_same")
    numbered = F.when((F.col("type") == "table") & (F.col("number") > 0), F.col("number"))
    own = F.coalesce(numbered, running_key(numbered, ordered([*keys, "_run"], order))) if carry else numbered
    name = lambda kind, value: F.concat(kind, F.lit(":"), value.cast("string"))
    group = F.when(F.col("type") != "table", name(F.col("type"), F.col("_same"))).when(own.isNotNull(), name(F.lit("number"), own)).otherwise(name(F.lit("alone"), F.col(order)))
    found = staged.withColumn("group", group).where(is_table).drop("_t", "_run", "_kind", "_same")
    return found.withColumn("part", F.row_number().over(ordered([*keys, "group"], order)) - 1)


def bit_tables(nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Bit descriptions that follow each other on a page as tables of two columns: (keys, table, y, x, rowspan, colspan, head, text).

    nodes: (keys, order, name, page, bits, description)."""
    own = runs(nodes.withColumn("_on", F.concat_ws(":", "name", "page")), keys, [order], "_on", out="table").where("name = 'bit'")
    rows = own.withColumn("y", F.row_number().over(ordered([*keys, "table"], order)) - 1)
    both = rows.select(*keys, "table", "y", F.posexplode(F.array("bits", "description")).alias("x", "text"))
    return both.select(*keys, F.col("table").cast("int").alias("table"), "y", "x", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(False).alias("head"), "text")


def as_html(cells: DataFrame, keys: list[str], caption: Column | None = None) -> DataFrame:
    """(keys, html): the table as HTML, spans and header cells kept, texts escaped; a row without cells of its own stays."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    span = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f" {name}="), F.col(name).cast("string"))).otherwise("")
    tag = F.when(F.col("head"), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, span("rowspan"), span("colspan"), F.lit(">"), F.coalesce(escaped, F.lit("")), F.lit("</"), tag, F.lit(">"))
    lines = cells.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x", cell.alias("c")))).alias("c"), F.max(F.col("y") + F.col("rowspan")).alias("h"))
    lines = lines.withColumn("line", F.concat(F.lit("<tr>"), F.array_join(F.transform("c", lambda s: s["c"]), ""), F.lit("</tr>")))
    table = lines.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("m"), F.max("h").alias("h"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.coalesce(F.element_at("m", y), F.lit("<tr></tr>"))), "")
    head = F.lit("") if caption is None else F.coalesce(F.concat(F.lit("<caption>"), caption, F.lit("</caption>")), F.lit(""))
    return table.select(*keys, F.concat(F.lit("<table>"), head, body, F.lit("</table>")).alias("html"))


def as_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): a line a row, cells between bars; for looking at."""
    lines = cells.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x", F.coalesce("text", F.lit("")).alias("t")))).alias("c"))
    lines = lines.withColumn("line", F.concat(F.lit("| "), F.array_join(F.transform("c", lambda s: s["t"]), " | "), F.lit(" |")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "line"))), lambda s: s["line"]), "\n").alias("text"))
