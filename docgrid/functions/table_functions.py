"""Table functions for SQL whose columns depend on their arguments.

    table_functions.register(spark)
    SELECT page_id, v.* FROM pages, LATERAL rule_values(html, 'title = <h1>(.*?)</h1>; lang = lang="(\\w+)"') v
    SELECT page_id, r.* FROM pages, LATERAL html_rows(html, 'name = Pin.*; type = Type', 'pin definition') r
    SELECT * FROM grid_rows(TABLE(cells), 'name, type, alternate')

Names and patterns are constants, so the columns are known when a query is analysed; an argument that is none, or that
cannot be read, fails there with a message that says so.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

NAME = re.compile(r"[A-Za-z_]\w*")


def constant(argument: AnalyzeArgument, what: str) -> str:
    if argument.isTable or not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError(f"{what} must be a constant string")
    return argument.value


def text(argument: AnalyzeArgument, what: str) -> None:
    if argument.isTable or not isinstance(argument.dataType, (T.StringType, T.NullType)):
        raise ValueError(f"{what} must be a string")


def named_patterns(listed: str) -> dict[str, re.Pattern]:
    """`name = pattern; name = pattern`; semicolons within a pattern are written as \\x3b."""
    found: dict[str, re.Pattern] = {}
    for rule in filter(str.strip, listed.split(";")):
        name, sign, pattern = (x.strip() for x in rule.partition("="))
        if not sign or not NAME.fullmatch(name) or name.lower() in map(str.lower, found):
            raise ValueError(f"not a rule of the form name = pattern with a name of its own: {rule.strip()!r}")
        try:
            found[name] = re.compile(pattern)
        except re.error as e:
            raise ValueError(f"the pattern of {name} cannot be read: {e}") from e
    if not found:
        raise ValueError("no rule is given")
    return found


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


class RuleValues:
    """One row a text with a column for each rule: what its first match has in its first group (all of it, if there is no
    group); an empty string where it does not match, nulls for a null text."""

    @staticmethod
    def analyze(source: AnalyzeArgument, rules: AnalyzeArgument) -> AnalyzeResult:
        text(source, "rule_values: the first argument")
        return AnalyzeResult(_strings(named_patterns(constant(rules, "rule_values: the list of rules"))))

    def __init__(self):
        self.rules = None

    def eval(self, source: str, rules: str):
        self.rules = self.rules or list(named_patterns(rules).values())
        if source is None:
            yield (None,) * len(self.rules)
            return
        found = (r.search(source) for r in self.rules)
        yield tuple("" if m is None else (m[1] or "" if m.re.groups else m[0]) for m in found)


class HtmlRows:
    """The rows of an HTML text's tables, each column under the name of the first rule that its header matches: (tab, y,
    names). caption: the pattern that the caption before a table must match."""

    @staticmethod
    def analyze(html: AnalyzeArgument, columns: AnalyzeArgument, caption: AnalyzeArgument | None = None) -> AnalyzeResult:
        text(html, "html_rows: the first argument")
        names = named_patterns(constant(columns, "html_rows: the list of columns"))
        if clash := {"tab", "y"} & set(names):
            raise ValueError(f"html_rows: columns may not be called {', '.join(sorted(clash))}")
        if caption is not None:
            re.compile(constant(caption, "html_rows: the caption's pattern"))
        return AnalyzeResult(T.StructType([T.StructField("tab", T.IntegerType()), T.StructField("y", T.IntegerType()), *_strings(names)]))

    def eval(self, html: str, columns: str, caption: str = ""):
        from ..sources.html import dense_grid, parse, plain_text

        rules, before, tab = named_patterns(columns), "", 0
        for item in parse(html):
            if item["type"] != "table":
                before = plain_text(item["html"])
                continue
            shown, before = before, ""
            if not item["cells"] or not re.search(caption, shown, re.I):
                continue
            grid, head = dense_grid(item["cells"])
            cell = lambda k: "" if k is None else plain_text(item["cells"][k]["html"])  # noqa: E731, B023
            place = {}
            for x in range(len(grid[0])):
                title = ":".join(dict.fromkeys(cell(line[x]) for line in grid[:head]))
                name = next((n for n, r in rules.items() if n not in place and r.search(title)), None)
                if name:
                    place[name] = x
            for y, line in enumerate(grid[head:]):
                yield (tab, y, *(cell(line[place[n]]) if n in place else None for n in rules))
            tab += 1


class GridRows:
    """Cells (doc, y, x, value) as rows (doc, y, and the given names for the places 0, 1, ... of a row). The function asks
    for cells of one document together and in order, so it holds one row at a time. Where y, x and value are arrays, as
    gathered() makes them, each row of the table has many cells, which spares most of what it costs to hand rows over."""

    @staticmethod
    def analyze(cells: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not cells.isTable:
            raise ValueError("grid_rows: the first argument must be a table")
        types = {f.name: f.dataType for f in cells.dataType.fields}
        if missing := [c for c in ("doc", "y", "x", "value") if c not in types]:
            raise ValueError(f"grid_rows: the table has no column {', '.join(missing)}")
        many = [c for c in ("y", "x", "value") if isinstance(types["y"], T.ArrayType) and not isinstance(types[c], T.ArrayType)]
        if many:
            raise ValueError(f"grid_rows: y is an array, but {', '.join(many)} is not")
        listed = [n.strip() for n in constant(names, "grid_rows: the list of names").split(",")]
        if len(set(listed)) < len(listed) or not all(map(NAME.fullmatch, listed)) or {"doc", "y"} & set(listed):
            raise ValueError(f"grid_rows: not a list of different names: {names.value!r}")
        gathered_ = isinstance(types["y"], T.ArrayType)
        y, value = (types[c].elementType if gathered_ else types[c] for c in ("y", "value"))
        schema = T.StructType([T.StructField("doc", types["doc"]), T.StructField("y", y), *(T.StructField(n, value) for n in listed)])
        if gathered_:
            return AnalyzeResult(schema)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc")], orderBy=[OrderingColumn("y"), OrderingColumn("x")])

    def __init__(self):
        self.at, self.row = None, []

    def _whole(self):
        if self.at is not None:
            yield (*self.at, *self.row)
        self.at = None

    def eval(self, cell, names: str):
        doc, size = cell["doc"], names.count(",") + 1
        if isinstance(cell["y"], list):
            places = zip(cell["y"], cell["x"], cell["value"])
        else:
            places = ((cell["y"], cell["x"], cell["value"]),)
        for y, x, value in places:
            if self.at != (doc, y):
                if self.at is not None:
                    yield (*self.at, *self.row)
                self.at, self.row = (doc, y), [None] * size
            if x is not None and 0 <= x < size:
                self.row[x] = value

    def terminate(self):
        yield from self._whole()


def gathered(cells: DataFrame, rows: int = 256) -> DataFrame:
    """Cells (doc, y, x, value) for grid_rows, up to so many rows of a document as one row: (doc, arrays y, x and value)."""
    cell = F.sort_array(F.collect_list(F.struct("y", "x", "value")))
    blocks = cells.groupBy("doc", F.floor(F.col("y") / rows).alias("_block")).agg(cell.alias("_c"))
    return blocks.select("doc", *(F.col(f"_c.{c}").alias(c) for c in ("y", "x", "value")))


def register(spark: SparkSession) -> None:
    for name, function in (("rule_values", RuleValues), ("html_rows", HtmlRows), ("grid_rows", GridRows)):
        spark.udtf.register(name, udtf(function))
