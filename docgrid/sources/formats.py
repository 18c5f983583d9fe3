"""Folders of HTML documents and of C headers as data sources: spark.read.format("htmlpages"), ("cheader").

    formats.register(spark)
    spark.read.format("htmlpages").load("/data/html").where("document = 'DS1' and kind = 'heading'")
    spark.readStream.format("cheader").load("/data/headers")
    pages.write.format("htmlpages").mode("append").save("/data/html")

Files are dealt to partitions by their sizes (option partitionBytes). Filters on document, version and chapter choose files
by their names, so that the others are never opened; filters on kind leave out what is not asked for before it becomes
rows. As streams, files come in the order of their times; a file is taken once it is `settle` seconds old, so that none
that is written at the same moment is passed over. Paths must be in a file system that all executors have mounted.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .html import parse, plain_text

PARTITION_BYTES = 16 << 20
ROWS = 4096


def local_path(path: str) -> str:
    """The path of a mounted file system; others raise ValueError."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: this source reads mounted file systems only")
    return unquote(parts.path) if parts.scheme else path


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def dealt(files: list[tuple[int, str]], most: int) -> list[Files]:
    """Files (size, path) in partitions of about so many bytes, the largest first."""
    out, run, size = [], [], 0
    for n, path in sorted(files, reverse=True):
        if run and size + n > most:
            out.append(Files(tuple(run)))
            run, size = [], 0
        run.append(path)
        size += n
    return [*out, Files(tuple(run))] if run else out


class _Parser:
    """What the batch and the stream reader share. names: columns told by a file's name; kinds: what its rows may be."""

    suffix, columns = "", ""

    def __init__(self, options: dict):
        self.root = local_path(options["path"])
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.settle = float(options.get("settle", 1.0))
        self.wanted: dict[str, set] = {}

    def named(self, path: str) -> dict | None:
        raise NotImplementedError

    def rows(self, path: str, names: dict, text: str) -> Iterator[tuple]:
        raise NotImplementedError

    def asks(self, column: str, value) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def found(self) -> list[tuple[int, int, str]]:
        """(time, size, path) of the files whose names the filters allow."""
        out = []
        for folder, _, names in os.walk(self.root):
            for path in (f"{folder}/{n}" for n in names if n.endswith(self.suffix)):
                told = self.named(path)
                if told is not None and all(self.asks(c, v) for c, v in told.items()):
                    at = os.stat(path)
                    out.append((at.st_mtime_ns, at.st_size, path))
        return out

    def take(self, filters: list[Filter], names: set[str]) -> Iterator[Filter]:
        """Keep the filters that are applied here; the others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in names:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def batches(self, paths: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64()}[t]) for n, t in (c.split(" ") for c in self.columns.split(", "))])
        held: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
        for path in paths:
            with open(path, encoding="utf-8", errors="replace") as file:
                text = file.read()
            for row in self.rows(path, self.named(path), text):
                held.append(row)
                if len(held) >= ROWS:
                    yield batch()
                    held = []
        if held:
            yield batch()


class HtmlParser(_Parser):
    """NAME-vVERSION/CHAPTER.html; kind is heading, text, caption or table. Option terminated: see html.parse()."""

    suffix, columns = ".html", "document string, version string, chapter string, item bigint, kind string, html string, text string, heading bigint"
    names = {"document", "version", "chapter"}

    def __init__(self, options):
        super().__init__(options)
        self.terminated = str(options.get("terminated", "false")).lower() == "true"

    def named(self, path):
        m = re.search(r"/([^/]+)-v([^/]+)/([^/]+)\.html$", path)
        return {"document": m[1], "version": m[2], "chapter": m[3].replace("_", " ")} if m else None

    def rows(self, path, names, text):
        for k, item in enumerate(parse(text, self.terminated)):
            if self.asks("kind", item["type"]):
                yield *names.values(), k, item["type"], item["html"], plain_text(item["html"]), item["heading"]


class HeaderParser(_Parser):
    """NAME.h; kind is define (owner is null) or member (of the structure owner, value its type, count 0 unless an array)."""

    suffix, columns = ".h", "document string, kind string, owner string, ord bigint, name string, value string, count bigint"
    names = {"document"}
    quiet = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
    define = re.compile(r"^[ \t]*#[ \t]*define[ \t]+(\w+)[ \t]+(\S[^\n]*)$", re.M)
    struct = re.compile(r"typedef\s+struct\s*\w*\s*\{([^{}]*)\}\s*(\w+)\s*;")
    noise = re.compile(r"\b(__IOM?|__I|__O|volatile|const|struct)\b")
    member = re.compile(r"(\w+) (\w+)(?: ?\[ ?(0[xX][0-9a-fA-F]+|\d+) ?\])?")

    def named(self, path):
        return {"document": os.path.basename(path)[:-2]}

    def rows(self, path, names, text):
        text, doc = re.sub(r"\\\r?\n", " ", self.quiet.sub("", text)), names["document"]
        if self.asks("kind", "define"):
            for k, m in enumerate(self.define.finditer(text)):
                yield doc, "define", None, k, m[1], m[2].strip(), None
        if self.asks("kind", "member"):
            for s in self.struct.finditer(text):
                lines = [" ".join(self.noise.sub(" ", x).split()) for x in s[1].split(";")]
                for k, m in enumerate(self.member.fullmatch(x) for x in lines if x):
                    if m:
                        yield doc, "member", s[2], k, m[2], m[1], int(m[3], 16 if m[3][:2] in ("0x", "0X") else 10) if m[3] else 0


class _Reader(DataSourceReader):
    def __init__(self, parser: _Parser):
        self.parser = parser

    def pushFilters(self, filters):  # noqa: N802
        return self.parser.take(filters, self.parser.names | {"kind"})

    def partitions(self):
        return dealt([(size, path) for _, size, path in self.parser.found()], self.parser.most)

    def read(self, partition):
        return self.parser.batches(partition.paths) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time and path of the last file taken."""

    def __init__(self, parser: _Parser):
        self.parser = parser

    def initialOffset(self):  # noqa: N802
        return {"time": 0, "path": ""}

    def latestOffset(self):  # noqa: N802
        settled = time.time_ns() - int(self.parser.settle * 1e9)
        at, path = max([(t, p) for t, _, p in self.parser.found() if t <= settled], default=(0, ""))
        return {"time": at, "path": path}

    def partitions(self, start, end):
        after, until = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([(size, p) for t, size, p in self.parser.found() if after < (t, p) <= until], self.parser.most)

    def read(self, partition):
        return self.parser.batches(partition.paths)

    def commit(self, end):
        pass


class _HtmlWriter(DataSourceWriter):
    """Rows (document, version, chapter, html) as files; each appears under its name when it is whole."""

    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns = root, columns

    def write(self, iterator):
        for row in iterator:
            r = {c: row[c] for c in self.columns}
            folder = f"{self.root}/{r['document']}-v{r['version']}"
            os.makedirs(folder, exist_ok=True)
            path = f"{folder}/{r['chapter'].replace(' ', '_')}.html"
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as file:
                file.write(r["html"] or "")
            os.replace(part, path)  # a task that runs again writes the same
        return WriterCommitMessage()


class HtmlPages(DataSource):
    @classmethod
    def name(cls):
        return "htmlpages"

    def schema(self):
        return HtmlParser.columns

    def reader(self, schema):
        return _Reader(HtmlParser(self.options))

    def streamReader(self, schema):  # noqa: N802
        return _StreamReader(HtmlParser(self.options))

    def writer(self, schema, overwrite):
        if overwrite or not {"document", "version", "chapter", "html"} <= set(schema.names):
            raise ValueError("htmlpages: rows of (document, version, chapter, html) can be appended")
        return _HtmlWriter(local_path(self.options["path"]), ["document", "version", "chapter", "html"])


class CHeader(DataSource):
    @classmethod
    def name(cls):
        return "cheader"

    def schema(self):
        return HeaderParser.columns

    def reader(self, schema):
        return _Reader(HeaderParser(self.options))

    def streamReader(self, schema):  # noqa: N802
        return _StreamReader(HeaderParser(self.options))


def register(spark: SparkSession) -> None:
    """Make the sources known to the session and let Spark push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (HtmlPages, CHeader):
        spark.dataSource.register(source)
