"""C headers: defines, enumerators, pointers and structures, by regular expressions over whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import evaluate_uint64


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) without comments and with continued lines joined."""
    text = F.regexp_replace(F.regexp_replace("value", r"(?s)/\*.*?\*/|//[^\n]*", ""), r"\\\r?\n", " ")
    return spark.read.option("pathGlobFilter", "*.h").text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("file"), text.alias("text"))


def defines(files: DataFrame) -> DataFrame:
    """(file, name, value): object-like macros."""
    lines = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*#[ \t]*define[ \t]+(\w+[ \t]+\S[^\n]*)$"), F.lit(1))).alias("d"))
    return lines.select("file", F.regexp_extract("d", r"^(\w+)", 1).alias("name"), F.trim(F.regexp_replace("d", r"^\w+", "")).alias("value"))


def structures(files: DataFrame) -> DataFrame:
    """(file, type, ord, member_type, name, count): members of `typedef struct { ... } NAME;`; count is 0 for single members."""
    body = r"(typedef\s+struct\s*\w*\s*\{[^{}]*\}\s*\w+\s*;)"
    found = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(body), F.lit(1))).alias("s"))
    lines = F.filter(F.transform(F.split(F.regexp_extract("s", r"\{([^{}]*)\}", 1), ";"), lambda m: F.trim(F.regexp_replace(F.regexp_replace(m, r"\b(__IOM?|__I|__O|volatile|const|struct)\b", " "), r"\s+", " "))), lambda m: m != "")
    rows = found.select("file", F.regexp_extract("s", r"\}\s*(\w+)\s*;", 1).alias("type"), F.posexplode(lines).alias("ord", "m"))
    pattern = r"^(\w+) (\w+)(?: ?\[ ?(\w+) ?\])?$"
    size = F.regexp_extract("m", pattern, 3)
    count = F.when(size.rlike("^0[xX]"), F.conv(F.substring(size, F.lit(3), F.length(size)), 16, 10)).when(size == "", "0").otherwise(size)
    return rows.where(F.col("m").rlike(pattern)).select("file", "type", "ord", F.regexp_extract("m", pattern, 1).alias("member_type"), F.regexp_extract("m", pattern, 2).alias("name"), count.try_cast("int").alias("count"))


def conditionals(text: Column, prefix: str) -> Column:
    """Names tested by `defined(...)` that begin with the prefix."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"defined\s*\(?\s*({prefix}\w*)"), F.lit(1)))


def enumerators(files: DataFrame) -> DataFrame:
    """(file, name, value): interrupt enumerators."""
    found = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+_IRQn\s*=\s*-?\d+)"), F.lit(1))).alias("e"))
    return found.select("file", F.regexp_extract("e", r"^(\w+)_IRQn", 1).alias("name"), F.regexp_extract("e", r"(-?\d+)$", 1).cast("int").alias("value"))


def pointers(files: DataFrame) -> DataFrame:
    """(file, name, type, base): `#define NAME ((TYPE *) BASE)`."""
    pattern = r"^\(\s*\(\s*(\w+)\s*\*\s*\)\s*(\w+)\s*\)$"
    d = defines(files).where(F.col("value").rlike(pattern))
    return d.select("file", "name", F.regexp_extract("value", pattern, 1).alias("type"), F.regexp_extract("value", pattern, 2).alias("base"))


def values(macros: DataFrame) -> DataFrame:
    """(file, name, number): macros that are constant expressions, as unsigned 64-bit numbers, evaluated with the file's
    other macros. One file is one group."""
    from decimal import Decimal

    import pandas as pd

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        names = dict(zip(p.name, p.value))
        out = []
        for name, text in names.items():
            try:
                out.append((p.file.iloc[0], name, Decimal(evaluate_uint64(text, names))))
            except (ValueError, ZeroDivisionError):
                continue
        return pd.DataFrame(out, columns=["file", "name", "number"])

    return macros.groupBy("file").applyInPandas(fold, "file string, name string, number decimal(20,0)")
