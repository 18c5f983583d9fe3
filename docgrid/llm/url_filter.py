"""URL filters: rules by host and path first, then a sorted digest array.

The array is one file: the sorted 64-bit xxhash digests of the listed strings, their offsets, and the strings
themselves. Spark ships the file to every executor, whose workers memory-map it, probe a whole batch with one binary
search, and compare the stored full string on every hit, so a colliding digest never blocks a page.

Listed strings are hosts (which cover their subdomains) or a host followed by a path (which covers that page alone).
A file holds at most MAX_ENTRIES strings; a longer list becomes several files of successive digests, and all are probed.

Defined results: a null url, or one without `://`, has an empty host and path and is allowed; an empty table gives
no rows; repeated rows are each judged; other columns are not read.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings in one file: at about 40 bytes a string, under 2.5 GB.
MAX_ENTRIES = 50_000_000
#: (verdict, host, path): the longest rule that fits a url decides.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Hosts listed for the query: each name below each public suffix of the test pages.
BLOCKED = [f"{name}.example.{suffix}" for name in ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets") for suffix in ("com", "net", "org")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as `host/path` and its verdict; nulls if none fits."""
    name = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


class DigestArray:
    """A read-only set of strings in one memory-mapped file."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, dtype=np.uint64, count=1)[0])
        self.digests = np.memmap(path, dtype=np.uint64, mode="r", offset=8, shape=(n,)) if n else np.zeros(0, np.uint64)
        self.offsets = np.memmap(path, dtype=np.uint64, mode="r", offset=8 + 8 * n, shape=(n + 1,))
        end = int(self.offsets[-1])
        self.strings = np.memmap(path, dtype=np.uint8, mode="r", offset=16 + 16 * n, shape=(end,)) if end else np.zeros(0, np.uint8)

    @staticmethod
    def build(strings: Iterable[str], path: str, digest=xxhash.xxh64_intdigest) -> list[str]:
        """Write the array, in files of at most MAX_ENTRIES strings; returns their paths (one at least)."""
        found = sorted((digest(s), s) for s in {x.encode() for x in strings})
        paths = []
        for part, at in enumerate(range(0, max(1, len(found)), MAX_ENTRIES)):
            own = found[at : at + MAX_ENTRIES]
            paths.append(f"{path}.{part}" if part else path)
            offsets = np.cumsum([0, *(len(s) for _, s in own)], dtype=np.uint64)
            with open(paths[-1], "wb") as out:
                out.write(np.array([len(own)], np.uint64).tobytes() + np.array([d for d, _ in own], np.uint64).tobytes() + offsets.tobytes() + b"".join(s for _, s in own))
        return paths

    def contains(self, keys: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        probes = np.fromiter(map(digest, keys), dtype=np.uint64, count=len(keys))
        at = np.searchsorted(self.digests, probes)
        out = np.zeros(len(keys), bool)
        inside = np.flatnonzero(at < len(self.digests))
        for i in inside[self.digests[at[inside]] == probes[inside]]:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == probes[i]:  # equal digests stand together
                if self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == keys[i]:
                    out[i] = True
                    break
                j += 1
        return out


def covering(host: str, path: str) -> list[bytes]:
    """The strings that would block a url if they were listed: its host, each parent domain, and host plus path."""
    labels = host.split(".")
    keys = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [k.encode() for k in ([*keys, host + path] if path else keys)]


def shipped(spark: SparkSession, strings: Iterable[str]) -> list[str]:
    """Build the array on the driver and hand it to all executors; returns the files' names."""
    folder = tempfile.mkdtemp()  # executors fetch the files from here for as long as the driver runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    paths = DigestArray.build(strings, os.path.join(folder, f"urls-{uuid.uuid4().hex}.digests"))
    for path in paths:
        spark.sparkContext.addFile(path)
    return [os.path.basename(path) for path in paths]


def blocked(df: DataFrame, array: list[str], host: str = "host", path: str = "path", out: str = "listed") -> DataFrame:
    """df with a boolean column: whether the array lists the host, a domain above it, or the page."""
    names = df.columns

    def probe(batches):
        listed = [DigestArray(SparkFiles.get(name)) for name in array]
        for batch in batches:
            hosts, paths = batch.column(names.index(host)).to_pylist(), batch.column(names.index(path)).to_pylist()
            keys, owner = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                found = covering(h or "", p or "")
                keys += found
                owner += [i] * len(found)
            hit = np.zeros(len(hosts), bool)
            for one in listed:
                hit[np.asarray(owner, dtype=np.int64)[one.contains(keys)]] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*names, out])

    return df.mapInArrow(probe, T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())]))


def judged(pages: DataFrame, array: list[str], rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    return blocked(rows, array).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by RULES and, where no rule fits, by the digest array of BLOCKED hosts."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), shipped(spark, BLOCKED))


def _sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    names = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    says = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)
    listed = " OR ".join(f"host = '{b}' OR ends_with(host, '.{b}')" for b in BLOCKED)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, CASE {names} END AS rule, CASE {says} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM cut"""


SQL = _sql()
