"""What the operators of this subpackage share: the cluster's shared folder, tables written to it, and word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; bytes.split() uses the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries of a worker's word cache; a full cache is emptied, so memory stays bounded on any corpus.
CACHE_WORDS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode (as in tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docgrid-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docgrid-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, which outlives any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files under a table made by written(); its rows must no longer be needed."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, name)


def removed(spark: SparkSession, name: str) -> None:
    """Delete a folder made by new_path()."""
    if "/docgrid-" in name:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, bounded. strip: characters taken off both ends of a word before hashing."""

    def __init__(self, strip: bytes | None = None):
        super().__init__()
        self.strip = strip

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        plain = word.strip(self.strip) if self.strip else word
        found = self[word] = xxhash.xxh64_intdigest(plain or word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that sums of word hashes become well spread."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; with fewer words, of the whole sequence as one; without words, none."""
    k = len(words)
    if k == 0:
        return words
    width = min(n, k)
    out = np.full(k - width + 1, np.uint64(width))
    for i in range(width):
        out = mixed(out + words[i : k - width + 1 + i])
    return out


def pieces(batches, rows: int = 256) -> Iterator:
    """Arrow batches in slices, so that only so many rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bytes of text that are hashed at a time.
PORTION = 1 << 20
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_PLACES = np.random.Generator(np.random.PCG64(17)).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the texts, words of each text). A multilinear hash of a word's bytes, made for all words
    at once, so nothing is remembered from text to text."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    held = np.flatnonzero(~_SPACE[data])
    if not len(held):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begins = np.flatnonzero(np.diff(held, prepend=-2) > 1)
    lens = np.diff(begins, append=len(held))
    place = np.arange(len(held)) - np.repeat(begins, lens)
    factor = _PLACES[place & 4095]
    if lens.max() > 4096:
        factor *= (place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    found = np.add.reduceat((data[held].astype(np.uint64) + np.uint64(1)) * factor, begins) + lens.astype(np.uint64)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return mixed(found), np.bincount(np.searchsorted(bounds, held[begins], "right"), minlength=len(texts))


def portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about PORTION bytes."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= PORTION:
            yield run
            run, size = [], 0
    if run:
        yield run


def window_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of n words; of a shorter text, of its whole sequence as one."""
    out = []
    for run in portions(texts):
        words, counts = word_hashes(run)
        every = window_hashes(words, n)  # those that lie in one text are among them
        at = 0
        for k in counts.tolist():
            out.append(np.unique(every[at : at + k - n + 1] if k >= n else window_hashes(words[at : at + k], n)))
            at += k
    return out
