"""Token ids in binary files: fixed-size blocks of ids, transposed into bit or byte planes, each compressed by itself.

The k-th plane of a block holds the k-th bit (or byte) of each of its ids. Planes of high bits are empty or nearly so and
cost next to nothing; a block is found by the chunk index and decoded without its neighbours, so any run of ids can be
read without the rest of its file.

A file is, in this order (numbers are little-endian):
    DGTP, version, bits a plane (1 or 8), two bytes of zero
    the blocks: of each its planes, lowest first, as zstandard frames
    the chunk index, one zstandard frame: for each block the place of its first byte (u64) and the bytes of each plane (u32;
        0 for a plane of zeros)
    the document index, one zstandard frame: ids (i64), a byte that tells a null id (u8), tokens (u64)
    the footer: ids a block (u32), blocks (u32), ids (u64), documents (u64), partition (u32), file of the partition (u32),
        bytes of the chunk index (u64), bytes of the document index (u64)
    DGTE

Documents are encoded once and written as a table, dealt by ranges of their ids and sorted; each task streams its
documents through one block at a time into files cut at FILE_BYTES, so the files, in order, hold the whole corpus in
order. Where a document begins in the corpus is its place in its file and the sum of the ids in the files before, from
one row a file.

Defined results: a null or empty text is the end id alone; rows with a null id come first; rows of equal ids follow the
CRC of their compressed tokens, and each has its place; an empty table gives no files and no rows; other columns are not read. A
damaged file raises ValueError.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import forget, new_path, pieces, removed, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Ids of a block.
BLOCK = 1 << 16
#: Compressed bytes after which a file ends, behind the document that reaches them.
FILE_BYTES = 16 << 20
#: Words longer than this are not remembered.
LONG_WORD = 64
#: Words of each half of a worker's memory.
REMEMBERED = 150_000
#: Words that are encoded as one line.
LINE = 256
#: Bytes of ids that a task hands over at a time.
HANDED = 4 << 20
#: Files whose offsets are broadcast; with more, they are joined by key.
FILES = 100_000
HEAD, TAIL = b"DGTP", b"DGTE"
FOOTER = struct.Struct("<IIQQIIQQ")


_KIND = np.zeros(256, np.uint8)
_KIND[list(b".,;:!?")], _KIND[list(b" \t\n\x0b\x0c\r")] = 1, 2
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 4


def separate(text: bytes) -> bytes:
    """The text as the tokenizer takes it, with fewer distinct words: ASCII letters in lower case, and a blank before
    punctuation between an ASCII letter or digit and white space (behind anything else it may belong to a longer sign).
    Texts that may hold a special token are left as they are."""
    if b"<|" in text:
        return text
    text = text.lower()
    kind = _KIND[np.frombuffer(b" %b " % text, np.uint8)]
    stop = kind == 1
    first, last = np.flatnonzero(stop[1:] & ~stop[:-1]) + 1, np.flatnonzero(stop[:-1] & ~stop[1:])
    at = first[(kind[first - 1] == 4) & (kind[last + 1] == 2)] - 1
    return np.insert(np.frombuffer(text, np.uint8), at, 32).tobytes() if len(at) else text


class Encoder:
    """The ids of texts. The vocabulary's tokens never span white space, so a text's ids are those of its blank-delimited
    words one after another, and a word goes through the tokenizer once while it is remembered.

    Words are remembered in two halves: a full younger one takes the place of the older one, and words that are met again
    move up, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        #: Whether a word ends with the id.
        self.last = np.array([i in ends for i in range(self.tokenizer.get_vocab_size())])

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not remembered. Words of letters are encoded in lines, which are cut where a word ends."""
        texts = [w.decode("utf-8", "replace") for w in words]
        letters = [k for k, t in enumerate(texts) if t.isalpha() and len(t) <= LONG_WORD]
        lines = [letters[at : at + LINE] for at in range(0, len(letters), LINE)]
        found, rest = {}, [k for k, t in enumerate(texts) if not t.isalpha() or len(t) > LONG_WORD]
        for own, line in zip(lines, self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in own]) for own in lines], add_special_tokens=False)):
            ids = np.array(line.ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(own):  # lower case made something else of a letter
                rest += own
                continue
            raw = ids.tobytes()
            found.update((words[k], raw[x:y]) for k, x, y in zip(own, [0, *ends], ends))
        found.update(zip([words[k] for k in rest], self._alone([texts[k] for k in rest])))
        return found

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [separate(t).split() if t else [] for t in texts]
        new = set().union(*split).difference(self.young)
        again = {w: self.old[w] for w in new if w in self.old}
        self.young |= again
        self.young |= self._new(list(new.difference(again)))
        out = [b"".join(map(self.young.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONG_WORD:
                del self.young[w]
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; it outlives a task, as workers are used again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, crc, ids): ids as a zstandard frame of little-endian unsigned 32-bit integers, the end id last."""
    end = struct.pack("<I", end_id)

    def encode(batches):
        press = zstandard.ZstdCompressor(1)
        for batch in pieces(batches):
            found = [press.compress(x + end) for x in encoder(vocabulary).ids(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(encode, "doc_id bigint, ids binary")
    return rows.withColumn("crc", F.crc32("ids"))


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block, lowest first; b'' for planes of zeros."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = (int(ids.max()).bit_length() + 7) // 8 if len(ids) else 0
    if bits == 8:
        planes = [np.ascontiguousarray(raw[:, k]) for k in range(used)]
    else:
        flat = np.packbits(np.unpackbits(raw[:, :used], axis=1, bitorder="little").T, axis=1, bitorder="little") if used else []
        planes = list(flat)
    found = [p.tobytes() if p.any() else b"" for p in planes]
    return found + [b""] * (32 // bits - len(found))


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    """The n ids whose planes these are."""
    raw = np.zeros((n, 4), np.uint8)
    if bits == 8:
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        for at in range(4):
            if any(own := planes[8 * at : 8 * at + 8]):
                blank = bytes((n + 7) // 8)
                rows = np.frombuffer(b"".join(p or blank for p in own), np.uint8).reshape(8, -1)
                raw[:, at] = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")[:, 0]
    return raw.view("<u4")[:, 0]


class PlaneWriter:
    """One file, put together in memory."""

    def __init__(self, bits: int, partition: int, number: int):
        self.bits, self.partition, self.number = bits, partition, number
        self.press = zstandard.ZstdCompressor(3)
        self.out, self.size = [HEAD + bytes([1, bits, 0, 0])], 8
        self.waiting, self.held, self.total = [], 0, 0
        self.index: list[bytes] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK:
            every = np.concatenate(self.waiting)
            whole = self.held - self.held % BLOCK
            for at in range(0, whole, BLOCK):
                self._block(every[at : at + BLOCK])
            self.waiting, self.held = [every[whole:].copy()], self.held - whole

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.press.compress(p) if p else b"" for p in to_planes(ids, self.bits)]
        self.index.append(struct.pack(f"<Q{len(frames)}I", self.size, *map(len, frames)))
        self.out += frames
        self.size += sum(map(len, frames))

    def content(self) -> bytes:
        """The file without its last four bytes."""
        if self.held:
            self._block(np.concatenate(self.waiting))
        chunks = self.press.compress(b"".join(self.index))
        ids = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        docs = self.press.compress(ids + bytes(d is None for d, _ in self.docs) + np.array([n for _, n in self.docs], "<u8").tobytes())
        foot = FOOTER.pack(BLOCK, len(self.index), self.total, len(self.docs), self.partition, self.number, len(chunks), len(docs))
        return b"".join([*self.out, chunks, docs, foot])


class PlaneFile:
    """A file's indices, and any run of its ids."""

    def __init__(self, data: bytes):
        if data[:4] != HEAD or data[-4:] != TAIL or data[4] != 1:
            raise ValueError("token planes: not a whole file of version 1")
        self.data, self.bits = data, data[5]
        foot = len(data) - 4 - FOOTER.size
        self.block, blocks, self.total, docs, self.partition, self.number, chunk_bytes, doc_bytes = FOOTER.unpack_from(data, foot)
        self.press = zstandard.ZstdDecompressor()
        try:
            index = self.press.decompress(data[foot - doc_bytes - chunk_bytes : foot - doc_bytes]) if blocks else b""
            listed = self.press.decompress(data[foot - doc_bytes : foot])
        except zstandard.ZstdError as e:
            raise ValueError("token planes: the indices are damaged") from e
        entry = struct.Struct(f"<Q{32 // self.bits}I")
        self.chunks = [entry.unpack_from(index, k * entry.size) for k in range(blocks)]
        self.lens = np.frombuffer(listed, "<u8", docs, 9 * docs).astype(np.int64)
        none = np.frombuffer(listed, np.uint8, docs, 8 * docs)
        self.doc_ids = [None if z else i for i, z in zip(np.frombuffer(listed, "<i8", docs).tolist(), none.tolist())]
        self.starts = np.cumsum(self.lens) - self.lens
        if int(self.lens.sum()) != self.total:
            raise ValueError("token planes: the documents do not add up to the ids")

    def chunk(self, k: int) -> np.ndarray:
        at, *sizes = self.chunks[k]
        planes = []
        for size in sizes:
            planes.append(self.press.decompress(self.data[at : at + size]) if size else b"")
            at += size
        return from_planes(planes, min(self.block, self.total - k * self.block), self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop; only the blocks that hold them are decoded."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first = start // self.block
        parts = [self.chunk(k) for k in range(first, (stop - 1) // self.block + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


def write_planes(rows: DataFrame, path: str, bits: int = 8) -> None:
    """Files of the rows of encoded(), in ascending order of doc_id and crc."""

    def write(batches):
        unpress = zstandard.ZstdDecompressor()
        partition, number, file = TaskContext.get().partitionId(), 0, None
        row = lambda f: pa.RecordBatch.from_arrays([pa.array([f.content()], pa.binary())], names=["value"])
        for batch in pieces(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = file or PlaneWriter(bits, partition, number)
                file.add(doc_id, np.frombuffer(unpress.decompress(ids), "<u4"))
                if file.size >= FILE_BYTES:
                    yield row(file)
                    file, number = None, number + 1
        if file:
            yield row(file)

    order = ["doc_id", "crc"]
    whole = rows.repartitionByRange(*order).sortWithinPartitions(*order, "ids").select("doc_id", "ids").mapInArrow(write, "value binary")
    # The cast keeps the bytes as they are; Spark's writer ends each row, so each file, by the separator, which is the last mark.
    whole.select(F.col("value").cast("string")).write.option("lineSep", TAIL.decode()).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files: partition, file, file_ids (ids of the file), file_start (its first id in the file), doc_id, ids."""
    names = ["partition", "file", "file_ids", "file_start", "doc_id", "ids"]

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                file = PlaneFile(data.as_py())
                spans = np.searchsorted(np.cumsum(file.lens * 4), np.arange(HANDED, 4 * file.total + HANDED, HANDED), "left").tolist()
                first = 0
                for last in sorted({min(s + 1, len(file.lens)) for s in spans}):
                    begin, end = int(file.starts[first]), int(file.starts[last - 1] + file.lens[last - 1])
                    raw = file.ids(begin, end).tobytes()
                    at = [(int(s) - begin) * 4 for s in file.starts[first:last]] + [len(raw)]
                    n = last - first
                    columns = [pa.array([v] * n, pa.int64()) for v in (file.partition, file.number, file.total)]
                    columns += [pa.array(file.starts[first:last], pa.int64()), pa.array(file.doc_ids[first:last], pa.int64()), pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    first = last

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(read, "partition bigint, file bigint, file_ids bigint, file_start bigint, doc_id bigint, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """rows of read_planes() with start: the ids of all documents before, in all files. rows are read twice."""
    files = rows.groupBy("partition", "file").agg(F.max("file_ids").alias("n"))
    # Sums within a partition's files, then over one row a partition.
    own = files.selectExpr("*", "sum(n) over (partition by partition order by file) - n as _own")
    parts = files.groupBy("partition").agg(F.sum("n").alias("n")).selectExpr("partition", "sum(n) over (order by partition) - n as _before")
    offsets = own.join(parts, "partition").select("partition", "file", (F.col("_own") + F.col("_before")).alias("_offset"))
    if files.count() <= FILES:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, ["partition", "file"]).withColumn("start", F.col("_offset") + F.col("file_start")).drop("_offset")


def op12_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in plane files and back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Written, so that no text is encoded again for the bounds of the ranges, nor after a loss.
    rows = written(encoded(docs, public_tokenizers.path(VOCABULARY)), "token-ids")
    path = new_path(spark, "token-planes")
    write_planes(rows, path)
    back = read_planes(spark, path).select("partition", "file", "file_ids", "file_start", "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    found = written(back, "token-index")
    forget(rows)
    removed(spark, path)
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")
