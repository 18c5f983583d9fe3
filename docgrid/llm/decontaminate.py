"""Benchmark decontamination: n-gram seeds, joined, then Smith-Waterman alignment.

The n-grams of the test items are a table of seeds (gram, item, place). Each document's n-grams are read off once; a table
of BITS bits, in which the seeds' are set, keeps all others from becoming rows, so what is shuffled are the few n-grams that
documents share with items, however large the corpus and the benchmark are. They are joined with the seeds by equality;
the hits of a text and an item are gathered as bands of neighbouring diagonals, and the item is aligned with these
stretches of the text by words. Substituted, inserted and dropped words lower the score without ending the alignment, so
edited and paraphrased copies are found too. Every n-gram of an item is a seed, however many documents have it, so a
text's verdict depends on no other text, and one hit is enough. A stretch is left unaligned only if it holds too few of
the item's words to reach COPIED, so what is lost are copies in which no SEED words of the item follow one another.

Texts are told apart by their MD5, and equal texts are aligned once; documents are read twice, whatever the benchmark's
size: for their n-grams, and to take the verdicts on their texts. Nothing of the items but the bit table and how many there
are reaches the driver.

Defined results: words are compared with A-Z lower-cased and punctuation at their ends taken off; null and empty texts
and items match nothing; items shorter than SEED words are seeded by their whole sequence; rows with a null item_id are
left out; repeated rows of documents are each reported, equal items once; if a text holds an item several times, its best
alignment (the earliest of equals) is reported; ids may be of any type; other columns of the documents are kept by
clean() and not read by matches(); clean() judges texts, so a null or repeated doc_id makes no difference to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WordHashes, forget, pieces, window_hashes, written

SEED = 3
#: Bits of the table that tells which n-grams may be seeds: 8 MB.
BITS = 1 << 26
#: Hits whose diagonals lie in the same or in neighbouring bands of so many words belong together.
BAND = 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the perfect score from which a stretch counts as a copy of the item.
COPIED = 0.5
ENDS = b".,;:!?\"'()[]{}<>#*$%&|-_"
#: Items that a text is aligned with in one row.
TOGETHER = 200
#: Keys of texts (16 bytes each) that are broadcast; more are joined.
KEYS = 500_000


def words_of(text: bytes | None, cache: WordHashes) -> np.ndarray:
    return cache.of(text.lower().split()) if text else np.zeros(0, np.uint64)


def align(item: np.ndarray, part: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of item and part: score as a share of a perfect one, and the part's words it spans."""
    n = len(part)
    steps = np.arange(n + 1) * -GAP
    above = np.zeros(n + 1, np.int64)
    start_above = np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in item:
        diag = above[:-1] + np.where(part == word, MATCH, MISMATCH)
        here = np.zeros(n + 1, np.int64)
        here[1:] = np.maximum(np.maximum(diag, above[1:] + GAP), 0)
        start = np.arange(n + 1)
        start[1:] = np.where(here[1:] == 0, start[1:], np.where(here[1:] == diag, start_above[:-1], start_above[1:]))
        # Gaps along the part: a running maximum of the scores with the gap cost added back.
        lifted = np.maximum.accumulate(here + steps)
        run = lifted - steps
        source = np.maximum.accumulate(np.where(here + steps == lifted, np.arange(n + 1), 0))
        start = np.where((run > here) & (run > 0), start[source], start)
        above, start_above = np.maximum(run, 0), start
        at = int(above.argmax())
        if above[at] > best:
            best, span = int(above[at]), (int(start_above[at]), at)
    return best / (MATCH * len(item)), *span


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, grams): the hashed words of each item as bytes, and its n-grams in order."""

    def prepare(batches):
        cache = WordHashes(ENDS)
        for batch in pieces(batches):
            words = [words_of(t, cache) for t in batch.column(1).to_pylist()]
            grams = [window_hashes(w, SEED).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(grams, pa.list_(pa.int64()))], names=["item_id", "words", "grams"])

    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null").distinct()
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(prepare, f"item_id {kind}, words binary, grams array<bigint>").where(F.size("grams") > 0)


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """A table of BITS bits, of fixed size, in which those of all seeds are set."""
    bit = F.pmod("gram", F.lit(BITS))
    found = seeds.groupBy(F.shiftright(bit, 3).alias("byte")).agg(F.expr(f"bit_or(shiftleft(1, cast(pmod(gram, {BITS}) & 7 as int)))").alias("bits")).toArrow()
    table = np.zeros(BITS // 8, np.uint8)
    table[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return table


def _shared_grams(texts: DataFrame, table: np.ndarray, widths: list[int]) -> DataFrame:
    """(key, text, grams, at) of the texts that hold n-grams with a set bit; these, and where they stand."""
    known = texts.sparkSession.sparkContext.broadcast(table)

    def search(batches):
        cache = WordHashes(ENDS)
        for batch in pieces(batches):
            out = []
            for text in batch.column(0).to_pylist():
                words = words_of(text, cache)
                found, places = [], []
                for n in widths:
                    if len(words) >= n:
                        grams = window_hashes(words, n)
                        bit = grams & np.uint64(BITS - 1)
                        at = np.flatnonzero((known.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                        found.append(grams[at].view(np.int64))
                        places.append(at)
                if any(map(len, found)):
                    out.append((hashlib.md5(text).digest(), text, np.concatenate(found), np.concatenate(places)))
            types = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], names=["key", "text", "grams", "at"])

    return texts.where("text is not null").mapInArrow(search, "key binary, text binary, grams array<bigint>, at array<bigint>")


def _stretches(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """The stretch that a run of neighbouring bands spans, in overlapping parts if it is long."""
    width = 4 * n + 4 * BAND
    if hi - lo <= width:
        return [(lo, hi)]
    return [(a, min(a + width, hi)) for a in range(lo, hi - n, width - 2 * n - 2 * BAND)]


def best_alignment(item: np.ndarray, words: np.ndarray, bands: list[int]) -> tuple[float, int, int]:
    """(score, first word, word after the last) of the best alignment within the stretches around these bands."""
    best, at = (0.0, 0, 0), 0
    while at < len(bands):
        end = at + 1
        while end < len(bands) and bands[end] - bands[end - 1] <= 1:
            end += 1
        lo, hi = max(0, (bands[at] - 1) * BAND), min(len(words), (bands[end - 1] + 2) * BAND + len(item))
        for a, b in _stretches(lo, hi, len(item)):
            # Each word of the item that is matched adds at most MATCH.
            if np.isin(item, words[a:b]).sum() < COPIED * len(item):
                continue
            score, x, y = align(item, words[a:b])
            if score > best[0]:
                best = (score, a + x, a + y)
            if score == 1:
                return best
        at = end
    return best


def copies(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, score, word_start, word_end): what each distinct text (by its key) copies."""
    items = written(_items(benchmark), "items")
    seeds = items.select("item_id", F.posexplode("grams").alias("place", "gram"))
    short = [r.n for r in items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(f"n < {SEED}").distinct().collect()]  # SEED - 1 numbers at most
    found = written(_shared_grams(texts, _bit_table(seeds), [SEED, *sorted(short)]), "shared-grams")
    hits = found.select("key", F.explode(F.arrays_zip("grams", "at")).alias("h")).select("key", F.col("h.grams").alias("gram"), F.col("h.at").alias("at"))
    band = F.floor((F.col("at") - F.col("place")) / BAND)
    pairs = hits.join(seeds, "gram").groupBy("key", "item_id").agg(F.array_sort(F.collect_set(band)).alias("bands"))
    parts = 1 + items.count() // TOGETHER
    pairs = pairs.join(items.select("item_id", F.col("words").alias("item")), "item_id")
    listed = pairs.groupBy("key", F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("item_id", "item", "bands")).alias("items"))
    whole = found.groupBy("key").agg(F.first("text").alias("text"))
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def score(batches):
        cache = WordHashes(ENDS)
        for batch in pieces(batches, 64):
            which, rows = [], []
            lists, values = batch.column(2), batch.column(2).flatten()
            ids, item, bands = (values.field(n) for n in ("item_id", "item", "bands"))
            at = 0
            for key, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists.value_lengths().to_pylist()):
                words = words_of(text, cache)
                for k in range(at, at + n):
                    best = best_alignment(np.frombuffer(item[k].as_py(), np.uint64), words, bands[k].as_py())
                    if best[0] >= COPIED:
                        which.append(k)
                        rows.append((key, *best))
                at += n
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), ids.take(pa.array(which, pa.int64())), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["key", "item_id", "score", "word_start", "word_end"])

    met = whole.join(listed, "key").select("key", "text", "items")
    out = written(met.mapInArrow(score, f"key binary, item_id {kind}, score double, word_start bigint, word_end bigint"), "copies")
    for table in (items, found):
        forget(table)
    return out


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, word_start, word_end), one row a document and item it copies."""
    found = copies(docs.select(F.col("text").cast("binary").alias("text")), benchmark)
    return docs.select("doc_id", _key(F.col("text")).alias("key")).join(found, "key").drop("key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that copy no test item, with all their columns."""
    keys = copies(docs.select(F.col("text").cast("binary").alias("text")), benchmark).select("key").distinct()
    few = keys.count() <= KEYS
    return docs.join(F.broadcast(keys) if few else keys, _key(docs["text"]) == keys["key"], "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
