"""Toxicity: compression-distance classification.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. The ordinary one is trained on all
windows of the ordinary fitting texts. The toxic one consists of the same content and, before it, what the trainer makes
of toxic text: of the words whose openings documents of that class hold far more often than chance lets them. So both
know plain prose alike, and the toxic dictionary shortens a window only by what is telling. The gain of a window is its
compressed length with the ordinary dictionary minus that with the toxic one.

Texts are coded before training and compressing: each byte of a word is followed by a byte that depends on the word up
to there. A match in a dictionary can then only begin where a word begins in the same way, so the middle of an ordinary
word is not shortened by a toxic word that has the same letters there.

A document's score is a logistic function of how many of its windows reach the gains in REACHED, absolutely and as a
share, of its largest gain and of its length. The function is calibrated on cross-fitted gains (dictionaries of one
half measure the other).

The classifier is fitted on at most SAMPLE labelled rows of each class, taken by the order of a hash. Copies among them
are evidence once only (`distinct_texts`), and the classes are weighted by their true counts, so the threshold means the
same however many labels there are. Every row is scored on its whole text. Labels, language, source and id are no inputs
of a score.

Defined results: null and empty texts have no windows and get the score of gain zero; training tables that lack one of
the classes give the score 0 for all; repeated rows get equal scores; an empty table gives no rows; only id and text
are read, so other columns may have any name; clean() keeps them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import pieces

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 3_000
#: Words in a window.
WINDOW = 8
ORDINARY_BYTES, TOXIC_BYTES = 32 << 10, 4_000
#: Bytes of a word that make its opening, and the least log-likelihood ratio of a telling one.
OPENING, TELLING = 5, 20.0
#: Gains, in bytes, from which a window counts; counts and shares above MOST add nothing.
REACHED, MOST = (3, 4), 12.0
#: Hashes that stand for a text among the fitting texts; it is a copy if half of them have been seen.
SKETCH = 64
TOXIC_FROM = 0.7

Fitted = tuple[bytes, bytes, tuple[float, ...]]
#: A-Z lower-cased; what ends a word becomes a blank.
_PLAIN = bytes(32 if c in b" \t\n\x0b\x0c\r.,;:!?#*$%&|" else c | 32 if 65 <= c <= 90 else c for c in range(256))
#: Powers of 37 and of its inverse modulo 2**16, whose period is a divisor of 2**14.
_POWERS, _INVERSES = (np.array([pow(37, sign * i, 1 << 16) for i in range(1 << 14)], np.uint16) for sign in (1, -1))


def words(text: bytes) -> list[bytes]:
    """The text's words, lower-cased (A-Z)."""
    return text.translate(_PLAIN).split()


def coded(text: bytes) -> tuple[bytes, np.ndarray]:
    """The code of the text's words, a blank behind each, and where in it words end.

    Each byte is followed by bits of a polynomial hash of its word up to there: of differences of prefix sums.
    """
    plain = np.frombuffer(text.translate(_PLAIN) + b" ", np.uint8)
    blank = plain == 32
    plain = plain[~(blank & np.append(True, blank[:-1]))]
    ends = np.flatnonzero(plain == 32) + 1
    sums = np.cumsum(plain * np.resize(_INVERSES, len(plain)), dtype=np.uint16)
    before = np.append(np.uint16(0), sums[ends[:-1] - 1])[: len(ends)]
    state = (sums - np.repeat(before, np.diff(ends, prepend=0))) * np.resize(_POWERS, len(plain))
    out = np.empty(2 * len(plain), np.uint8)
    out[::2], out[1::2] = plain, state * np.uint16(0x9E37) >> np.uint16(8)
    return out.tobytes(), 2 * ends


def windows(text: bytes) -> list[bytes]:
    """The whole text in windows of WINDOW coded words."""
    code, ends = coded(text)
    cuts = [0, *ends[WINDOW - 1 :: WINDOW].tolist()]
    if len(code) > cuts[-1]:
        cuts.append(len(code))
    return [code[a:b] for a, b in zip(cuts, cuts[1:])]


def distinct_texts(texts: Iterable[bytes]) -> list[bytes]:
    """The texts without words and without near copies of earlier ones: a text whose copies fill a third of a corpus
    must not make its own words telling."""
    seen, kept = set(), []
    for text in texts:
        own = words(text)
        sketch = sorted({xxhash.xxh64_intdigest(b" ".join(own[i : i + 3])) for i in range(max(1, len(own) - 2))})[:SKETCH]
        if own and 2 * sum(h in seen for h in sketch) < len(sketch):
            seen.update(sketch)
            kept.append(text)
    return kept


def _openings(text: bytes) -> set[bytes]:
    return {(w + b" ")[:OPENING] for w in words(text)}


def telling(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Openings of words that toxic documents have far more often than chance lets them: by the log-likelihood ratio of
    their document counts."""
    own, other = (Counter(o for t in texts for o in _openings(t)) for texts in (toxic, ordinary))
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    found = set()
    for opening, n in own.items():
        m = other[opening]
        if n >= 3 and n > share * (n + m):
            ratio = 2 * (n * math.log(n / (share * (n + m))) + (m * math.log(m / ((1 - share) * (n + m))) if m else 0))
            if ratio >= TELLING:
                found.add(opening)
    return found


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a zstandard dictionary trained on the samples; of fewer samples than the trainer takes, all."""
    try:
        made = zstd.train_dictionary(size + 2048, samples, k=segment, d=8).as_bytes()
    except zstd.ZstdError:
        made = b"".join(dict.fromkeys(samples))
    # What precedes the content (magic, id, entropy tables, offsets) is of no use in a raw dictionary.
    return made[-size:]


def train(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary contents."""
    openings = telling(toxic, ordinary)
    plain = _trained([w for t in ordinary for w in windows(t)], ORDINARY_BYTES, 64)
    said = [coded(w)[0] for t in toxic for w in words(t) if (w + b" ")[:OPENING] in openings]
    own = _trained(said, TOXIC_BYTES, 24) if said else b""
    return own + plain, plain


class Gains:
    """Window gains of texts under a pair of dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        make = lambda content: zstd.ZstdCompressor(
            dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT),
            compression_params=zstd.ZstdCompressionParameters.from_level(
                1, window_log=16, hash_log=16, chain_log=16, search_log=4, min_match=3, strategy=zstd.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0
            ),
        )
        self.toxic, self.ordinary = make(toxic), make(ordinary)

    def of(self, text: bytes | None) -> list[int]:
        """The gain of each window."""
        a, b = self.ordinary.compress, self.toxic.compress
        return [len(a(w)) - len(b(w)) for w in windows(text)] if text else []


def features(gains: list[int]) -> tuple[float, ...]:
    """Windows that reach each of REACHED, as count and per cent; the largest gain; logarithm of the number of windows."""
    if not gains:
        return (0.0,) * (2 * len(REACHED) + 2)
    n, counts = len(gains), [sum(g >= r for g in gains) for r in REACHED]
    return (*(min(float(c), MOST) for c in counts), *(min(100 * c / n, MOST) for c in counts), min(max(float(max(gains)), 0.0), MOST), math.log(n))


def _logistic(rows: list[tuple[float, ...]], labels: list[int], counts: tuple[int, int] | None = None) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton's method with a slight ridge. counts: true counts of toxic and ordinary
    rows, by which the rows of a class are weighted; without them, every row counts once."""
    x = np.column_stack([np.ones(len(rows)), np.array(rows)])
    y, w = np.array(labels, float), np.zeros(x.shape[1])
    each = np.ones(len(y))
    if counts:
        each = np.where(y == 1, counts[0] / max(1, labels.count(1)), counts[1] / max(1, labels.count(0)))
        each *= len(y) / each.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + 0.01 * w
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(toxic: list[bytes], ordinary: list[bytes], counts: tuple[int, int] | None = None) -> Fitted | None:
    """counts: labelled rows of both classes of which the texts are a sample."""
    toxic, ordinary = distinct_texts(toxic), distinct_texts(ordinary)
    if not toxic or not ordinary:
        return None
    rows, labels = [], []
    halves = [(toxic[k::2], ordinary[k::2]) for k in (0, 1)]
    for k in (0, 1):
        if all(halves[1 - k]):
            gains = Gains(*train(*halves[1 - k]))
            for label, texts in ((1, halves[k][0]), (0, halves[k][1])):
                rows += [features(gains.of(t)) for t in texts]
                labels += [label] * len(texts)
    weights = _logistic(rows, labels, counts) if len(set(labels)) == 2 else (-2.0, 0.4, *(0.0,) * (2 * len(REACHED) + 1))
    return (*train(toxic, ordinary), weights)


def probability(model: Fitted, gains: list[int]) -> float:
    z = model[2][0] + sum(w * g for w, g in zip(model[2][1:], features(gains)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _labelled(labels: DataFrame, held_out: int | None) -> DataFrame:
    rows = labels.where("toxic is not null and doc_id is not null")
    if held_out is not None:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != held_out)
    return rows


def class_counts(labels: DataFrame, held_out: int | None = 1) -> tuple[int, int]:
    """Labelled ids of both classes (toxic, ordinary), from which training_rows takes its sample."""
    found = {r.toxic: r.n for r in _labelled(labels, held_out).select("doc_id", "toxic").distinct().groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.get(1, 0), found.get(0, 0)


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int | None = 1) -> tuple[list[bytes], list[bytes]]:
    """At most SAMPLE texts of each class; held_out: the remainder of crc32(doc_id) mod 3 that is never learnt from."""
    rows = _labelled(labels, held_out)
    out = []
    for label in (1, 0):
        ids = rows.where(F.col("toxic") == label).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
        out.append([bytes(r.text) for r in sorted(texts.collect(), key=lambda r: r.doc_id) if r.text])
    return out[0], out[1]


def scored(docs: DataFrame, model: Fitted | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, max_gain (bytes that the toxic dictionary saves in the most telling window)."""

    def score(batches):
        gains = Gains(*model[:2]) if model else None
        for batch in pieces(batches, 1024):
            found = []
            for text in batch.column(1).to_pylist():
                if gains is None:
                    found.append((0.0, 0.0))
                    continue
                g = gains.of(text)
                found.append((probability(model, g), float(max(g, default=0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "score", "max_gain"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(score, "doc_id bigint, score double, max_gain double")


def clean(docs: DataFrame, model: Fitted | None) -> DataFrame:
    """The documents that score below TOXIC_FROM, with all their columns. Each row is judged by itself, so nothing is
    shuffled; without a model all stay."""
    at = docs.columns.index("text")

    def keep(batches):
        gains = Gains(*model[:2])
        for batch in pieces(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([probability(model, gains.of(t)) < TOXIC_FROM for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema) if model else docs


def fitted(spark: SparkSession, sf_dir: str) -> Fitted | None:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(*training_rows(docs, labels), class_counts(labels))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; kept: what the pipeline's first stage keeps."""
    rows = scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), fitted(spark, sf_dir))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    toxic = F.col("score") >= TOXIC_FROM
    return rows.select("doc_id", held.alias("held_out"), "score", toxic.cast("int").alias("predicted"), "max_gain", (~toxic).alias("kept"))
