"""Phrase collocation mining: contiguous phrases that occur together more often than their parts do.

All runs of one to max_n words within a piece (a stretch between punctuation or line ends) become rows of a DataFrame,
which are hash-aggregated per language; candidates join the counts of their prefixes and suffixes at every cut, scores are
taken in Decimal, phrases that live inside a one-word extension nearly as often as by themselves go by an anti-join, and
the best of each language are ranked in windows.

Rows leave the workers counted within about PORTION bytes of text, so a phrase that a third of the corpus repeats costs a
row a portion. Words and pairs come first. Longer runs are made into rows only where every pair in them may have reached
min_count, since a run occurs no more often than any part of it: frequent pairs set bits in one table of BLOOM bits (never
more, whatever the corpus), and a run with an unset bit is left out. Pairs that share a bit let too many runs through,
never too few, so the counts are exact; a full table only means that more runs are counted.

Why one-word extensions are enough: counts do not grow with a phrase's length, so if a phrase two words longer occurs often
enough, so does the one between, and it is a candidate too.

Defined results: null texts are empty, a null language is `und`; A-Z are lower-cased; repeated rows count each; phrases of
equal score and count rank by their UTF-8 bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import mixed, pieces, written

MAX_N = 4
MIN_COUNT = 30
#: A phrase goes if an extension has this many hundredths of its occurrences.
INSIDE = 80
SCALE = 2_000_000
TOP = 2000
#: Bytes of text counted at a time by a worker.
PORTION = 4 << 20
#: Bits of the table of frequent pairs: 8 MB.
BLOOM = 1 << 26
#: Parts in which a language's phrases are ranked first.
SALTS = 64
#: One byte to one: A-Z to a-z, tabs to blanks, whatever ends a piece to a line feed.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def coded(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """(words, the text as indices into them); index 0 stands between pieces."""
    known = {b"\n": 0, b"": -1}
    found = np.array([known.setdefault(w, len(known) - 1) for w in text.translate(PLAIN).replace(b"\n", b" \n ").split(b" ")], np.int64)
    words = [w for w in known if w != b""]
    return words, found[found >= 0]


def pair_hashes(words: list[bytes], lang: str) -> tuple[np.ndarray, np.uint64]:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), np.uint64(xxhash.xxh64_intdigest(lang))


def _bit(first: np.ndarray, second: np.ndarray, lang: np.uint64, bits: int) -> np.ndarray:
    return (mixed(mixed(first + lang) + second) % np.uint64(bits)).astype(np.int64)


def runs(words: list[bytes], at: np.ndarray, n: int, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the distinct runs of n words that begin at starts, joined by blanks; how often each does)."""
    code = at[starts]
    for k in range(1, n):
        if k > 1:  # numbered anew, so that no product passes 64 bits
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(words) + at[starts + k]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    vocabulary = pa.array(words, pa.binary())
    parts = [vocabulary.take(pa.array(at[starts[first] + k])) for k in range(n)]
    return (pc.binary_join_element_wise(*parts, b" ") if n > 1 else parts[0]), counts


def _begins(at: np.ndarray, n: int) -> np.ndarray:
    """Where runs of n words lie within a piece: for each place but the last n - 1, true or false."""
    held = at > 0
    fits = held[: len(at) - n + 1].copy()
    for k in range(1, n):
        fits &= held[k : len(at) - n + 1 + k]
    return fits


def counted(docs: DataFrame, sizes: list[int], frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f): the runs of each of these sizes with their occurrences; without a table of frequent pairs also a
    row of each language with a null phrase, for all of its words. With one, only runs all of whose pairs it has."""
    table = docs.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None

    def rows(lang: str, text: bytes):
        words, at = coded(text)
        if table is None:
            yield lang, pa.array([None], pa.binary()), np.array([(at > 0).sum()])
        else:
            hashes, own = pair_hashes(words, lang)
            bit = _bit(hashes[at[:-1]], hashes[at[1:]], own, len(table.value) * 8)
            known = (table.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        for n in sizes:
            if len(at) < n:
                continue
            fits = _begins(at, n)
            if table is not None:
                for k in range(n - 1):
                    fits &= known[k : len(at) - n + 1 + k]
            if fits.any():
                yield lang, *runs(words, at, n, np.flatnonzero(fits))

    def explode(batches):
        held: dict[str, list[bytes]] = {}
        size = 0

        def portion():
            for lang, texts in held.items():
                for name, phrases, counts in rows(lang, b"\n".join(texts)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts)), phrases.cast(pa.binary()), pa.array(counts, pa.int64())], names=["lang", "phrase", "c"])

        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= PORTION:
                    yield from portion()
                    held, size = {}, 0
        yield from portion()

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = texts.mapInArrow(explode, "lang string, phrase binary, c bigint")
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("c").alias("f"))


def pair_table(pairs: DataFrame, bits: int) -> np.ndarray:
    """A table of bits with those of all pairs (lang, phrase) set; its size is fixed."""

    def place(batches):
        for batch in batches:
            langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            slots = np.zeros(0, np.int64)
            for lang in set(langs):
                own = [p.split(b" ") for g, p in zip(langs, phrases) if g == lang]
                (first, code), (second, _) = pair_hashes([a for a, _ in own], lang), pair_hashes([b for _, b in own], lang)
                slots = np.append(slots, _bit(first, second, code, bits))
            slots = np.unique(slots)
            byte, begin = np.unique(slots >> 3, return_index=True)
            value = np.bitwise_or.reduceat(1 << (slots & 7), begin) if len(slots) else slots
            yield pa.RecordBatch.from_arrays([pa.array(byte, pa.int64()), pa.array(value, pa.int64())], names=["byte", "bits"])

    found = pairs.select("lang", F.col("phrase").cast("binary")).mapInArrow(place, "byte bigint, bits bigint").groupBy("byte").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    table[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return table


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, bits: int = BLOOM) -> DataFrame:
    """(lang, phrase, f) of all runs of 1 to max_n words with min_count occurrences, and the words of each language under a null phrase."""
    enough = F.col("phrase").isNull() | (F.col("f") >= min_count)
    short = written(counted(docs, [1, 2][:max_n]).where(enough), "phrases")
    if max_n < 3:
        return short
    table = pair_table(short.where("phrase like '% %'"), bits)
    return short.unionByName(written(counted(docs, list(range(3, max_n + 1)), table).where(enough), "phrases"))


def collocations(counts: DataFrame, min_count: int = MIN_COUNT, inside: int = INSIDE, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """The best phrases of each language from phrase_counts(): lang, rank, phrase, a, l, r, n, score."""
    words = F.split("phrase", " ", -1)
    found = counts.where(f"phrase is not null and f >= {min_count}")
    candidates = found.where("phrase like '% %'").select("lang", "phrase", F.col("f").alias("a"), words.alias("_words"))
    cuts = candidates.select("lang", "phrase", "a", "_words", F.explode(F.expr("sequence(1, size(_words) - 1)")).alias("k")).selectExpr(
        "lang", "phrase", "a", "k", "array_join(slice(_words, 1, k), ' ') as _left", "array_join(slice(_words, k + 1, size(_words)), ' ') as _right"
    )
    part = lambda side, as_: found.select("lang", F.col("phrase").alias(side), F.col("f").alias(as_))
    cuts = cuts.join(part("_left", "l"), ["lang", "_left"]).join(part("_right", "r"), ["lang", "_right"])
    score = F.expr(f"cast(a as decimal(19,0)) * {scale} div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What each candidate of three words or more is a one-word extension of.
    longer = candidates.where("size(_words) > 2").select("lang", "a", F.explode(F.expr("array(array_join(slice(_words, 1, size(_words) - 1), ' '), array_join(slice(_words, 2, size(_words) - 1), ' '))")).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    swallowed = F.expr(f"cast(_longer as decimal(19,0)) * 100 >= cast(a as decimal(19,0)) * {inside}")
    kept = scored.join(longer.where("_longer is not null").withColumnRenamed("lang", "_lang").withColumnRenamed("phrase", "_phrase"), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & swallowed, "left_anti")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("_salt"))
    best = "row_number() over (partition by {} order by score desc, a desc, phrase)"
    first = kept.withColumn("_in_salt", F.expr(best.format("lang, _salt"))).where(f"_in_salt <= {top}")
    ranked = first.withColumn("rank", F.expr(best.format("lang")).cast("bigint")).where(f"rank <= {top}")
    totals = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents."""
    return collocations(phrase_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")))


SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) t(k)),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM s GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k >= 2 AND f >= 30),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
sc AS (
  SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, 2000000 * a // (x.f + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.ws[1:j], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.ws[j + 1:], ' ')),
lo AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (SELECT lang, k, a, unnest(range(2, k)) AS m, ws FROM c),
inner_ AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM parts)),
kept AS (SELECT * FROM lo WHERE NOT EXISTS (SELECT 1 FROM inner_ z WHERE z.lang = lo.lang AND z.phrase = lo.phrase AND 100 * z.a >= 80 * lo.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
