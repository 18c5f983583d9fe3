"""Text found on pages of characters: whole words, and what stands in a rectangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written
from .spatial import BROADCAST_ROWS

#: What words are made of.
LETTER = r"\p{L}\p{N}_"
#: Words of the runs by which texts meet phrases, and slots of the table that keeps other runs out.
GRAM, SLOTS = 3, 1 << 20


def _lines(chars: DataFrame, keys: list[str]) -> DataFrame:
    return chars.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "char"))).alias("c")).select(*keys, F.transform("c", lambda s: s["idx"]).alias("at"), F.array_join(F.transform("c", lambda s: s["char"]), "").alias("t"))


def found_words(chars: DataFrame, keys: list[str], word: str, case_sensitive: bool = True) -> DataFrame:
    """(keys, hit, first, last): each place of a page (keys) where the word stands by itself, as character indices.

    chars: (keys, idx, char), one character a row. Places do not overlap and are counted from 0.
    """
    size = len(word)
    if not size:
        return _lines(chars, keys).select(*keys, F.lit(0).alias("hit"), F.get("at", F.lit(0)).alias("first"), F.get("at", F.lit(0)).alias("last")).limit(0)
    quoted = "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in word)
    form = ("" if case_sensitive else "(?iu)") + f"(?<![{LETTER}]){quoted}(?![{LETTER}])"
    # What lies between the places, with its end: a running sum along the page, so the work is linear in its length.
    parts = _lines(chars, keys).select(*keys, "at", F.posexplode(F.split("t", form, -1)).alias("hit", "_part"), F.size(F.split("t", form, -1)).alias("_n"))
    end = F.sum(F.length("_part")).over(Window.partitionBy(*keys).orderBy("hit")) + F.col("hit") * size
    hits = parts.withColumn("_i", end.cast("int")).where("hit < _n - 1")
    return hits.select(*keys, "hit", F.get("at", F.col("_i")).alias("first"), F.get("at", F.col("_i") + size - 1).alias("last"))


def words_of(text: Column, case_sensitive: bool = True) -> Column:
    """The words of a text, in order: runs of letters, digits and underscores."""
    return F.regexp_extract_all(text if case_sensitive else F.lower(text), F.lit(f"[{LETTER}]+"), F.lit(0))


def _grams(listed: DataFrame) -> DataFrame:
    """Each phrase's runs of GRAM words, with their places in it; of a shorter phrase all its words."""
    n = F.least(F.size("_words"), F.lit(GRAM))
    runs = F.transform(F.sequence(F.lit(0), F.size("_words") - n), lambda i: F.slice("_words", i + 1, n))
    cut = listed.select("_phrase", "_words", n.alias("_n"), F.posexplode(runs).alias("_at", "_gram"))
    return cut.withColumn("_hash", _hashed(F.col("_gram"), F.lit(0), F.col("_n")))


def _hashed(words: Column, at: Column, n: Column) -> Column:
    """One number for n words from a place on."""
    return F.xxhash64(F.get(words, at), *[F.when(n > k, F.get(words, at + k)) for k in range(1, GRAM)])


def found_phrases(docs: DataFrame, phrases: DataFrame, doc: str, text: str, phrase: str, case_sensitive: bool = True) -> DataFrame:
    """(doc, phrase, word): every place of a dictionary's phrases in the texts, counted in words from 0; places may overlap.

    A phrase is found where its words follow one another as whole words, whatever signs and blanks stand between them.
    Texts meet phrases by runs of GRAM words (of shorter phrases, all their words): a table of 64 bits in each of SLOTS
    slots, broadcast whatever the dictionary's size, keeps nearly all other runs of the texts from becoming rows. What is
    left is written and joined by equality with each phrase's rarest run; only for longer phrases are all words compared.
    So the work grows with the texts and with what is found, not with the phrases times the texts, and the dictionary may
    have any size. Null texts, and phrases without a word, are found nowhere; rows of one doc and text are told once.
    """
    # Written first: a filter on the words would compute the phrases twice, where they are cut from texts.
    spelt = written(phrases.select(F.col(phrase).alias("_phrase")).distinct()).withColumn("_words", words_of(F.col("_phrase"), case_sensitive)).where("size(_words) > 0")
    grams = written(_grams(spelt))
    lengths = [r._n for r in grams.select("_n").distinct().collect()]  # GRAM numbers at most
    slot, bit = F.pmod("_hash", F.lit(SLOTS)), F.expr("shiftleft(1L, cast(pmod(shiftright(_hash, 40), 64) as int))")
    table = grams.groupBy(slot.alias("_slot")).agg(F.bit_or(bit).alias("_bits"))

    texts = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).where("_text is not null")
    held = texts.select("_doc", F.xxhash64("_text").alias("_print"), words_of(F.col("_text"), case_sensitive).alias("_held"))
    runs = held.select("_doc", "_print", "_held", F.posexplode_outer("_held").alias("_pos", "_word"))  # the inner form filters by words that it cuts once more
    runs = runs.withColumn("_n", F.explode(F.array(*map(F.lit, lengths))) if lengths else F.lit(0)).where("_pos + _n <= size(_held)")
    runs = runs.withColumn("_hash", _hashed(F.col("_held"), F.col("_pos"), F.col("_n"))).withColumn("_slot", slot)
    known = runs.join(F.broadcast(table), "_slot").where(F.col("_bits").bitwiseAND(bit) != 0)
    places = written(known.select("_doc", "_print", "_pos", "_hash", F.slice("_held", F.col("_pos") + 1, F.col("_n")).alias("_gram")))

    met = lambda keys: places.join(_few(keys), "_hash").where("_gram = _own")
    sure = met(grams.where("size(_words) = _n").select("_phrase", F.col("_gram").alias("_own"), "_hash")).select("_doc", "_phrase", F.col("_pos").alias("word"))
    if GRAM not in lengths:
        return sure.distinct().select(F.col("_doc").alias(doc), F.col("_phrase").alias(phrase), "word")
    # A phrase with a run that no text has is found nowhere.
    long = grams.where("size(_words) > _n")
    often = places.join(_few(long.select("_hash").distinct()), "_hash", "left_semi").groupBy("_hash").agg(F.count(F.lit(1)).alias("_often"))
    rare = long.join(often, "_hash").groupBy("_phrase").agg(F.min_by(F.struct("_at", F.col("_gram").alias("_own"), "_hash", "_words"), F.struct("_often", "_at")).alias("k"), F.count(F.lit(1)).alias("_found"))
    rare = written(rare.where(F.col("_found") == F.size("k._words") - GRAM + 1).select("_phrase", "k.*"))
    # The texts with a place still open are cut into words again, and compared there.
    open_ = written(met(rare).select(F.col("_doc").alias("_d"), F.col("_print").alias("_p"), "_phrase", "_words", (F.col("_pos") - F.col("_at")).alias("word")).where("word >= 0").distinct())
    both = texts.withColumn("_print", F.xxhash64("_text")).join(_few(open_), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_print") == F.col("_p")))
    checked = both.where(F.slice(words_of(F.col("_text"), case_sensitive), F.col("word") + 1, F.size("_words")) == F.col("_words"))
    return sure.unionByName(checked.select("_doc", "_phrase", "word")).distinct().select(F.col("_doc").alias(doc), F.col("_phrase").alias(phrase), "word")


def _few(df: DataFrame) -> DataFrame:
    """df, counted by a job: broadcast if its rows are few, merged if not."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def text_in_boxes(chars: DataFrame, boxes: DataFrame, keys: list[str], box: list[str], most: int = 100) -> DataFrame:
    """(keys, box, text): at most so many characters whose middle (x, y) lies in each box (columns l, b, r, t), in reading order.

    The limit is the look-up's own, for probing what a place is about.
    """
    from .spatial import range_join

    met = range_join(chars, boxes, "x", "y", keys)
    return met.groupBy(*keys, *box).agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "char"))), lambda s: s["char"]), ""), 1, most).alias("text"))
