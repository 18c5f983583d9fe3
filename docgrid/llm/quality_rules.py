"""Quality rules [native]: learned decision lists.

Statistics of every whole text are DataFrame expressions. Sequential covering learns an ordered list of rules from
labelled statistics: a rule grows threshold by threshold by FOIL's information gain on two thirds of the rows still
uncovered, is pruned from the end on the other third, and is taken if it is precise enough there. Each rule drops what
it covers; what no rule covers is kept. The list is emitted as one ordered conditional expression of Spark SQL, and as
text for people to read.

Learning uses at most SAMPLE labelled rows, taken by the order of a hash; statistics and verdicts cover all rows.

Defined results: null and blank texts have all statistics 0 and fail the base rule; repeated rows get equal verdicts;
labels of one class only (or none) learn an empty list, which keeps all that passes the base rule; an empty table gives
no rows; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import random
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WORD, let

#: Labelled rows that rules are learnt from, at most.
SAMPLE = 12_000
#: Least share of junk among what a rule covers, on the pruning rows; least number of rows it covers there.
PRECISE, LEAST = 0.8, 2
MAX_RULES, MAX_CONDITIONS = 12, 4
SYMBOLS = r"[#*$%&|<>]"
#: Ratios that conditions compare with thresholds; all are given by the statistics.
RATIOS = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


class Condition(NamedTuple):
    name: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.name] > self.value if self.above else row[self.name] <= self.value

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"

    def column(self) -> Column:
        c = F.expr(RATIOS[self.name]).cast("double")
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)


Rule = list[Condition]


def _repeats(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more.

    Window hashes are sorted with their positions; equal neighbours mark repeated windows, whose positions, in order,
    each add what they cover beyond the one before.
    """
    n = F.size(words)

    def marked(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        at = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
        return F.array_sort(F.transform(at, lambda i: F.get(pairs, i)["p"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.get(at, i + 1) - p, F.lit(3))).otherwise(3))
        return F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(0), lambda a, g: a + g)).otherwise(0)

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        # Most texts repeat no window; only those that do pay for the sort.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, lambda p: let(marked(p), covered)))

    return F.when(n < 4, 0).otherwise(let(hashes, count))


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text."""
    text = F.coalesce(text, F.lit(""))
    big = lambda c: c.cast("bigint")

    def of_words(words: Column) -> Column:
        return F.struct(
            big(F.size(words)).alias("n_words"),
            big(F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))).alias("word_chars"),
            big(_repeats(words)).alias("n_repeat_words"),
            big(F.size(F.array_distinct(words))).alias("n_distinct_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(big(F.size(lines)).alias("n_lines"), big(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), of_lines)
    return F.struct(words.alias("w"), lines.alias("l"), big(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and one column a statistic."""
    return docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s.w.*", "s.l.*", "s.n_symbols")


def grown(pos: list[dict], neg: list[dict]) -> Rule:
    rule: Rule = []
    while neg and len(rule) < MAX_CONDITIONS:
        p0, n0 = len(pos), len(neg)
        base = math.log2(p0 / (p0 + n0))
        best, chosen = 1e-9, None
        for name in RATIOS:
            rows = sorted([(r[name], 1) for r in pos] + [(r[name], 0) for r in neg])
            p = n = 0
            for k, (value, label) in enumerate(rows):
                p, n = p + label, n + 1 - label
                if k + 1 < len(rows) and rows[k + 1][0] == value:
                    continue
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a and (gain := a * (math.log2(a / (a + b)) - base)) > best:
                        # Half way to the next value, so that a rule does not hang on one row.
                        cut = (value + rows[k + 1][0]) / 2 if k + 1 < len(rows) else value
                        best, chosen = gain, Condition(name, above, float(cut))
        if chosen is None:
            break
        rule.append(chosen)
        pos, neg = ([r for r in rows if chosen.holds(r)] for rows in (pos, neg))
    return rule


def covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def pruned(rule: Rule, pos: list[dict], neg: list[dict]) -> Rule:
    def worth(r: Rule) -> float:
        p, n = (sum(covers(r, x) for x in rows) for rows in (pos, neg))
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])


def learn(rows: list[dict], labels: list[int]) -> list[Rule]:
    """An ordered list of rules for label 0 (junk), by sequential covering."""
    rng = random.Random(3)
    order = list(range(len(rows)))
    rng.shuffle(order)
    pos, neg = [rows[i] for i in order if labels[i] == 0], [rows[i] for i in order if labels[i] == 1]
    rules: list[Rule] = []
    while len(pos) >= 3 and neg and len(rules) < MAX_RULES:
        cut = lambda x: (x[: -(len(x) // 3) or None], x[len(x) - len(x) // 3 :])
        (gp, pp), (gn, pn) = cut(pos), cut(neg)
        rule = pruned(grown(gp, gn), pp, pn)
        p, n = (sum(covers(rule, r) for r in x) for x in (pp, pn))
        if not rule or p < LEAST or p < PRECISE * (p + n):
            break
        rules.append(rule)
        pos, neg = ([r for r in x if not covers(rule, r)] for x in (pos, neg))
        rng.shuffle(pos)
        rng.shuffle(neg)
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """The list as conditional expressions: whether a row is kept, and the text of the rule that dropped it."""
    kept, why = F.lit(True), F.lit(None).cast("string")
    for rule in reversed(rules):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        kept, why = F.when(test, False).otherwise(kept), F.when(test, " and ".join(map(str, rule))).otherwise(why)
    return kept, why


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[dict], list[int]]:
    """Ratios and labels of at most SAMPLE labelled rows."""
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi"))
    rows = rows.join(F.broadcast(own), "doc_id").select("doc_id", "quality", *[F.expr(e).cast("double").alias(n) for n, e in RATIOS.items()])
    found = sorted(rows.dropDuplicates(["doc_id"]).collect(), key=lambda r: r.doc_id)
    return [{n: r[n] for n in RATIOS} for r in found], [r.quality for r in found]


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    rows = with_statistics(docs)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    kept, why = verdict(rules)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & kept).alias("kept"), why.alias("dropped_by"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their statistics and the verdict of rules learnt from the labelled ones."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(docs.select("doc_id", "text"), learn(*training_rows(docs, labels)))
