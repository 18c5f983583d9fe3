"""Secret scans [native]: candidates by pattern, false positives removed by a random forest.

Candidates are runs of key-like characters with a digit in them, and values assigned to words such as `password` or
`token`, in the same word or, after a blank, as the word behind (eight characters or more). Their features are DataFrame expressions: length, shares of character classes, transitions between classes,
entropy, coverage by a dictionary of words that secrets do not contain, marks in the path, and neighbouring words.
A random forest, trained from labelled findings (at most SAMPLE rows), is emitted as Spark conditional expressions; a
finding is a secret if the forest's mean vote reaches SECRET.

Every row is scanned within itself: no shuffle, and no candidate leaves its row before it is scored.

Defined results: null and empty texts have no findings; a candidate that repeats in a text is reported at each place;
equal rows have equal findings; a null path counts as empty; an empty table gives no rows; redacted() keeps all columns
and changes only text (and n_chars, where there is such a column). Columns may not be called `_found`.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WORD, let

SAMPLE = 4_000
TREES, DEPTH, LEAF = 15, 7, 4
SECRET = 0.5
MARK = "[SECRET]"
RUN = r"[A-Za-z0-9+/=_\-]*[0-9][A-Za-z0-9+/=_\-]*"
#: A word that may hold a secret: a long key-like run with a digit, or anything after an assignment in the word itself.
CANDIDATE = r"(?=[A-Za-z0-9+/=_\-]*[0-9])[A-Za-z0-9+/=_\-]{14,}"
NAMES = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth|credential|private[_\-]?key)"
#: An assignment within a word; its value is group 3.
ASSIGNED = NAMES + r"[\"']?\s*[:=]\s*[\"']?([^\s\"']{8,})"
#: The end of the words before a value that an assignment leaves open, and the value itself.
OPEN = NAMES + r"[\"']?\s*[:=]\s*[\"']?$"
VALUE = r"^[\"']?([^\s\"']{8,})"
HASHES = r"(?i)(commit|sha-?\d*|md5|checksum|digest|etag|uuid|guid|build|revision|version|blob|card|account|phone|order|invoice|isbn|serial)"
PATHS = r"(?i)(test|spec|example|sample|fixture|mock|docs?/|readme|vendor|\.lock|\.sum)"
#: Words that do not occur in generated keys.
DICTIONARY = "example sample placeholder changeme dummy your insert redacted foobar lorem ipsum test version release build image file document section chapter table figure page index config default user name host local server client public static content main module package license apache copyright national university international department customer product service account number street january february monday required string undefined value null none true false field change reset forgot enter getenv process environ settings option input request response password passwort secret token login username example".split()
FEATURES = ["length", "digits", "uppers", "lowers", "transitions", "entropy", "coverage", "hex_only", "digits_only", "repeats", "path_mark", "named", "assigned", "hashed", "prefixed"]


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def features(text: Column, before: Column, path: Column) -> Column:
    """The features of a candidate (non-empty), the words before it, and its path, as a struct of doubles."""
    n = F.length(text).cast("double")
    chars = F.split(text, "")

    def entropy(each: Column) -> Column:
        shares = F.transform(F.array_distinct(each), lambda c: F.size(F.filter(each, lambda x: x == c)) / n)
        return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    kind = lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)

    def turns(kinds: Column) -> Column:
        pairs = F.zip_with(kinds, F.slice(kinds, 2, F.size(kinds)), lambda a, b: F.when(b.isNotNull() & (a != b), 1.0).otherwise(0.0))
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / n

    values = {
        "length": F.least(n, F.lit(200.0)),
        "digits": _count(text, "[0-9]") / n,
        "uppers": _count(text, "[A-Z]") / n,
        "lowers": _count(text, "[a-z]") / n,
        "transitions": let(F.transform(F.filter(chars, lambda c: c != ""), kind), turns),
        "entropy": let(F.filter(chars, lambda c: c != ""), entropy),
        "coverage": _count(F.lower(text), "|".join(sorted(DICTIONARY, key=len, reverse=True))) / n,
        "hex_only": text.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "digits_only": text.rlike("^[0-9.\\-]+$").cast("double"),
        "repeats": text.rlike(r"(.)\1{5,}").cast("double"),
        "path_mark": F.coalesce(path, F.lit("")).rlike(PATHS).cast("double"),
        "named": before.rlike(NAMES).cast("double"),
        "assigned": before.rlike(r"[:=]\s*[\"']?$").cast("double"),
        "hashed": before.rlike(HASHES).cast("double"),
        "prefixed": text.rlike(r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|sk-|AIza|glpat-)").cast("double"),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


#: A candidate: its word's number, itself, what precedes it, and where in the word it begins.
FOUND = "array<struct<word:int,text:string,before:string,at:int>>"


def _places(text: Column, pattern: str) -> Column:
    """Array of structs (hit, gap, at): the matches of a pattern in order, the stretch before each and where that begins;
    the last has an empty match. Every place is that of the match itself, however often its characters stand elsewhere."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)

    def walk(both: Column) -> Column:
        gap, hit = (lambda k: F.get(both["gaps"], k)), (lambda k: F.coalesce(F.get(both["hits"], k), F.lit("")))
        begin = lambda k: F.aggregate(F.slice(both["gaps"], 1, k), F.lit(0), lambda n, g: n + F.length(g)) + F.aggregate(F.slice(both["hits"], 1, k), F.lit(0), lambda n, g: n + F.length(g))
        return F.transform(F.sequence(F.lit(0), F.size(both["gaps"]) - 1), lambda k: F.struct(hit(k).alias("hit"), gap(k).alias("gap"), begin(k).alias("at")))

    return let(F.struct(hits.alias("hits"), gaps.alias("gaps")), walk)


def _runs(text: Column, base: Column) -> Column:
    """Array of structs (text, at): the long runs of a stretch that begins at base."""
    found = F.filter(_places(text, CANDIDATE), lambda p: p["hit"] != "")
    return F.transform(found, lambda p: F.struct(p["hit"].alias("text"), (base + p["at"] + F.length(p["gap"])).alias("at")))


def in_word(word: Column, opened: Column) -> Column:
    """Array of structs (text, at): the values assigned within a word, each long run beside or within them, and, behind
    an assignment that the words before leave open, the word itself without its quote."""

    def of_match(p: Column) -> Column:
        value = F.regexp_extract(p["hit"], ASSIGNED, 3)
        at = p["at"] + F.length(p["gap"]) + F.length(p["hit"]) - F.length(value)
        inner = F.when(value.rlike(CANDIDATE), F.filter(_runs(value, at), lambda r: r["text"] != value)).otherwise(F.array().cast("array<struct<text:string,at:int>>"))
        beside = F.when(p["gap"].rlike(CANDIDATE), _runs(p["gap"], p["at"])).otherwise(F.array().cast("array<struct<text:string,at:int>>"))
        own = F.when(p["hit"] != "", F.array(F.struct(value.alias("text"), at.alias("at")))).otherwise(F.array().cast("array<struct<text:string,at:int>>"))
        return F.concat(own, inner, beside)

    found = F.when(word.rlike(ASSIGNED), F.flatten(F.transform(_places(word, ASSIGNED), of_match))).otherwise(_runs(word, F.lit(0)))
    behind = F.regexp_extract(word, VALUE, 1)
    first = F.struct(behind.alias("text"), F.when(F.substring(word, 1, 1).isin('"', "'"), 1).otherwise(0).alias("at"))
    return let(found, lambda every: F.when(opened & (behind != "") & ~F.array_contains(every, first), F.concat(F.array(first), every)).otherwise(every))


def candidates(text: Column) -> Column:
    """Array of structs (word, text, before, at): the candidates of a text, the number of their word, what precedes them,
    and where they begin in the word."""

    def of_words(words: Column) -> Column:
        last = F.size(words) - 1
        opened = lambda i: F.get(words, i).rlike(VALUE) & F.concat_ws(" ", prev(i, 2), prev(i, 1)).rlike(OPEN)
        prev = lambda i, k: F.when(i >= k, F.coalesce(F.get(words, i - k), F.lit(""))).otherwise("")

        at = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(words, i).rlike(CANDIDATE) | F.get(words, i).rlike(ASSIGNED) | opened(i))

        def of_word(i: Column) -> Column:
            word = F.get(words, i)

            def placed(r: Column) -> Column:
                prefix = F.substring(word, F.lit(1), r["at"])
                # What precedes a value in a word of several fields is its own field, not those before.
                field = F.regexp_extract(prefix, r"[^,;&{}\[\]]*$", 0)
                before = F.when(F.length(field) < F.length(prefix), field).otherwise(F.concat_ws(" ", prev(i, 2), prev(i, 1), prefix))
                return F.struct(i.alias("word"), r["text"].alias("text"), before.alias("before"), r["at"].alias("at"))

            return F.transform(in_word(word, opened(i)), placed)

        return F.when(last >= 0, F.flatten(F.transform(at, of_word))).otherwise(F.array().cast(FOUND))

    some = text.rlike(CANDIDATE) | text.rlike(NAMES + r"[\"']?\s*[:=]")
    return F.when(some, let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)).otherwise(F.array().cast(FOUND))


# --- the forest ---


def _split(rows: list[tuple], tried: list[int]) -> tuple[float, int, float] | None:
    """(gini decrease, feature, threshold) of the best split."""
    n, ones = len(rows), sum(r[-1] for r in rows)
    base = ones * (n - ones) / n
    best = None
    for f in tried:
        ordered = sorted((r[f], r[-1]) for r in rows)
        left = k = 0
        for k, (value, label) in enumerate(ordered[:-1], 1):
            left += label
            if ordered[k][0] == value:
                continue
            right = ones - left
            cost = left * (k - left) / k + right * (n - k - right) / (n - k)
            if base - cost > 1e-9 and (best is None or base - cost > best[0]):
                best = (base - cost, f, (value + ordered[k][0]) / 2)
    return best


def _tree(rows: list[tuple], depth: int, rng: random.Random):
    """A tree as nested (feature, threshold, left, right), with shares of label 1 as leaves."""
    ones = sum(r[-1] for r in rows)
    share = ones / len(rows)
    if depth == 0 or len(rows) < 2 * LEAF or ones in (0, len(rows)):
        return share
    found = _split(rows, rng.sample(range(len(FEATURES)), max(2, math.isqrt(len(FEATURES)) + 1)))
    if found is None:
        return share
    _, f, cut = found
    return f, cut, _tree([r for r in rows if r[f] <= cut], depth - 1, rng), _tree([r for r in rows if r[f] > cut], depth - 1, rng)


def forest(rows: list[tuple], trees: int = TREES) -> list:
    """Trees over bootstrap samples of rows (features in order, label last)."""
    rng = random.Random(2)
    return [_tree(rng.choices(rows, k=len(rows)), DEPTH, rng) for _ in range(trees)]


def vote(trees: list, row: Column) -> Column:
    """The forest's mean vote as one conditional expression over a struct of features."""

    def expression(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, cut, left, right = node
        return F.when(row[FEATURES[f]] <= F.lit(float(cut)), expression(left)).otherwise(expression(right))

    return sum((expression(t) for t in trees[1:]), expression(trees[0])) / len(trees) if trees else F.lit(0.0)


def labelled_findings(spark: SparkSession, rows: int = SAMPLE) -> DataFrame:
    """(text, before, path, label): findings of both kinds, made by rule from row numbers.

    A deployment replaces it by findings that people have labelled; the columns are the same.
    """
    base = spark.range(rows).select("id", F.md5(F.col("id").cast("string")).alias("h"), F.sha1(F.col("id").cast("string")).alias("s"), F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))).alias("b"))
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.pmod(F.xxhash64("id"), F.lit(len(x))) + 1).cast("int"))
    letters = F.translate(F.upper("b"), "+/=", "XYZ")
    names = pick('token = "', "password=", 'api_key: "', "secret=", 'auth token "', 'PASSWORD = "', "and token = ", "the password: ")
    plain = pick("the ", "see ", "it was ", "of the ", "in and ", "", "la de ", "un der ")
    spoken = pick("sha1 ", "commit ", "md5: ", "checksum=", "uuid: ", "build ", "card ", "version=", "etag: ", "order no ")
    word = F.concat(pick("version", "release", "document", "image", "section", "customer"), pick("version", "number", "page", "table", "chapter"), F.substring(F.regexp_replace("h", "[a-f]", ""), 1, 4))
    digits = F.substring(F.concat(F.regexp_replace("s", "[a-f]", ""), F.regexp_replace("h", "[a-f]", ""), F.lit("4929")), 1, 16)
    # Values that people make up or fill in behind an open assignment.
    opened = pick("password = ", "password: ", "secret = ", "the token: ", 'pwd= "', "auth credential: ", "passwd = ", "api_key = ")
    letters_only = F.substring(F.translate("s", "0123456789", "ghijkmnprs"), 1, 14)
    punctuated = F.concat(F.initcap(F.substring(F.regexp_replace("h", "[0-9]", ""), 1, 4)), pick("&", "!", "#", "?"), F.substring("s", 3, 5), pick("!", "$", "%", "*"))
    said = pick("required", "undefined", "getenv('SECRET')", "process.env.TOKEN", "settings.password", "request.token", "string", "changeme", "yourpassword", "example.com/login", "forgot-password", "resettoken")
    kinds = [
        (F.concat(F.lit("AKIA"), F.substring(letters, 1, 16)), pick("", "key ", "the ", "aws ", "is and ", "of "), 1),
        (F.when(F.col("id") % 24 < 12, F.col("s")).otherwise(F.upper("s")), names, 1),
        (F.substring("h", 1, 18), names, 1),
        (F.substring("b", 1, 40), names, 1),
        (F.concat(F.lit("ghp_"), F.substring(F.translate("b", "+/=", "abc"), 1, 36)), plain, 1),
        (F.col("s"), spoken, 0),
        (digits, pick("", "the ", "card ", "of ", "it is ", "no "), 0),
        (word, plain, 0),
        (F.concat(pick("your_", "example_", "insert_", "dummy_", "changeme_"), pick("token_", "key_", "secret_", "password_"), F.lit("here_123")), names, 0),
        (F.concat(F.repeat(F.substring("h", 1, 1), 18), F.lit("1")), names, 0),
        (F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 12)), spoken, 0),
        (F.concat(F.substring(F.regexp_replace("h", "[0-9]", ""), 1, 9), F.substring("h", 1, 3), F.lit("/page1/item")), plain, 0),
        (letters_only, opened, 1),
        (punctuated, opened, 1),
        (said, opened, 0),
        # The same as the third kind, but in places where such values are made up.
        (F.substring("h", 1, 18), names, 0),
    ]
    in_tests = len(kinds) - 1
    text, before, label = kinds[0][0], kinds[0][1], F.lit(kinds[0][2])
    for k, (t, b, y) in enumerate(kinds[1:], 1):
        this = F.col("id") % len(kinds) == k
        text, before, label = F.when(this, t).otherwise(text), F.when(this, b).otherwise(before), F.when(this, y).otherwise(label)
    made_up = (F.col("id") % len(kinds) == in_tests) | ((label == 0) & (F.pmod(F.xxhash64("s"), F.lit(3)) == 0))
    path = F.when(made_up, pick("tests/data", "docs/readme", "vendor/lib", "examples/login", "spec/fixtures")).otherwise(pick("src/app", "source3", "src0", "web/pages"))
    return base.select(text.alias("text"), before.alias("before"), path.alias("path"), label.alias("label"))


def trained(findings: DataFrame) -> list:
    """A forest from labelled findings; of more than SAMPLE rows, those with the least hashes."""
    rows = findings.where("text <> '' and label in (0, 1)").orderBy(F.xxhash64("text", "before", "path"), "text", "before").limit(SAMPLE)
    got = rows.select(features(F.col("text"), F.coalesce("before", F.lit("")), F.col("path")).alias("f"), "label").collect()
    return forest([(*(r.f[f] for f in FEATURES), r.label) for r in got]) if got else []


def scanned(text: Column, path: Column, trees: list) -> Column:
    """Array of structs (word, text, at, score) of a text's candidates."""
    return F.transform(
        candidates(text), lambda c: let(features(c["text"], c["before"], path), lambda f: F.struct(c["word"].alias("word"), c["text"].alias("text"), c["at"].alias("at"), vote(trees, f).alias("score")))
    )


def findings(docs: DataFrame, trees: list, path: str = "source") -> DataFrame:
    """(doc_id, word_no, length, fingerprint, score, is_secret): one row a candidate. Secrets themselves are not shown."""
    rows = docs.select("doc_id", F.explode(scanned(F.col("text"), F.col(path), trees)).alias("c"))
    return rows.select("doc_id", F.col("c.word").cast("bigint").alias("word_no"), F.length("c.text").cast("bigint").alias("length"), F.sha2("c.text", 256).alias("fingerprint"), F.col("c.score").alias("score"), (F.col("c.score") >= SECRET).alias("is_secret"))


def _marked(text: Column, secrets: Column) -> Column:
    """text with MARK in place of each of the secrets (structs word, at, text), where they stand and nowhere else."""

    def in_place(word: Column, own: Column) -> Column:
        step = lambda s: F.struct(s["at"].alias("at"), (s["at"] + F.length(s["text"])).alias("end"))
        spans = F.array_sort(F.transform(own, step))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
        # Secrets that overlap become one mark.
        merged = F.aggregate(
            spans, start,
            lambda a, s: F.when((s["at"] >= a["end"]) | (a["end"] == 0), F.struct(F.concat(a["out"], F.substring(word, a["end"] + 1, F.greatest(s["at"] - a["end"], F.lit(0))), F.lit(MARK)).alias("out"), s["end"].alias("end")))
            .otherwise(F.struct(a["out"].alias("out"), F.greatest(a["end"], s["end"]).alias("end"))),
            lambda a: F.concat(a["out"], F.substring(word, a["end"] + 1, F.length(word))),
        )
        return F.when(F.size(own) > 0, merged).otherwise(word)

    def rebuilt(both: Column) -> Column:
        marked = F.transform(both["words"], lambda w, k: in_place(w, F.filter(secrets, lambda s: s["word"] == k)))
        return F.array_join(F.zip_with(both["gaps"], marked, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

    return let(F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.split(text, WORD, -1).alias("gaps")), rebuilt)


def redacted(docs: DataFrame, trees: list, path: str = "source") -> DataFrame:
    """docs with each secret in the text replaced by MARK where it was found."""
    secrets = F.filter(F.col("_found"), lambda c: c["score"] >= SECRET)
    text = F.when(F.size(secrets) > 0, _marked(F.col("text"), secrets)).otherwise(F.col("text"))
    out = docs.withColumn("_found", scanned(F.col("text"), F.col(path), trees)).withColumn("text", text).drop("_found")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents, scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return findings(docs, trained(labelled_findings(spark)))
