"""Words and phrases found in texts, against plain loops."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docgrid.operators import search


@pytest.mark.parametrize("case_sensitive", [True, False])
def test_phrases_equal_plain_search(spark, case_sensitive):
    rng = random.Random(1)
    signs = ["the", "The", "of", "a", "New", "york", "x_1", "é", "É", "rare", "zz"]
    texts = [(k, "".join(rng.choice(signs) + rng.choice([" ", ", ", "\n", "-", "  "]) for _ in range(rng.randint(0, 40)))) for k in range(80)] + [(90, None), (91, ""), (5, "a of the"), (5, "the of a"), (None, "the of the of the"), (92, "rare " * 3000)]
    phrases = sorted({" ".join(rng.choices(signs, k=rng.randint(1, 5))) for _ in range(150)} | {"", " - ", "unknown", "the unknown", "new  york", "rare rare rare", "the of the", None}, key=repr)
    fold = (lambda x: x) if case_sensitive else str.lower
    words = lambda x: re.findall(r"\w+", fold(x or ""))
    held = [(d, words(x)) for d, x in texts]
    wanted = {(d, p, i) for d, h in held for p in phrases if (w := words(p)) for i in range(len(h) - len(w) + 1) if h[i : i + len(w)] == w}
    docs = spark.createDataFrame([(d, x, 1) for d, x in texts], "k int, txt string, _words int")
    found = search.found_phrases(docs, spark.createDataFrame([(p,) for p in phrases], "p string"), "k", "txt", "p", case_sensitive)
    assert rows(found) == sorted(wanted, key=repr) and len(wanted) > 3000
    assert search.found_phrases(docs.limit(0), spark.createDataFrame([("a",)], "p string"), "k", "txt", "p").count() == 0
    assert search.found_phrases(docs, spark.createDataFrame([], "p string"), "k", "txt", "p").count() == 0


@pytest.mark.parametrize("word", ["aa", "a a", "x.y", "", "é", "A"])
@pytest.mark.parametrize("case_sensitive", [True, False])
def test_words_on_pages(spark, word, case_sensitive):
    rng = random.Random(word)
    pages = ["aa aaa aa", "ba a a", "a a a a a", "x.y xzy x.yx", "É é", "", *("".join(rng.choices("aab .xyé", k=60)) for _ in range(20))]
    chars = spark.createDataFrame([(p, 10 * i, c) for p, t in enumerate(pages) for i, c in enumerate(t)], "page int, idx int, char string")
    wanted = []
    for p, t in enumerate(pages):
        found = re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", t, 0 if case_sensitive else re.I) if word else []
        wanted += [(p, n, 10 * m.start(), 10 * (m.end() - 1)) for n, m in enumerate(found)]
    assert rows(search.found_words(chars, ["page"], word, case_sensitive)) == sorted(wanted, key=repr)


def test_phrases_are_joined_by_words(spark):
    docs = spark.createDataFrame([(1, "a b c")], "k int, t string")
    plan = search.found_phrases(docs, docs.select(F.col("t").alias("p")), "k", "t", "p")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_phrases_meet_texts_by_runs_of_words(spark, monkeypatch):
    """Phrases that share a word do not meet every place of that word: only the runs found are written and joined."""
    docs = spark.range(40).selectExpr("id as k", "concat_ws(' ', transform(sequence(0, 199), i -> concat('the w', (id * 200 + i) % 997))) as t")
    phrases = spark.range(500).selectExpr("concat('w', id, ' the w', id + if(id % 2 = 0, 1, 2)) as p")
    tables = []
    monkeypatch.setattr(search, "written", lambda df, w=search.written: tables.append(w(df)) or tables[-1])
    found = search.found_phrases(docs, phrases, "k", "t", "p")
    runs = [f"the w{(k * 200 + i) % 997}".split() for k in range(40) for i in range(200)]
    ids = [int(r[1][1:]) for r in runs]
    wanted = [(n // 200, f"w{a} the w{b}", 2 * (n % 200) + 1) for n, (a, b) in enumerate(zip(ids, ids[1:])) if n % 200 < 199 and b == a + 1 and a < 500 and a % 2 == 0]
    assert rows(found) == sorted(wanted, key=repr) and len(wanted) > 1000
    assert len(wanted) <= next(t for t in tables if "_pos" in t.columns).count() < 1.05 * len(wanted)
