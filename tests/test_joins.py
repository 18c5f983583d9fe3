"""Joins on nested cells and on the index of patterns, against nested loops."""

import random
import re

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from docgrid.operators import layout, spatial
from docgrid.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_boxes(rng, n, spread):
    out = []
    for k in range(n):
        w, h = (rng.choice([0, 0.0001, 1, 3.9, 4, 50, 1000, 1e6]) for _ in range(2))
        x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        out.append((k, k % 3, x, y, x + w, y + h))
    return [*out, (900, 0, None, 0.0, 1.0, 1.0), (901, 0, 5.0, 5.0, 1.0, 1.0), (902, 1, -1e300, -1e300, 1e300, float("inf")), (903, 2, 0.0, 0.0, 0.0, 0.0), (903, 2, 0.0, 0.0, 0.0, 0.0)]


COLUMNS = "id int, g int, l double, b double, r double, t double"


@pytest.mark.parametrize("most", [None, 5])
def test_range_join_of_all_widths(spark, most):
    rng = random.Random(5)
    boxes = spark.createDataFrame(some_boxes(rng, 90, 60), COLUMNS)
    points = spark.createDataFrame([(i, i % 3, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(150)] + [(990, 2, 0.0, 0.0), (991, 1, None, 0.0), (992, 1, 1e299, 1e18)], "p int, g int, x double, y double")
    found = spatial.range_join(points, boxes, "x", "y", ["g"], most=most)
    wanted = points.join(boxes, "g").where("x between l and r and y between b and t")
    assert set(found.columns) == set(wanted.columns)
    assert rows(found.select("p", "id")) == rows(wanted.select("p", "id")) and found.count() > 100
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    out = spatial.outside(points, boxes, "x", "y", ["g"])
    assert rows(out) == rows(points.join(wanted.select("p").distinct(), "p", "left_anti").select(*points.columns))
    assert spatial.range_join(points, boxes.limit(0), "x", "y").count() == 0


@pytest.mark.parametrize("most", [None, 7])
def test_box_join_of_all_widths(spark, most):
    rng = random.Random(6)
    box = lambda n: F.struct("l", "b", "r", "t").alias(n)
    a = spark.createDataFrame(some_boxes(rng, 60, 200), COLUMNS).select(F.col("id").alias("i"), "g", box("box"))
    b = spark.createDataFrame(some_boxes(rng, 70, 200), COLUMNS).select(F.col("id").alias("j"), "g", box("other"))
    hit = F.expr("box.l <= other.r and other.l <= box.r and box.b <= other.t and other.b <= box.t")
    for keys in ([], ["g"]):
        found = spatial.box_join(a, b, keys, most=most)
        wanted = (a.join(b, keys) if keys else a.join(b.drop("g"))).where(hit)
        assert rows(found.select("i", "j")) == rows(wanted.select("i", "j")) and found.count() > 100
        assert "NestedLoop" not in plan(found)


def test_a_box_of_any_width_is_cut_into_few_rows(spark):
    wide = spark.createDataFrame([(k, 0.3 * 10.0**k) for k in range(-3, 10)], "k int, w double").withColumn("own", spatial.cell_level(F.col("w"), spatial.FINEST))
    cut = spatial._cut(wide.withColumn("l", F.lit(-0.1)).withColumn("r", F.col("l") + F.col("w")), F.col("l"), F.col("r"), F.col("own"), "c", spatial.FINEST)
    assert cut.groupBy("k").count().agg(F.max("count")).first()[0] <= 2


def test_link_ranges_without_end(spark):
    chars, links = spark.range(50).toDF("i"), spark.createDataFrame([(10, 2_000_000_000, "a", 1), (20, 22, "b", 2), (7, 7, "c", 3)], "lo bigint, hi bigint, url string, ord int")
    got = dict(rows(layout.linked(chars, links, "i").select("i", "url")))
    assert got == {i: "b" if i in (20, 21) else "a" for i in range(10, 50)}


def test_no_query_over_ranges_is_a_nested_loop(spark):
    for name in ("q13_wildcard_semi_join", "q27_rect_contains_join", "q79_link_ranges", "q82_objects_minus_covered", "q86_border_lookup", "q97_regex_semi_anchored", "q117_box_join", "q170_nested_ranges", "q171_nested_boxes", "q172_exclusive_patterns"):
        assert "NestedLoop" not in plan(QUERIES[name](spark, SF)) and "Cartesian" not in plan(QUERIES[name](spark, SF)), name


# --- patterns ---

PATTERNS = ["abc", "ab?c", "a(bc)?d", "(abc)+", "a|bc", "[abc]d", "[^a]b+c", "abcd", "x..y", "^ab", "cd$", ".", "a{2}", "ba{0,1}c", r"\d\d", r"a\.b", r"\Qa.b\E", "(?:ab)c", "(?:ab)?c", "ab*", "a+?b", r"[\]a]b", "[a[b]c]d", "(?i)AB", "É", "aÉb", "c[bd]{2}a", r"\bab", "dd{1,}a", "bb}", "AbC", "d.*b.*a", "", "zzz", "+"[:0] + "a++b"]


def test_literals_are_sure(spark):
    df = spark.createDataFrame([(p,) for p in PATTERNS], "p string").select("p", spatial.literal_runs(F.col("p")).alias("r"))
    found = dict(tuple(x) for x in df.collect())
    assert found["abc"] == ["abc"] and found["ab?c"] == ["a", "c"] and found["a|bc"] == [] and found["x..y"] == ["x", "y"] and found["[abc]d"] == ["d"]
    assert found["a(bc)?d"] == [] and found["ba{0,1}c"] == ["b", "c"] and found["(?:ab)c"] == ["ab", "c"] and found["c[bd]{2}a"] == ["c", "a"] and found["dd{1,}a"] == ["d", "a"]


@pytest.mark.parametrize(("anchored", "ignore_case"), [(False, False), (True, False), (False, True)])
def test_pattern_join_equals_nested_loop(spark, anchored, ignore_case):
    rng = random.Random(9)
    texts = ["".join(rng.choices("aabbccddxyz1.ÉéAB}", k=rng.randint(0, 9))) for _ in range(300)] + [None, "", "abc", "abc", "xÉb aÉb"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    patterns = spark.createDataFrame([(p, n) for n, p in enumerate(PATTERNS)] + [(None, 99)], "p string, n int")
    form = f"t rlike concat('{'(?i)' * ignore_case}{'^' * anchored}(?:', p, ')')"
    wanted = df.join(patterns, F.expr(form))
    for how in ("inner", "left", "left_semi", "left_anti"):
        found = spatial.pattern_join(df, patterns, "t", "p", how, anchored, ignore_case)
        names = ["k"] if "_" in how else ["k", "n"]
        assert rows(found.select(names)) == rows(df.join(patterns, F.expr(form), how).select(names)), how
    assert wanted.count() > 300
    assert spatial.pattern_join(df, patterns.limit(0), "t", "p").count() == 0


def test_patterns_take_devices_in_turn(spark):
    rng = random.Random(4)
    devices = sorted({"stm32" + "".join(rng.choices("fgl", k=1) + rng.choices("0123", k=2) + rng.choices("ab", k=2)) + rng.choice(["", "@m4", "@m7"]) for _ in range(200)})
    stems = sorted({"STM32" + "".join(rng.choices("FGL", k=1) + rng.choices("0123x", k=2) + rng.choices("xAB", k=rng.randint(0, 3))) + rng.choice(["", "", "_CM4"]) for _ in range(60)} | {"STM32F", "STM32Fx", "STM32Gxxx"})
    order = sorted(stems, key=lambda s: (-len(n := re.sub("x+$", "", s)), n.count("x"), n.index("x") if "x" in n else 0, n, s))
    left, wanted = set(devices), {}
    for stem in order:
        form = re.sub("x+$", "", stem).replace("x", ".").replace("_CM", ".*?@m").replace("...A", ".....A")
        taken = {d for d in left if re.match(form, d, re.I)}
        left -= taken
        wanted |= dict.fromkeys(taken, stem)
    found = spatial.devices_of_files(spark.createDataFrame([(d,) for d in devices], "d string"), spark.createDataFrame([(s,) for s in stems], "s string"), "d", "s")
    assert dict(rows(found)) == wanted and len(set(wanted.values())) > 10
