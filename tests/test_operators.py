"""Operators that no query over the tables reaches."""

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgrid.functions import geometry, numbers, rules
from docgrid.operators import evaluate, graph, layout, memmap, sequence, spatial, tree
from docgrid.sources import catalog, headers, html
from docgrid.streaming import ingest

C, L = F.col, F.lit


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_rules(spark):
    r = one(spark, a=rules.replaced(L("<b>x</b> <sup>2</sup>"), sup="^$1", x="y"), b=rules.listify(L("a, b/c<br>d,,")), c=rules.wildcard_regex(L("STM+x")), d=rules.fan_out(L("CH12"), "CH"), e=rules.slug(L("Été: A-B")))
    assert one(spark, x=rules.listify(L("x0, a1,  b2/c3"))).x == ["x0", "a1", "b2", "c3"]
    assert r.a == "y ^2" and r.b == ["a", "b", "c", "d"] and r.c == "stm[srqp]." and r.d == ["CH1", "CH2"] and r.e == "t_a_b"


def test_redict_cardinality(spark):
    m = F.create_map(L("Pin name"), L("1"), L("Pin type"), L("2"))
    r = one(spark, a=rules.match_value(m, "name"), b=rules.match_value(m, "zzz", L("d")), c=rules.match_key(m, "TYPE"), d=rules.match_key(m, "pin", L("none")))
    assert tuple(r) == ("1", "d", "Pin type", "none")
    for bad in (rules.match_value(m, "pin"), rules.match_key(m, "zzz")):
        with pytest.raises(Exception, match="match"):
            one(spark, x=bad)


def test_numbers(spark):
    r = one(spark, a=numbers.from_hex(L("0x1F")), b=numbers.bit_range(L("9-15")), c=numbers.bit_range_compat(L("31-16")), d=numbers.bit_range_compat(L("15-9")), e=numbers.mask_width(L(0b111000)), f=numbers.linear_offset(L("0x10 + x*4"), L(3)), g=numbers.linear_offset(L("4*x"), L(5)), h=numbers.from_hex(L("zz")))
    assert r.a == 31 and r.b == list(range(9, 16)) and r.c == list(range(16, 31)) and r.d == [] and r.e == 3 and r.f == 28 and r.g == 20 and r.h is None


@given(st.recursive(st.integers(0, 99).map(str), lambda x: st.tuples(x, st.sampled_from(["+", "*", "|", "&", "<<"]), st.integers(0, 5).map(str)).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=5))
def test_evaluate_equals_python(text):
    assert numbers.evaluate(text) == eval(text)


def test_evaluate_names():
    assert numbers.evaluate("((uint32_t)A << 2) | 1UL", {"A": "B + 1", "B": 3}) == 17
    for text, value in {"-7/2": -3, "-7%2": -1, "010": 8, "1 ? 2 : 3": 2, "0 ? 1/0 : 4": 4, "3 > 2 && 2 >= 3": 0, "1 || 1/0": 1, "!5 == 0": 1, "1 << 3 + 1": 16, "(uint8_t)0x1FF": 255, "(int8_t)255": -1, "-1 < 0u": 0, "0u - 1": 2**64 - 1, "7 & 3 == 3": 1, "0x8000000000000000 >> 63": 1, "-8 >> 1": -4, "(DMA_T + 2) * 2UL": 6}.items():
        assert numbers.evaluate(text, {"DMA_T": 1}) == value, text
    assert numbers.evaluate_uint64("~0") == 2**64 - 1
    for bad in ("A", "1 +", "os.system(1)", "(1", "1 << 64", "08", "1.5", "1 ? 2"):
        with pytest.raises(ValueError):
            numbers.evaluate(bad, {"A": "A"})


def grid_of(text):
    table = next(i for i in html.parse(text) if i["type"] == "table")
    return html.dense_grid(table["cells"]), table["cells"]


def test_html_edges():
    types = lambda t: [(i["type"], i["html"]) for i in html.parse(t)]
    assert types("") == [] and types(None) == []
    assert types("<p>a<br>b<i class=x>c</i></p>") == [("text", "a<br>b<i>c</i>")]
    assert types("before<h1>T</h1><p><b>open<p>next") == [("text", "before"), ("heading", "T"), ("text", "<b>open</b>"), ("text", "next")]
    assert types("<script>var t='</p>';</script><style>p{}</style><p>x</p>") == [("text", "x")]
    assert types("<table></table><table><tr><td>(omitted)</td></tr></table>") == []
    found = html.parse("<table><caption>C</caption><tr><td>1</table>")
    assert [i["type"] for i in found] == ["text", "table"] and found[1]["heading"] is None


def test_html_spans():
    (grid, hrows), cells = grid_of("<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><th>C</th><th>D</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>")
    assert [[cells[k]["html"] for k in row] for row in grid] == [["A", "B", "B"], ["A", "C", "D"], ["1", "2", "3"]] and hrows == 2


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_grid_round_trip(height, width, data):
    """A random tiling of a grid by cells comes back from its HTML."""
    want = [[None] * width for _ in range(height)]
    lines, n = [], 0
    for y in range(height):
        cells = []
        for x in range(width):
            if want[y][x] is None:
                free = 1
                while x + free < width and want[y][x + free] is None:
                    free += 1
                w = data.draw(st.integers(1, free))
                h = data.draw(st.integers(1, height - y))
                for j in range(h):
                    for i in range(w):
                        want[y + j][x + i] = n
                cells.append(f"<td colspan={w} rowspan={h}>{n}</td>")
                n += 1
        lines.append("<tr>" + "".join(cells) + "</tr>")
    (grid, _), cells = grid_of("<table>" + "".join(lines) + "</table>")
    assert [[int(cells[k]["html"]) for k in row] for row in grid] == want


def test_range_join_equals_nested_loop(spark):
    p = spark.range(300).select("id", ((C("id") * 37) % 100).cast("double").alias("x"), ((C("id") * 53) % 90).cast("double").alias("y"))
    b = spark.range(20).select(C("id").alias("k"), (C("id") * 7 % 80).cast("double").alias("l"), (C("id") * 11 % 70).cast("double").alias("b")).withColumns({"r": C("l") + C("k"), "t": C("b") + 15})
    assert rows(spatial.range_join(p, b, "x", "y", cell=5.0).select("id", "k")) == rows(p.join(b, F.expr("x between l and r and y between b and t")).select("id", "k"))


def test_geometry(spark):
    b = F.struct(L(0.0).alias("l"), L(0.0).alias("b"), L(10.0).alias("r"), L(4.0).alias("t"))
    o = F.struct(L(-1.0).alias("l"), L(1.0).alias("b"), L(11.0).alias("r"), L(2.0).alias("t"))
    r = one(spark, a=geometry.overlaps_corner(b, o), b=geometry.intersects(b, o), c=geometry.joined(b, o), d=geometry.contains_box(b, o), e=geometry.in_disc(L(0), L(0), L(2), L(0), L(1), L(0.5)), f=geometry.glyph_rotation(L(90), L(90)), g=geometry.midpoint(b)[0], h=geometry.regions_overlap(L(0), L(1), L(1), L(2)), i=geometry.regions_overlap(L(0), L(1), L(1), L(2), 0.1), j=geometry.offset(b, L(1), L(2)))
    assert (r.a, r.b, tuple(r.c), r.d, r.e, r.f, r.g, r.h, r.i, tuple(r.j)) == (False, True, (-1, 0, 11, 4), False, True, 0, 5.0, False, True, (-1, -2, 11, 6))


def test_ordered_folds(spark):
    d = spark.createDataFrame([("a", 0.0, 2.0), ("a", 5.0, 6.0), ("a", 1.0, 5.5), ("b", 0.0, 1.0)], "k string, lo double, hi double")
    assert rows(layout.first_fit_clusters(d, ["k"], "k string, lo double, hi double").select("k", "lo", "cluster")) == [("a", 0.0, 0), ("a", 1.0, 0), ("a", 5.0, 0), ("b", 0.0, 0)]
    g = spark.createDataFrame([(1, 10.0, 2.0, 0.0), (1, 10.2, 2.0, 5.0), (1, 3.0, 2.0, 1.0)], "p int, origin double, height double, x double")
    assert [r[0] for r in sorted(layout.merged_lines(g, ["p"], "p int, origin double, height double, x double").select("line", "origin").collect(), key=lambda r: -r[1])] == [0, 0, 1]
    c = spark.createDataFrame([(1, 0, 0, 1.0, 0.0), (1, 0, 1, 1.0, 1.0), (1, 1, 0, 1.0, 1.0), (1, 1, 1, 0.0, 1.0)], "k int, y int, x int, r double, t double")
    assert rows(layout.merged_spans(c, ["k"], "k int, y int, x int, r double, t double").select("y", "x", "cell")) == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    w = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, 0.0, 1.0), (1, 0, 1, 2.0, 1.0, 1.0, 1.0)], "k int, y int, x int, l double, b double, r double, t double")
    # Closed above, but the place on the right is no span: the border between them is closed for both.
    assert rows(layout.repaired_borders(w, ["k"], w.schema.simpleString()[7:-1].replace(":", " ")).select("x", "l", "r")) == [(0, 1.0, 0.0), (1, 2.0, 1.0)]
    lines = spark.createDataFrame([(1, 1.0), (1, 1.4), (1, 9.0)], "k int, at double")
    assert rows(layout.grid_lines(lines, ["k"], "at", 2.0)) == [(1, 0, 1.0), (1, 1, 9.0)]


def test_layout_joins(spark):
    cap = spark.createDataFrame([(1, 1, 0.0, 5.0, 10.0), (1, 2, 6.0, 9.0, 10.0)], "doc int, cap int, l double, r double, y double")
    gr = spark.createDataFrame([(1, 7, 0.0, 5.0, 9.0), (1, 8, 0.0, 9.0, 4.0)], "doc int, graphic int, gl double, gr double, top double")
    assert rows(layout.captioned(cap, gr, ["doc"]).select("cap", "graphic")) == [(1, 7), (2, 8)]
    pages = spark.createDataFrame([("d", 0, 100.0, 200.0), ("d", 1, 100.0, 200.0)], "doc string, page int, width double, height double")
    t = spark.createDataFrame([("default", "head", 0.0, 0.9, 1.0, 1.0, True), ("default", "body", 0.1, 0.1, 0.9, 0.9, False)], "template string, area string, fl double, fb double, fr double, ft double, first_page_only boolean")
    assert rows(layout.areas(pages, t, L("default")).select("page", "area", "l", "t")) == [(0, "body", 10.0, 180.0), (0, "head", 0.0, 200.0), (1, "body", 10.0, 180.0)]


def test_tree(spark):
    lines = spark.createDataFrame([(1, 0, "1.2 Title"), (1, 1, "• a"), (1, 2, "• b"), (1, 3, "Table 1. x"), (1, 4, "Note: y"), (1, 5, "text")], "doc bigint, ord int, text string")
    kinds = lines.withColumn("name", tree.line_kind(C("text")))
    assert [r.name for r in kinds.orderBy("ord").collect()] == ["heading", "listb", "listb", "caption", "note", "para"]
    assert one(spark, d=tree.heading_depth(L("1.2 Title"))).d == 3
    assert rows(tree.list_groups(kinds, ["doc"], "ord").select("first", "name", "members")) == [(1, "listb", 2)]
    assert {r.section for r in tree.sections(kinds, ["doc"], "ord").collect()} == {0}
    n = spark.createDataFrame([(1, 0, None, 0, "para", None, "p"), (1, 1, 0, 0, "text", None, "only"), (1, 2, None, 1, "caption", None, "c"), (1, 3, None, 2, "table", None, "t")], "doc bigint, node bigint, parent bigint, ord int, name string, depth int, text string")
    assert rows(tree.collapsed(n).select("node", F.coalesce("parent", L(-1)))) == [(1, -1), (2, -1), (3, -1)]
    assert rows(tree.attached_captions(n, ["doc"], "ord").select("node", "target")) == [(2, 3)]
    assert rows(tree.at_depth(n, 1).select("node", "level")) == [(0, 0), (1, 1), (2, 0), (3, 0)]
    assert tree.serialised(n).first().html.startswith("<html><body><p>p<div>only</div></p>")
    assert tree.styled([("a", frozenset("b")), ("c", frozenset("bi")), ("d", frozenset())]) == "<b>a<i>c</i></b>d"


def test_memory_map(spark):
    c = spark.createDataFrame([("d", 1, ["a"]), ("d", 2, ["a", "b"]), ("e", 3, ["a"]), ("e", 4, ["b"])], "k string, id int, f array<string>")
    assert rows(memmap.best_match(c, ["k"], "f").select("k", "id", "ambiguous")) == [("d", 2, False), ("e", 3, True), ("e", 4, True)]
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 1)], "dev string, r int")
    assert rows(memmap.deduplicated(t, "dev", "r").select("dev", F.array_join("compatible", ","))) == [("a", "a,b"), ("c", "c")]
    ch = spark.createDataFrame([("d", 0, "DMA"), ("d", 8, "CH1"), ("d", 100, "DMB"), ("d", 104, "CH1")], "dev string, addr int, name string")
    assert rows(memmap.folded(ch, "dev", "addr", C("name").startswith("DM"), "name").select("addr", "parent", "delta"))[1] == (100, "DMB", 0)
    big = memmap.bit_addresses(spark.createDataFrame([(0xFFFFFFF0, 15, 7)], "paddr bigint, offset int, position int")).first()
    assert big.bit_address == 0xFFFFFFFF * 8 + 7
    types = spark.createDataFrame([("T", 4)], "type string, size int")
    inst = spark.createDataFrame([("A", "T"), ("B", "U")], "name string, t string")
    ok, missing = memmap.materialised(inst, types, "t", "type")
    assert rows(ok.select("name")) == [("A",)] and rows(missing) == [("B", "U")]


def test_svd_files(spark, tmp_path):
    d = spark.createDataFrame([("P", "0x10")], "name string, baseAddress string")
    memmap.write_svd(d, str(tmp_path / "svd"))
    assert memmap.read_svd(spark, str(tmp_path / "svd"), "name string, baseAddress string").collect() == d.collect()


def test_graph(spark, tmp_path):
    types = spark.createDataFrame([("AF", "Signal"), ("XF", "AF")], "child string, parent string")
    g = spark.createDataFrame([("a", "type", "AF"), ("b", "type", "XF"), ("c", "type", "Pin")], "subject string, predicate string, object string")
    assert rows(graph.instances(g, types, "Signal")) == [("a",), ("b",)]
    graph.save(g, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).where("predicate = 'type'").count() == 3


def test_evaluate(spark):
    wide = spark.createDataFrame([(1, "UART", "USART", None), (2, "A", "B", "A"), (3, "A", "A", "A")], "k int, a string, b string, c string")
    got = {r.k: (r.present, r.conflict, r.identical) for r in evaluate.agreement(wide, ["a", "b", "c"]).collect()}
    assert got == {1: (2, True, False), 2: (3, True, False), 3: (3, False, True)}
    # One name is part of the other: no conflict.
    assert one(spark, x=rules.contains_each_other(F.array(L("USART1"), L("USART")))).x
    assert abs(one(spark, x=evaluate.after_vote(L(10.0), L(12.0), L(1.0))).x + 0.1) < 1e-9


def test_catalog(spark, tmp_path):
    row = lambda t, v: (t, "", "", v, "", "")
    a = spark.createDataFrame([row("DS1", "9.0"), row("DS1", "10.0"), row("RM2", "1.1")], catalog.SCHEMA)
    b = spark.createDataFrame([row("DS1", "9.0")], catalog.SCHEMA)
    assert rows(catalog.new_documents(a, b).select("filename")) == [("DS1-v10.pdf",), ("RM2-v1_1.pdf",)]
    assert [r.version for r in catalog.latest(a, "title", "version").orderBy("title").collect()] == ["10.0", "1.1"]
    assert [r.version for r in catalog.latest(a, "title", "version", lexicographic=True).orderBy("title").collect()] == ["9.0", "1.1"]
    assert catalog.local(spark, str(tmp_path / "none")).count() == 0
    catalog.store(a, str(tmp_path / "cat"))
    assert rows(catalog.local(spark, str(tmp_path / "cat"))) == rows(a)
    with pytest.raises(Exception, match="several values"):
        catalog.unique_mapping(a, "title", "version").collect()


def test_folder_and_headers(spark, tmp_path):
    d = tmp_path / "DS1-v2"
    d.mkdir()
    (d / "chapter_3_Pin_out.html").write_text("<h1>x</h1>")
    r = html.folder(spark, str(tmp_path)).first()
    assert (r.name, r.version, r.chapter, r.number) == ("DS1", "2", "chapter 3 Pin out", 3)
    (tmp_path / "a.h").write_text("#define BASE (0x40UL) /* c */\n#define DMA_BASE (BASE + 0x10)\n#define DMA ((DMA_T *) DMA_BASE)\n#if defined(STM32F1) || defined(STM32F2)\nX_IRQn = 5,\n")
    f = headers.scan(spark, str(tmp_path))
    assert ("a.h", "DMA_BASE", 80) in rows(headers.values(headers.defines(f)))
    assert rows(headers.pointers(f)) == [("a.h", "DMA", "DMA_T", "DMA_BASE")]
    assert rows(headers.enumerators(f)) == [("a.h", "X", 5)]
    assert f.select(headers.conditionals(C("text"), "STM32")).first()[0] == ["STM32F1", "STM32F2"]


def test_closure_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "c int, p int")
    assert rows(graph.closure(chain, "c", "p")) == sorted([(i, j) for i in range(12) for j in range(i + 1, 13)], key=repr)
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (None, 5)], "c int, p int")
    assert rows(graph.closure(ring, "c", "p")) == sorted([(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)])


def test_prefix_join_kinds(spark):
    d = spark.createDataFrame([(1, "abc"), (2, "xyz"), (3, None), (4, "abc"), (5, "a")], "k int, t string")
    p = spark.createDataFrame([("ab",), ("abc",), ("zz",)], "pre string")
    assert rows(spatial.prefix_join(d, p, "t", "pre").select("k", "pre")) == [(1, "ab"), (1, "abc"), (4, "ab"), (4, "abc")]
    left = spatial.prefix_join(d, p, "t", "pre", "left")
    assert {(r.k, r.pre) for r in left.collect()} == {(1, "ab"), (1, "abc"), (2, None), (3, None), (4, "ab"), (4, "abc"), (5, None)}
    assert rows(spatial.prefix_join(d, p, "t", "pre", "left_semi").select("k")) == [(1,), (4,)]
    assert rows(spatial.prefix_join(d, p, "t", "pre", "left_anti").select("k")) == [(2,), (3,), (5,)]


def test_box_join_equals_nested_loop(spark):
    box = lambda x, y, w, h: F.struct(x.alias("l"), y.alias("b"), (x + w).alias("r"), (y + h).alias("t"))
    n = lambda k, m: ((C("id") * k) % m).cast("double")
    a = spark.range(60).select((C("id") % 3).alias("g"), C("id").alias("i"), box(n(37, 100), n(53, 90), n(7, 30), n(5, 20)).alias("box"))
    b = spark.range(50).select((C("id") % 3).alias("g"), C("id").alias("j"), box(n(29, 100), n(31, 90), n(11, 40), n(3, 25)).alias("other"))
    want = a.join(b, "g").where("box.l <= other.r and other.l <= box.r and box.b <= other.t and other.b <= box.t")
    got = spatial.box_join(a, b, ["g"], cell=16.0)
    assert rows(got.select("i", "j")) == rows(want.select("i", "j")) and got.count() > 20


def test_appended_tables(spark):
    d = spark.createDataFrame([(doc, t, y) for doc in (1, 2) for t in (5, 7, 9) for y in range(t - 3)], "doc int, tab int, y int")
    want = [(doc, t, {5: 0, 7: 2, 9: 6}[t] + y) for doc in (1, 2) for t in (5, 7, 9) for y in range(t - 3)]
    assert rows(layout.appended(d, ["tab"], "y", within=["doc"]).select("doc", "tab", "y")) == sorted(want, key=repr)
    assert rows(layout.appended(d.where("doc = 1"), ["tab"], "y").select("doc", "tab", "y")) == sorted([w for w in want if w[0] == 1], key=repr)


def test_streaming_remembers_keys_without_state(spark, tmp_path):
    src, run = str(tmp_path / "in"), lambda: ingest.ingest(spark, src, "k bigint, v bigint", C("v") > 0, "k", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    for batch in ([(1, 5), (2, -1)], [(1, 6), (2, 7), (3, 8), (3, 8)]):
        spark.createDataFrame(batch, "k bigint, v bigint").coalesce(1).write.mode("append").parquet(src)
        run()
    assert rows(spark.read.parquet(str(tmp_path / "good")).select("k", "v")) == [(1, 5), (3, 8)]
    assert rows(spark.read.parquet(str(tmp_path / "bad")).select("k")) == [(2,)]


def test_windowed_counts(spark, tmp_path):
    e = spark.createDataFrame([("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:00:50"), ("b", "2024-01-01 00:01:10")], "k string, at string").select("k", C("at").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    counts = ingest.windowed_counts(spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "e")), "at", ["k"], "1 minute", "1 minute")
    q = counts.select("k", "n", C("window.start").cast("string").alias("start")).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("windowed")) == [("a", 2, "2024-01-01 00:00:00"), ("b", 1, "2024-01-01 00:01:00")]


def test_streaming_ingest(spark, tmp_path):
    src = str(tmp_path / "in")
    pd.DataFrame({"k": [1, 1, 2, 3], "v": [5, 5, -1, 7]}).to_parquet(f"{tmp_path}/x.parquet")
    spark.read.parquet(f"{tmp_path}/x.parquet").write.parquet(src)
    q = ingest.ingest(spark, src, "k bigint, v bigint", C("v") > 0, "k", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "good")).select("k")) == [(1,), (3,)]
    assert rows(spark.read.parquet(str(tmp_path / "bad")).select("k")) == [(2,)]


def test_sequence_segments(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 1.0, 2.0)], "k int, i int, x double, y double")
    assert rows(sequence.segments(p, ["k"], "i", "x", "y").select("x", "y", "x1", "y1")) == [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 2.0)]


def test_split_windows_equal_whole_ones(spark):
    rng = np.random.default_rng(5)
    data = [(int(rng.integers(0, 3)), int(i // 7), int(i), None if rng.random() < 0.1 else str(rng.integers(0, 2)), float(rng.integers(0, 9) + i * 3)) for i in range(300)]
    d = spark.createDataFrame(data, "k int, bucket int, i int, v string, at double")
    whole = {r.i: r.island for r in sequence.runs(d, ["k"], ["i"], "v").collect()}
    assert {r.i: r.island for r in sequence.split_islands(d, ["k"], "bucket", ["i"], "v", lambda p, v: p != v).collect()} == whole
    gaps = {r.i: r.cluster for r in sequence.gap_clusters(d, ["k"], ["i"], C("at"), 9.0).collect()}
    assert {r.i: r.cluster for r in sequence.split_islands(d, ["k"], "bucket", ["i"], "at", lambda p, v: v - p >= 9.0, out="cluster").collect()} == gaps
    parents = {r.i: r.p for r in d.select("i", sequence.asof_parent(C("v") == "1", C("i"), sequence.ordered(["k"], "i")).alias("p")).collect()}
    assert {r.i: r.parent for r in sequence.split_asof(d, ["k"], "bucket", ["i"], C("v") == "1", C("i")).collect()} == parents


def test_small_helpers(spark):
    r = one(spark, a=rules.renumbered(L("ADC12_IN3"), r"^(ADC\d+_IN)(\d+)()$", lambda n: n + 1), b=rules.renumbered(L("x"), r"^(ADC)(\d+)()$", lambda n: n))
    assert (r.a, r.b) == ("ADC12_IN4", "x") and html.unescaped("a&amp;b&lt;") == "a&b<"
    r = one(spark, a=evaluate.percent(L(1), L(3)), b=evaluate.percent(L(1), L(0)))
    assert (r.a, r.b) == (33.3, None)
    n = spark.createDataFrame([(1, 5, None, "b"), (1, 6, None, "a"), (1, 7, 5, "c")], "doc int, node int, parent int, name string")
    assert rows(tree.sorted_levels(n, C("name")).select("node", "ord")) == [(5, 1), (6, 0), (7, 0)]
    t = spark.createDataFrame([(1, 0, 3), (1, 1, None), (1, 2, 4)], "doc int, ord int, number int")
    assert rows(tree.table_numbers(t, ["doc"], "ord").select("ord", "number")) == [(0, 3), (1, 3), (2, 4)]
