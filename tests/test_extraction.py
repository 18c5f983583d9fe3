"""Tables over several parts, trees over several pages, product codes, register maps, headers and text search."""

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from docgrid.functions import geometry
from docgrid.operators import evaluate, graph, layout, products, registers, search, sequence, spatial, tables, tree
from docgrid.plans.registry import QUERIES
from docgrid.sources import catalog, devices, headers, html

C, L = F.col, F.lit
CELLS = f"doc int, part int, {tables.CELL}"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def cells_of(spark, *parts):
    """Cells of parts, each a list of rows of (text, colspan, rowspan, head)."""
    out = []
    for k, part in enumerate(parts):
        for y, line in enumerate(part):
            x = 0
            for text, colspan, rowspan, head in line:
                out.append((1, k, y, x, rowspan, colspan, head, text))
                x += colspan
    return spark.createDataFrame(out, CELLS)


def test_appended_below(spark):
    first = [[("A", 1, 1, True), ("B", 2, 1, True)], [("a", 1, 1, False), ("b1", 1, 1, False), ("b2", 1, 1, False)]]
    second = [[("A", 2, 1, True), ("B", 1, 1, True)], [("c1", 1, 1, False), ("c2", 1, 1, False), ("d", 1, 1, False)]]
    third = [[("X", 1, 1, True)], [("x", 1, 1, False)]]
    got = rows(tables.appended_below(cells_of(spark, first, second, third), ["doc"], "part").select("table", "y", "x", "colspan", "head", "text"))
    # Two columns for A, two for B: narrower cells are widened; the headers of the second part go; the third has one group only.
    assert got == sorted([(0, 0, 0, 2, True, "A"), (0, 0, 2, 2, True, "B"), (0, 1, 0, 2, False, "a"), (0, 1, 2, 1, False, "b1"), (0, 1, 3, 1, False, "b2"), (0, 2, 0, 1, False, "c1"), (0, 2, 1, 1, False, "c2"), (0, 2, 2, 2, False, "d"), (1, 0, 0, 1, True, "X"), (1, 1, 0, 1, False, "x")], key=repr)
    plain = tables.appended_below(cells_of(spark, [[("1", 1, 1, False)]], [[("2", 1, 1, False)], [("3", 1, 1, False)]]), ["doc"], "part", headers=False)
    assert rows(plain.select("y", "text")) == [(0, "1"), (1, "2"), (2, "3")]


def test_appended_beside(spark):
    got = tables.appended_beside(cells_of(spark, [[("a", 1, 1, False), ("b", 1, 1, False)]], [[("c", 1, 1, False)], [("d", 1, 1, False)]]), ["doc"], "part")
    assert rows(got.select("text", "y", "x", "rowspan")) == [("a", 0, 0, 2), ("b", 0, 1, 2), ("c", 0, 2, 1), ("d", 1, 2, 1)]


def test_table_groups_and_bits(spark):
    kinds = [("table", "table", 3), ("table", "table", 0), ("para", None, None), ("table", "table", 0), ("table", "register", 0), ("table", "register", 0), ("table", "bits", 0), ("table", "table", 3)]
    d = spark.createDataFrame([(1, i, *k) for i, k in enumerate(kinds)], "doc int, ord int, name string, type string, number int")
    got = {r.ord: (r.group.split(":")[0] if r.type != "table" else r.group, r.part) for r in tables.table_groups(d, ["doc"], "ord").collect()}
    assert got == {0: ("number:3", 0), 1: ("number:3", 1), 3: ("alone:3", 0), 4: ("register", 0), 5: ("register", 1), 6: ("bits", 0), 7: ("number:3", 2)}
    b = spark.createDataFrame([(1, 0, "bit", 1, "Bit 0", "EN"), (1, 1, "bit", 1, "Bit 1", "IE"), (1, 2, "bit", 2, "Bit 2", "X"), (1, 3, "para", 2, None, None)], "doc int, ord int, name string, page int, bits string, description string")
    assert [tuple(r) for r in tables.bit_tables(b, ["doc"], "ord").select("table", "y", "x", "text").orderBy("table", "y", "x").collect()] == [(1, 0, 0, "Bit 0"), (1, 0, 1, "EN"), (1, 1, 0, "Bit 1"), (1, 1, 1, "IE"), (2, 0, 0, "Bit 2"), (2, 0, 1, "X")]


def test_html_of_tables_comes_back(spark):
    c = cells_of(spark, [[("A<", 1, 2, True), ("B", 2, 1, True)], [("C", 1, 1, True), ("D", 1, 1, True)], [("1", 1, 1, False), (None, 1, 1, False), ("3&", 1, 1, False)]])
    c = c.withColumn("x", F.when(C("y") == 1, C("x") + 1).otherwise(C("x")))
    text = tables.as_html(c, ["doc"], L("Table 1")).first().html
    assert text.startswith("<table><caption>Table 1</caption><tr><th rowspan=2>A&lt;</th><th colspan=2>B</th></tr>")
    table = next(i for i in html.parse(text) if i["type"] == "table")
    grid, head = html.dense_grid(table["cells"])
    assert [[table["cells"][k]["html"] for k in line] for line in grid] == [["A&lt;", "B", "B"], ["A&lt;", "C", "D"], ["1", "", "3&amp;"]] and head == 2
    assert tables.as_text(c.where("y = 2"), ["doc"]).first().text == "| 1 |  | 3& |"


NODES = "doc bigint, node bigint, parent bigint, ord int, name string, depth int, text string"


def test_tree_order_and_printing(spark):
    n = spark.createDataFrame([(1, 0, None, 0, "heading", 2, "H"), (1, 1, 0, 0, "para", None, "a"), (1, 2, 0, 1, "note", None, None), (1, 3, 2, 0, "para", None, "b"), (1, 4, None, 1, "para", None, "c")], NODES)
    p = tree.paths(n)
    assert [r.node for r in p.orderBy("path").collect()] == [0, 1, 2, 3, 4]
    assert [r.node for r in tree.reverse_order(p).orderBy("reverse").collect()] == [4, 3, 2, 1, 0]
    assert tree.printed(p).first().text == "heading: H\n  para: a\n  note\n    para: b\npara: c"
    marked = tree.page_markers(p.withColumn("page", F.when(C("node") < 3, 1).otherwise(2)))
    assert rows(marked.select("page", "node")) == [(1, 1), (2, 3)]
    r = one(spark, a=tree.stripped(F.array(L(" "), L("a"), L(" "), L("b"), L(" ")), lambda v: v == " "), b=tree.stripped(F.array(L(" ")), lambda v: v == " "))
    assert r.a == ["a", " ", "b"] and r.b == []
    with pytest.raises(ValueError, match="deeper"):
        tree.paths(n, 1)


def test_areas_over_pages(spark):
    nodes = [(1, 0, 0, 0, None, "heading", 0.0, False), (1, 0, 1, 1, None, "listb", 20.0, False), (1, 1, 0, 2, None, "lists", 40.0, False), (1, 1, 1, 3, None, "para", 0.0, False), (1, 1, 2, 4, None, "note", 0.0, False), (1, 2, 0, 5, None, "para", 5.0, True), (1, 2, 1, 6, None, "heading", 0.0, False), (1, 2, 2, 7, None, "para", 0.0, False), (1, 2, 3, 8, 7, "line", 0.0, False)]
    d = spark.createDataFrame(nodes, "doc bigint, area int, ord int, node bigint, parent bigint, name string, x double, italic boolean")
    assert {r.node: r.parent for r in tree.merged_areas(d, 10.0).collect()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 0, 5: 4, 6: None, 7: 6, 8: 7}
    # Of a chain deeper than Python's stack, and of many paragraphs without a heading; the tree is made once.
    deep = spark.range(3000).selectExpr("1L as doc", "0 as area", "0 as ord", "id as node", "if(id = 0, null, id - 1) as parent", "'para' as name", "0.0D as x", "false as italic")
    flat = deep.selectExpr("2L as doc", "int(node) as area", "ord", "node", "cast(null as bigint) as parent", "name", "x", "italic")
    found = rows(tree.merged_areas(deep.union(flat), 10.0).select("doc", "node", "parent"))
    assert found == sorted([(1, k, k - 1 if k else None) for k in range(3000)] + [(2, k, None) for k in range(3000)], key=repr)
    assert QUERIES["q149_merged_areas"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("FlatMapGroups") == 1
    x = spark.createDataFrame([("listb", 9.0, 34.7, 30.0), ("para", 50.0, 0.0, 30.0)], "name string, x double, left double, area_x double")
    assert rows(tree.relative_x(x).select("name", "x")) == [("listb", 4.0), ("para", 20.0)]


def test_serialised_lists_tables_styles(spark):
    n = spark.createDataFrame([(1, 0, None, 0, "listb", None, "a"), (1, 1, None, 1, "listb", None, "b"), (1, 2, 1, 0, "listn", None, "c"), (1, 3, None, 2, "table", None, None), (1, 4, None, 3, "para", None, "x")], NODES)
    n = n.withColumn("html", F.when(C("node") == 3, "<table><tr><td>1</td></tr></table>")).withColumn("runs", F.when(C("node") == 4, F.array(F.struct(L("a<").alias("text"), F.array(L("b")).alias("styles")), F.struct(L("c").alias("text"), F.array(L("b"), L("sup")).alias("styles")))))
    assert tree.serialised(n).first().html == "<html><body><ul><li>a</li><li>b<ol><li>c</li></ol></li></ul><table><tr><td>1</td></tr></table><p><b>a&lt;<sup>c</sup></b></p></body></html>"
    lines = spark.createDataFrame([(1, 0, "1.2 T"), (1, 1, "• a")], "doc bigint, ord int, text string")
    assert rows(tree.normalised(lines).select("name", "depth", "section")) == sorted([("heading", 3, 0), ("listb", None, 0)], key=repr)
    assert tree.normalised(lines, lambda d: d.where("ord = 1"), lambda d: d.withColumn("k", L(1))).columns == ["doc", "ord", "text", "k"]


def test_geometry_of_lines(spark):
    b = geometry.box(L(0.0), L(1.0), L(10.0), L(4.0))
    r = one(spark, a=geometry.rotated(b, 90), b=geometry.rotated(b, 180), c=geometry.rotated(b, 270), d=geometry.specialised(L(1.0), L(5.0), L(1.0), L(2.0)), e=geometry.specialised(L(0.0), L(0.0), L(1.0), L(2.0)), f=geometry.colour_class(L(255), {255: "black"}), g=geometry.colour_class(L(1), {255: "black"}), h=geometry.char_style(L("Arial-BoldItalic"), L(13.0), L(10.0), L(10.0), L(True)), i=geometry.char_style(L("A"), L(7.0), L(10.0), L(10.0), L(False), L(True)), j=geometry.rounded(geometry.translated(b, L(0.26), L(0.0)), 1), k=F.size(geometry.ruling_lines(b, 1.0)), m=geometry.ruling_lines(geometry.box(L(0.0), L(0.0), L(9.0), L(0.5)), 1.0))
    assert tuple(r.a) == (-4.0, 0.0, -1.0, 10.0) and tuple(r.b) == (-10.0, -4.0, 0.0, -1.0) and tuple(r.c) == (1.0, -10.0, 4.0, 0.0)
    assert tuple(r.d) == ("vertical", 1.0, 2.0, 5.0) and r.e is None and (r.f, r.g) == ("black", "unknown")
    assert r.h == ["b", "i", "u", "sup"] and r.i == ["sup"] and tuple(r.j) == (0.3, 1.0, 10.3, 4.0) and r.k == 4 and [tuple(x) for x in r.m] == [("level", 0.0, 0.25, 9.0, 0.25)]


def test_search(spark):
    text = "Pin x pins PIN pin_1 pin"
    c = spark.createDataFrame([(1, 100 + i, ch, float(i), 1.0) for i, ch in enumerate(text)], "page int, idx int, char string, x double, y double")
    assert rows(search.found_words(c, ["page"], "pin")) == [(1, 0, 121, 123)]
    assert [r["first"] - 100 for r in search.found_words(c, ["page"], "PIN", case_sensitive=False).orderBy("hit").collect()] == [0, 11, 21]
    assert search.found_words(c, ["page"], "zzz").count() == 0
    b = spark.createDataFrame([(1, 7, 6.0, 0.0, 9.0, 2.0)], "page int, k int, l double, b double, r double, t double")
    assert rows(search.text_in_boxes(c, b, ["page"], ["k"])) == [(1, 7, "pins")]
    assert rows(search.text_in_boxes(c, b, ["page"], ["k"], most=2)) == [(1, 7, "pi")]


def test_option_products(spark):
    opts = [("Pin count", "C", "48 pins"), ("Pin count", "R", "64 pins"), ("Flash size", "8(1)", "64 KB"), ("Package", "T", "LQFP"), ("Temperature range", "6", "85"), ("Option", "xN", "dedicated x = N"), ("Option", "TR", "tape"), ("Other", "Z", "z")]
    o = spark.createDataFrame([("d", *x) for x in opts], "doc string, header string, value string, descr string")
    codes = products.option_codes(o, ["doc"])
    assert rows(codes.select("axis", "code")) == [("package", "T"), ("pin", "C"), ("pin", "R"), ("size", "8"), ("temperature", "6"), ("variant", ""), ("variant", "N")]
    stems = spark.createDataFrame([("d", "stm32f103")], "doc string, stem string")
    got = products.option_products(stems, codes, ["doc"], "stem")
    assert sorted(r.code for r in got.collect()) == sorted(f"stm32f103{p}8T6{v}" for p in "CR" for v in ("", "N"))
    assert {r.options["variant"] for r in got.collect()} == {"normal", "dedicated x = N"}
    with pytest.raises(Exception, match="no axis package"):
        products.option_products(stems, codes.where("axis <> 'package'"), ["doc"], "stem").collect()
    f = products.first_filled(stems, ["doc"], codes.where("axis = 'zzz'"), codes.where("axis = 'size'"))
    assert rows(f.select("code", "source")) == [("8", 1)]


def test_packages(spark):
    names = ["Pin number:LPQF48", "Pin:LQFP64 SMPS", "Pin:UFBGA/TFBGA64", "Pin:BGA100(1)", "Pins:STM32F405xx, STM32F415xx:LQFP100", "Pin:Name", "Pin:UFQFPN<br>32", "Pin:WLCSP20L or TSSPOP20", "Pin:LQFP48 with SMPS"]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, domain string")
    got = {(r.i, r.package, tuple(r.filters), r.family, r.pins) for r in products.packages(d, "domain").collect()}
    assert got == {(0, "LQFP48", (), "LQFP", 48), (1, "LQFP64", ("SMPS",), "LQFP", 64), (2, "UFBGA64", (), "UFBGA", 64), (2, "TFBGA64", (), "TFBGA", 64), (3, "UFBGA100", (), "UFBGA", 100), (4, "LQFP100", ("STM32F405..|STM32F415..",), "LQFP", 100), (6, "UFQFPN32", (), "UFQFPN", 32), (7, "WLCSP20", (), "WLCSP", 20), (7, "TSSOP20", (), "TSSOP", 20), (8, "LQFP48", ("SMPS",), "LQFP", 48)}


def test_register_rows_and_types(spark):
    d = spark.createDataFrame([(1, "ADC_CR 1", "0x000x00", "31-30", "DATA [7:0]"), (1, "Reserved", "0x04", "1", "X"), (1, "ADC_SR", "0x0C to 0x14", "Bit:7", "EOC"), (1, "ADC_X", "0x08", "3", "Reserved")], "t int, register string, offset string, bits string, field string")
    assert rows(registers.register_rows(d, ["t"])) == [(1, "ADC_CR1", "0x00", 30, "DATA"), (1, "ADC_CR1", "0x00", 31, "DATA"), (1, "ADC_SR", "0x0C-0x14", 7, "EOC")]
    names = lambda *n: F.array(*map(L, n))
    r = one(spark, a=registers.peripheral_type(L("USB OTG_FS map"), names("X_A")), b=registers.peripheral_type(L("map"), names("TIM2_CR1", "TIM2_SR")), c=registers.peripheral_type(L("map"), names("ADC_CR", "ADC_SR")), d=registers.peripheral_type(L("map"), names("COMP1_CSR", "COMP2_CSR")), e=registers.caption_filters(L("TIM2 to TIM4 register map")), f=registers.caption_filters(L("TIM9/12 map for STM32F405/415xx")), g=registers.caption_filters(L("map")))
    assert (r.a, r.b, r.c, r.d) == ("OTG", "TIM", "ADC", "COMP")
    assert r.e["instances"] == ["TIM(2|3|4)", "^TIM2$", "^TIM4$"] and r.f["instances"] == ["^TIM(9|12)$"] and r.f["devices"] == ["STM32F405..", "STM32F415.."] and r.g == {}


def test_expanded_offsets(spark):
    d = spark.createDataFrame([("A", "0x10"), ("BKPxR", "0x50-0x58"), ("C", "0x10or0x20"), ("Lx", "0x28(x=A)0x30(x=B)"), ("Fx", "0x10 + 4*x (x=1..3)"), ("Gx", "0x10+0x8*x(x=0-1)"), ("CH", "0x14+0x4*channelnumber"), ("bad", "see text")], "name string, offset string")
    got = {}
    for r in registers.expanded_offsets(d, "offset", "name").collect():
        got.setdefault(r.offset, []).append((r.name, r.byte_offset))
    assert got["0x10"] == [("A", 16)] and got["0x50-0x58"] == [("BKP0R", 80), ("BKP1R", 84), ("BKP2R", 88)] and got["0x10or0x20"] == [("C.0", 16), ("C.1", 32)]
    assert got["0x28(x=A)0x30(x=B)"] == [("L0", 40), ("L1", 48)] and got["0x10 + 4*x (x=1..3)"] == [("F1", 20), ("F2", 24), ("F3", 28)] and got["0x10+0x8*x(x=0-1)"] == [("G0", 16), ("G1", 24)]
    assert got["0x14+0x4*channelnumber"][0] == ("CH.0", 20) and got["0x14+0x4*channelnumber"][-1] == ("CH.15", 80) and "see text" not in got


def test_links_and_boundaries(spark):
    i = spark.createDataFrame([("ADC", []), ("ADC1", []), ("X9", ["4.2"]), ("UART4", []), ("BKP", [])], "name string, sections array<string>")
    t = spark.createDataFrame([("ADC", "1"), ("USART", "2"), ("RTC", "3"), ("FOO", "4.2")], "type string, section string")
    assert rows(registers.linked_types(i, t).select("name", "type", "level")) == [("ADC", "ADC", 0), ("ADC1", "ADC", 1), ("BKP", "RTC", 4), ("UART4", "USART", 3), ("X9", "FOO", 2)]
    b = spark.createDataFrame([("TIM2, TIM3", "0x4000 0000 - 0x4000 03FF", "APB1", "Section 18.4 on page 5"), ("R", "0x1-0x2", "", "none")], "n string, a string, bus string, s string")
    assert rows(registers.boundary_rows(b, "n", "a", "bus", "s")) == [("TIM2", 0x40000000, 0x400003FF, "APB1", ["18.4"]), ("TIM3", 0x40000000, 0x400003FF, "APB1", ["18.4"])]
    o = spark.createDataFrame([("ADC1 and ADC2", "0x300-0x308")], "r string, o string")
    assert rows(registers.instance_offsets(o, C("r"), C("o"))) == [("ADC[1]", 768), ("ADC[2]", 768)]
    cells = spark.createDataFrame([(1, "ADC", "1", "CRx", "0x00-0x04", "1-0", "EN"), (1, "ADC", "1", "SR", "0x08", "3", "F")], "d int, type string, section string, register string, offset string, bits string, field string")
    inst = spark.createDataFrame([("ADC1", 0x1000, [])], "name string, address bigint, sections array<string>")
    assert rows(registers.device_map(cells, inst, ["d"]).select("instance", "register", "address", "field", "position", "width")) == [("ADC1", "CR0", 0x1000, "EN", 0, 2), ("ADC1", "CR1", 0x1004, "EN", 0, 2), ("ADC1", "SR", 0x1008, "F", 3, 1)]


def test_device_defines(spark):
    d = spark.createDataFrame([("f1", "03", "b", "r", ""), ("f1", "03", "e", "r", ""), ("f0", "30", "8", "c", ""), ("f7", "78", "i", "b", ""), ("h7", "43", "i", "z", "")], "family string, name string, size string, pin string, variant string")
    n = spark.createDataFrame([(x,) for x in ("STM32F103x6", "STM32F103xB", "STM32F103xE", "STM32F030x8", "STM32F777xx", "STM32H743xx")], "define string")
    assert {(r.name, r.size): r.define for r in registers.device_define(d, n).collect()} == {("03", "b"): "STM32F103xB", ("03", "e"): "STM32F103xE", ("30", "8"): "STM32F030x8", ("78", "i"): "STM32F777xx", ("43", "i"): "STM32H743xx"}


def test_structures_and_fields(spark, tmp_path):
    (tmp_path / "a.h").write_text("typedef struct {\n __IO uint32_t CR1; /* c */\n uint32_t RESERVED0[2];\n __IO uint16_t DR[2];\n SUB_T CH[0x2];\n} ADC_T;\ntypedef struct\n{\n uint32_t X;\n uint8_t Y;\n} SUB_T;\n#define ADC_CR1_EN_Pos (3U)\n#define ADC_CR1_EN_Msk (0x3UL << ADC_CR1_EN_Pos)\n#define ADC_CR1_EN ADC_CR1_EN_Msk\n#define ADC_CR1_NO_Pos 2\n")
    f = headers.scan(spark, str(tmp_path))
    s = headers.structures(f)
    assert rows(s.where("type = 'ADC_T'").select("ord", "member_type", "name", "count")) == [(0, "uint32_t", "CR1", 0), (1, "uint32_t", "RESERVED0", 2), (2, "uint16_t", "DR", 2), (3, "SUB_T", "CH", 2)]
    flat = registers.flattened(s, ["file"])
    assert [tuple(r) for r in flat.where("type = 'ADC_T'").orderBy("ord").select("name", "byte_offset", "size").collect()] == [("CR1", 0, 4), ("DR.0", 12, 2), ("DR.1", 14, 2), ("CH.0.X", 16, 4), ("CH.0.Y", 20, 1), ("CH.1.X", 21, 4), ("CH.1.Y", 25, 1)]
    macros = headers.values(headers.defines(f))
    r = spark.createDataFrame([("a.h", "CR1", "ADC_CR1_")], "file string, register string, prefix string")
    assert rows(registers.matched_fields(r, macros, ["file"])) == [("a.h", "CR1", "EN", 3, 2)]
    ring = spark.createDataFrame([("a", "T", 0, "T", "x", 0)], "file string, type string, ord int, member_type string, name string, count int")
    with pytest.raises(Exception, match="unknown type"):
        registers.flattened(ring, ["file"]).collect()


def test_interrupt_tables(spark):
    t = lambda *n: F.array(*map(L, n))
    pick = lambda n, d="STM32F411", core=False: registers.interrupt_table(n, L(d), L(core))
    r = one(spark, a=pick(t("V")), b=pick(t("V:Device=stm32f4", "W")), c=pick(t("V:Device=STM32F1", "W")), d=pick(t("V:Core=m4", "W")), e=pick(t("V"), core=True), f=pick(t("V:Device=STM32F1:Device=STM32F4")))
    assert tuple(r) == ("V", "V:Device=stm32f4", "W", None, None, "V:Device=STM32F1:Device=STM32F4")


def test_devices(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.xml").write_text("<rca><device family='f4' name='11' pin='c' size='e'><driver name='uart' type='t'><instance name='1'/><instance name='2'/></driver></device><device family='f1' name='03' pin='c' size='8'/></rca>")
    d = devices.read(spark, str(tmp_path / "in"))
    assert {r.identifier: r.drivers for r in d.collect()} == {"stm32f411ce": {"uart": ["1", "2"]}, "stm32f103c8": {}}
    devices.store(d, str(tmp_path / "db"))
    assert rows(devices.names(spark, str(tmp_path / "db"))) == [("stm32f103c8",), ("stm32f411ce",)]
    got = devices.one(spark, str(tmp_path / "db"), "f4", "stm32f411ce")
    assert got.count() == 1 and "PartitionFilters: [isnotnull(family" in got._jdf.queryExecution().toString()


def test_locators(spark):
    pages = spark.createDataFrame([(1, "<p>Table 1. Pin definitions</p><table><tr><td>1</td></tr></table><p>Table 2. Other</p><table><tr><td>2</td></tr></table>"), (2, "<p>none</p>")], "id int, html string")
    found = html.tables(html.items(pages, "id", "html"), "pin +definition")
    assert [r.caption for r in found.collect()] == ["Table 1. Pin definitions"]
    docs = spark.createDataFrame([(1, "F4"), (2, "F1")], "doc bigint, family string")
    assert html.only(found, docs, "doc", C("family") == "F1").count() == 1
    with pytest.raises(Exception, match="not exactly one for 2"):
        html.only(found, docs, "doc").collect()


def test_sources_of_names(spark):
    d = spark.createDataFrame([(1, "UART", "rm"), (1, "USART", "cm"), (1, "USART", "hd"), (2, "A", "rm")], "k int, name string, source string")
    assert [(r.k, r.names) for r in evaluate.named_sources(d, ["k"], "name", "source").collect()] == [(1, {"UART": "rm", "USART": "cm+hd"})]
    a = spark.createDataFrame([("A1", "TX", 7), ("A1", "TX", 8), ("A2", "RX", 1)], "pin string, signal string, af int")
    assert rows(evaluate.mixed(a, ["pin", "signal"], "af", "label")) == [("A1", "TX", "7-8")]


def test_graph_store(spark, tmp_path):
    g = spark.createDataFrame([("a", "type", "b"), ("a", "has", "c")], "subject string, predicate string, object string")
    path = str(tmp_path / "g")
    graph.save(g, path)
    assert graph.load(spark, path, "has").select("object").collect() == [("c",)] and graph.load(spark, path).count() == 2
    graph.clear(spark, path)
    assert not (tmp_path / "g").exists()
    n = graph.namespaced(g.withColumn("family", L("f4")), "family").first()
    assert (n.subject, n.object, n.ns) == ("f4:a", "f4:b", "f4")


def test_lines_and_columns(spark):
    text = [("a", 0.0, 100.0, 0), ("b", 5.0, 100.04, 0), ("c", 9.0, 101.0, 0), ("\r", 9.5, 100.0, 0), ("x", 2.0, 50.0, 90), (" ", 0.0, 10.0, 0)]
    d = spark.createDataFrame([(1, i, c, ord(c), x, o, 10.0, r) for i, (c, x, o, r) in enumerate(text)] + [(1, 9, "", 61623, 12.0, 100.0, 10.0, 0)], "page int, idx int, char string, unicode int, x double, origin double, height double, rotation int")
    got = layout.built_lines(layout.prepared_chars(d), ["page"])
    assert rows(got.select("octant", "text")) == [(0, "abc•"), (2, "x")]
    pages = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0)], "page int, width double")
    c = spark.createDataFrame([(1, 0.0, 40.0), (1, 60.0, 90.0), (2, 0.0, 40.0), (2, 45.0, 55.0), (2, 60.0, 70.0)], "page int, l double, r double")
    assert rows(layout.columns_of_text(c, pages, ["page"])) == [(1, 2), (2, 1), (3, 1)]


def test_graphics(spark):
    box = lambda l, b, r, t: F.struct(L(float(l)).alias("l"), L(float(b)).alias("b"), L(float(r)).alias("r"), L(float(t)).alias("t"))  # noqa: E731, E741
    b = spark.range(4).select(L(1).alias("page"), C("id"), F.when(C("id") == 0, box(0, 0, 10, 10)).when(C("id") == 1, box(5, 5, 20, 15)).when(C("id") == 2, box(50, 8, 60, 12)).otherwise(box(0, 40, 5, 50)).alias("box"))
    got = {r.id: (r.region, r.subregion) for r in layout.graphic_clusters(b, ["page"], "id").collect()}
    assert got[0] == got[1] != got[2] and got[2][0] == got[0][0] != got[3][0]
    a = spark.createDataFrame([(1, 0.0, 100.0), (2, 0.0, 50.0)], "page int, lo double, hi double")
    o = spark.createDataFrame([(1, 20.0, 40.0), (1, 35.0, 60.0), (1, 63.0, 95.0)], "page int, olo double, ohi double")
    assert rows(layout.split_around(a, o, ["page"], 4.0)) == [(1, "object", 20.0, 60.0), (1, "object", 63.0, 95.0), (1, "text", 0.0, 20.0), (1, "text", 95.0, 100.0), (2, "text", 0.0, 50.0)]
    cap = spark.createDataFrame([(1, 5, 10.0, 100.0), (1, 5, 60.0, 100.0), (1, 9, 10.0, 100.0)], "page int, y int, x double, width double")
    assert rows(layout.side_by_side(cap, ["page"], "y", "x", "width").select("y", "left", "right")) == [(5, 0.0, 35.0), (5, 35.0, 100.0), (9, 0.0, 100.0)]
    p = spark.createDataFrame([(1, "line", True, 2, 2), (1, "line", True, 0, 2), (2, "image", False, 0, 1), (2, "line", True, 2, 2), (3, "other", False, 1, 9), (4, "other", False, 4, 5)], "g int, kind string, stroked boolean, corners int, points int")
    assert rows(layout.graphic_class(p, ["g"])) == [(1, "table"), (2, "figure"), (3, "figure"), (4, "table")]


def test_borders_and_headers(spark):
    cells = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 5.0), (1, 1, 10.0, 0.0, 20.0, 5.0)], "tab int, cell int, l double, b double, r double, t double")
    lines = spark.createDataFrame([(1, 0, "vertical", 10.2, 0.0, 5.0, 2.0), (1, 1, "vertical", 9.9, 0.0, 5.0, 7.0), (1, 2, "horizontal", 5.0, 0.0, 9.0, 1.0), (1, 3, "vertical", 20.0, 4.0, 5.0, 3.0)], "tab int, ord int, direction string, at double, lo double, hi double, width double")
    assert rows(layout.cell_borders(cells, lines, ["tab"], ["cell"], 0.5).select("cell", "l", "b", "r", "t")) == [(0, 0.0, 0.0, 2.0, 1.0), (1, 2.0, 0.0, 0.0, 0.0)]
    c = spark.createDataFrame([(t, y, y in bold) for t, bold in ((1, (0, 1, 3)), (2, (0,))) for y in range(4) for _ in range(2)], "tab int, y int, bold boolean")
    ln = spark.createDataFrame([(1, -1, 2.0), (1, 1, 1.9), (1, 2, 0.5)], "tab int, below int, width double")
    assert {(r.tab, r.y) for r in layout.header_by_lines(c, ln, ["tab"], "y").collect() if r.header} == {(1, 0), (1, 1), (2, 0)}
    ch = spark.createDataFrame([(1, 5, 3.0, 3.0), (1, 6, 30.0, 3.0)], "page int, idx int, x double, y double")
    lk = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0, 7, 0), (1, 2.0, 2.0, 9.0, 9.0, 8, 1)], "page int, l double, b double, r double, t double, target int, ord int")
    assert rows(layout.object_linked(ch, lk, ["page"], "idx")) == [(1, 5, 8)]


def test_title_chains(spark):
    d = spark.createDataFrame([(1, i, lv, t) for i, (lv, t) in enumerate([(0, "A"), (1, "a"), (2, "x"), (1, "b"), (0, "B"), (2, "y")])], "doc int, ord int, level int, title string")
    assert [r.chain for r in sequence.title_chain(d, ["doc"], "ord", "level", "title").orderBy("ord").collect()] == [["A"], ["A", "a"], ["A", "a", "x"], ["A", "b"], ["B"], ["B", "y"]]


def test_sources_and_drivers(spark, tmp_path):
    d = spark.createDataFrame([("stm32f407",), ("stm32f401",)], "dev string")
    p = spark.createDataFrame([("stm32f4",), ("stm32f407",)], "pre string")
    assert rows(spatial.assigned(d, p, "dev", "pre")) == [("stm32f401", "stm32f4"), ("stm32f407", "stm32f407")]
    i = spark.createDataFrame([("d", "rm", "x", 1), ("d", "rm", "a", 2), ("d", "hd", "h", 1)], "dev string, source string, file string, at int")
    assert rows(evaluate.index_by_source(i, ["dev"], "source", ["hd", "cm", "rm"], "file", ["at"])) == [("d", "h", None, "a")]
    w = evaluate.whitelisted(spark.createDataFrame([("A", "B"), ("C", "D")], "x string, y string"), spark.createDataFrame([("B", "A")], "p string, q string"), "x", "y")
    assert rows(w) == [("C", "D")]
    t = evaluate.totals(spark.createDataFrame([("f", 10, 8, 1), ("f", 2, 4, 9)], "fam string, a int, b int, wrong int"), ["fam"], "a", "b", "wrong").first()
    assert (t["all"], t.correct, t.wrong, t.pct) == (14, 9, 10, 64.286)
    s = spark.createDataFrame([(1, "USART1_TX"), (1, "FOO_X")], "k int, signal string")
    dr = spark.createDataFrame([(1, "usart", ["1", "2"]), (1, "i2s", ["3"]), (1, "rcc", None), (1, "crc", None)], "k int, driver string, inst array<string>")
    names = evaluate.driver_names(dr, ["k"], "driver", "inst", {"rcc": "sys"}, ["CRC"])
    assert rows(names.select("driver")) == [("I2S",), ("I2S3",), ("SYS",), ("USART1",), ("USART2",)]
    kept, ignored = evaluate.driver_signals(s, names, ["k"], "signal", "driver")
    assert rows(kept) == [(1, "USART1_TX")] and rows(ignored) == [(1, "FOO_X")]
    (tmp_path / "r.json").write_text('{"rows": [{"title": "DS1", "version": "1.0"},\n {"title": "RM2", "version": "2.0"}]}')
    assert rows(catalog.remote(spark, str(tmp_path / "r.json")).select("title", "version")) == [("DS1", "1.0"), ("RM2", "2.0")]


def test_pins_vectors_packages(spark):
    d = spark.createDataFrame([(1, "PA0(2)", "I/O", "-", "ADC_IN0, WKUP", {"LQFP48": "10", "BGA": "-"}), (1, "PC13 (osc)", "I/O", "FT", "-", {"LQFP48": "2, 3"})], "doc int, name string, type string, structure string, functions string, positions map<string,string>")
    assert rows(registers.pin_rows(d, ["doc"], {"PC13": "PC13X"}).select("package", "position", "name", "structure", F.array_join("functions", "+").alias("f"))) == sorted([("LQFP48", "10", "PA0", None, "ADC_IN0+WKUP"), ("LQFP48", "2", "PC13X", "FT", ""), ("LQFP48", "3", "PC13X", "FT", "")], key=repr)
    v = spark.createDataFrame([(1, "Vector table", "0", "WWDG"), (1, "Vector table", "0", "IWDG"), (1, "Vector table", "-", "NMI"), (1, "Vectors for STM32F405xx (Cortex-M4)", "7", "X"), (1, "Vectors, category 3 devices", "1", "Y")], "doc int, caption string, position string, name string")
    got = {(r.table, r.position): r.names for r in registers.vector_tables(v, ["doc"]).collect()}
    assert got == {("VectorTable", 0): ["IWDG", "WWDG"], ("VectorTable:Core=m4:Device=STM32F405..", 7): ["X"], ("VectorTable:Categories=3", 1): ["Y"]}
    assert one(spark, f=registers.device_family(L("STM32F405xx datasheet"))).f == "STM32F4"
    p = spark.createDataFrame([(1, "ADC12_COMMON", 5), (1, "ADC1", 5), (1, "ADC3_COMMON", 9), (1, "OPAMP", 7), (1, "OPAMP1", 7)], "dev int, name string, addr int")
    assert rows(registers.without_duplicates(p, ["dev"], "name", "addr").select("name")) == [("ADC1",), ("ADC3_COMMON",), ("OPAMP1",)]
    dev = spark.createDataFrame([(1, "stm32f405rg", "LQFP64"), (1, "stm32f415rg", "LQFP64"), (1, "x", "VFQFPN48")], "doc int, device string, package string")
    pk = spark.createDataFrame([(1, "LQFP64", ["f405"]), (1, "LQFP", None), (1, "UFQFPN48", None)], "doc int, name string, filters array<string>")
    assert rows(registers.selected_packages(dev, pk, ["doc"], {"VFQFPN": "UFQFPN"}).select("device", "name", "level")) == [("stm32f405rg", "LQFP64", 0), ("stm32f415rg", "LQFP", 1), ("x", "UFQFPN48", 2)]
