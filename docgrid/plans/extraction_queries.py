"""Queries over table parts, trees, product codes, register maps, structures and searched text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lineage
from ..functions import geometry as g
from ..operators import evaluate, graph, layout, products, rebuild, registers, search, sequence, spatial, subtrees, tables, tree
from ..sources import catalog, html
from ..streaming import versions
from .registry import query

C, L = F.col, F.lit
one = lambda: F.count(L(1))
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KSQL = ", ".join(_KEY)
_BOX = "l_quantity AS l, l_linenumber::DOUBLE AS b, l_quantity + l_partkey % 7 AS r, (l_linenumber + l_suppkey % 3)::DOUBLE AS t"


def _box(row_of: str = ""):
    c = lambda n: C(f"{row_of}{n}")
    return g.box(c("l_quantity"), c("l_linenumber").cast("double"), c("l_quantity") + c("l_partkey") % 7, (c("l_linenumber") + c("l_suppkey") % 3).cast("double"))


@query("q117_box_join", f"WITH r AS (SELECT {_KSQL}, {_BOX} FROM lineitem) SELECT x.l_orderkey, x.l_partkey AS i, y.l_partkey AS j, x.l_linenumber AS li, y.l_linenumber AS lj FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey WHERE x.l <= y.r AND y.l <= x.r AND x.b <= y.t AND y.b <= x.t")
def _(t, spark):
    a = t("lineitem").select("l_orderkey", C("l_partkey").alias("i"), C("l_linenumber").alias("li"), _box().alias("box"))
    b = t("lineitem").select("l_orderkey", C("l_partkey").alias("j"), C("l_linenumber").alias("lj"), _box().alias("other"))
    return spatial.box_join(a, b, ["l_orderkey"], cell=8.0).select("l_orderkey", "i", "j", "li", "lj")


#: Characters, one a row, that a task makes of names.
_TASK_CHARS = 200_000


def _named_parts(t):
    """Parts and their names, moved to as many tasks as the names' characters, counted by a job, need; what is then cut,
    met and gathered by part stays in its task."""
    parts = t("part").select("p_partkey", "p_name")
    return parts.repartition((parts.agg(F.sum(F.length("p_name"))).first()[0] or 0) // _TASK_CHARS + 1, "p_partkey")


def _name_chars(parts):
    return parts.select("p_partkey", F.posexplode(F.filter(F.split("p_name", ""), lambda c: c != "")).alias("idx", "char"))


@query("q118_found_words", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'cold ') THEN 0 ELSE strpos(p_name, ' cold') END::INT AS first FROM part WHERE regexp_matches(p_name, '\\bcold\\b')")
def _(t, spark):
    return search.found_words(_name_chars(_named_parts(t)), ["p_partkey"], "cold").select("p_partkey", "first")


@query("q119_text_in_boxes", "SELECT p_partkey, substr(p_name, 3, 4) AS text FROM part")
def _(t, spark):
    parts = _named_parts(t)
    chars = _name_chars(parts).withColumns({"x": C("idx").cast("double"), "y": L(0.5)})
    boxes = parts.select("p_partkey", L(2.0).alias("l"), L(0.0).alias("b"), L(5.0).alias("r"), L(1.0).alias("t"))
    return search.text_in_boxes(chars, boxes, ["p_partkey"], []).select("p_partkey", "text")


_CUSTOMER_CELLS = "SELECT o_custkey AS doc, o_orderkey AS part, v.y, v.x, v.head, v.text FROM orders, LATERAL (VALUES (0, 0, TRUE, 'Status'), (0, 1, TRUE, 'Priority'), (1, 0, FALSE, o_orderstatus), (1, 1, FALSE, o_orderpriority)) v(y, x, head, text)"


def _customer_tables(t):
    """A small table an order: a header row and a row of values."""
    cell = lambda y, x, head, text: F.struct(L(y).alias("y"), L(x).alias("x"), L(1).alias("rowspan"), L(1).alias("colspan"), L(head).alias("head"), text.alias("text"))
    cells = F.array(cell(0, 0, True, L("Status")), cell(0, 1, True, L("Priority")), cell(1, 0, False, C("o_orderstatus")), cell(1, 1, False, C("o_orderpriority")))
    return t("orders").select(C("o_custkey").alias("doc"), C("o_orderkey").alias("part"), F.explode(cells).alias("c")).select("doc", "part", "c.*")


@query("q120_append_below", f"WITH c AS ({_CUSTOMER_CELLS}), n AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY part) AS k FROM c) SELECT doc, (CASE WHEN head THEN 0 ELSE k END)::INT AS y, x::INT AS x, head, text FROM n WHERE NOT head OR k = 1")
def _(t, spark):
    return tables.appended_below(_customer_tables(t), ["doc"], "part").select("doc", "y", "x", "head", "text")


@query("q121_append_beside", "WITH c AS (SELECT n_regionkey % 2 AS doc, n_regionkey AS part, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS y, n_name AS text FROM nation), s AS (SELECT doc, part, max(y) + 1 AS h FROM c GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY part) - 1 AS x, max(h) OVER (PARTITION BY doc) AS al FROM s) SELECT doc::INT AS doc, y::INT AS y, x::INT AS x, (CASE WHEN y + 1 = h THEN 1 + al - h ELSE 1 END)::INT AS rowspan, text FROM c JOIN z USING (doc, part)")
def _(t, spark):
    y = F.row_number().over(sequence.ordered(["n_regionkey"], "n_nationkey")) - 1
    cells = t("nation").select((C("n_regionkey") % 2).cast("int").alias("doc"), C("n_regionkey").alias("part"), y.alias("y"), L(0).alias("x"), L(1).alias("rowspan"), L(1).alias("colspan"), L(False).alias("head"), C("n_name").alias("text"))
    return tables.appended_beside(cells, ["doc"], "part").select("doc", "y", "x", "rowspan", "text")


@query("q122_table_html", f"WITH c AS ({_CUSTOMER_CELLS}), r AS (SELECT doc, part, y, string_agg('<' || CASE WHEN head THEN 'th' ELSE 'td' END || '>' || text || '</' || CASE WHEN head THEN 'th' ELSE 'td' END || '>', '' ORDER BY x) AS l FROM c GROUP BY ALL) SELECT doc, part, '<table>' || string_agg('<tr>' || l || '</tr>', '' ORDER BY y) || '</table>' AS html FROM r GROUP BY ALL")
def _(t, spark):
    return tables.as_html(_customer_tables(t), ["doc", "part"]).select("doc", "part", "html")


@query("q123_table_text", f"WITH c AS ({_CUSTOMER_CELLS}), r AS (SELECT doc, part, y, '| ' || string_agg(text, ' | ' ORDER BY x) || ' |' AS l FROM c GROUP BY ALL) SELECT doc, part, string_agg(l, chr(10) ORDER BY y) AS text FROM r GROUP BY ALL")
def _(t, spark):
    return tables.as_text(_customer_tables(t), ["doc", "part"]).select("doc", "part", "text")


_NODES = "SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type, event_id FROM events"


def _event_nodes(t):
    return t("events").select(C("user_id").alias("doc"), F.row_number().over(sequence.ordered(["user_id"], "ts", "event_id")).alias("ord"), "event_type", "event_id")


@query("q124_table_groups", f"WITH n AS ({_NODES}), k AS (SELECT *, event_type IN ('view', 'click', 'purchase') AS tab, CASE WHEN event_type = 'view' THEN event_id % 3 END AS number FROM n), p AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv <> tab THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run, sum(CASE WHEN pe IS NULL OR pe <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS same FROM (SELECT *, lag(tab) OVER (PARTITION BY doc ORDER BY ord) AS pv, lag(event_type) OVER (PARTITION BY doc ORDER BY ord) AS pe FROM k)), c AS (SELECT *, coalesce(nullif(number, 0), last_value(nullif(number, 0) IGNORE NULLS) OVER (PARTITION BY doc, run ORDER BY ord ROWS UNBOUNDED PRECEDING)) AS own FROM p WHERE tab), z AS (SELECT doc, ord, CASE WHEN event_type = 'click' THEN 'register:' || same WHEN event_type = 'purchase' THEN 'bits:' || same WHEN own IS NOT NULL THEN 'number:' || own ELSE 'alone:' || ord END AS grp FROM c) SELECT doc, ord::INT AS ord, grp, (row_number() OVER (PARTITION BY doc, grp ORDER BY ord) - 1)::INT AS part FROM z")
def _(t, spark):
    kind = F.when(C("event_type") == "view", "table").when(C("event_type") == "click", "register").when(C("event_type") == "purchase", "bits")
    nodes = _event_nodes(t).select("doc", "ord", F.when(kind.isNotNull(), "table").otherwise(C("event_type")).alias("name"), kind.alias("type"), F.when(kind == "table", C("event_id") % 3).otherwise(0).alias("number"))
    return tables.table_groups(nodes, ["doc"], "ord").select("doc", "ord", C("group").alias("grp"), "part")


@query("q125_bit_tables", f"WITH n AS ({_NODES}), k AS (SELECT *, (ord - 1) // 10 AS page FROM n), l AS (SELECT *, lag(event_type || ':' || page) OVER (PARTITION BY doc ORDER BY ord) AS p FROM k), i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type || ':' || page THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS tab FROM l), y AS (SELECT *, row_number() OVER (PARTITION BY doc, tab ORDER BY ord) - 1 AS y FROM i WHERE event_type = 'click') SELECT doc, tab::INT AS tab, y::INT AS y, x::INT AS x, CASE WHEN x = 0 THEN 'Bit ' || y ELSE 'e' || event_id END AS text FROM y, generate_series(0, 1) g(x)")
def _(t, spark):
    nodes = _event_nodes(t).select("doc", "ord", F.when(C("event_type") == "click", "bit").otherwise(C("event_type")).alias("name"), F.floor((C("ord") - 1) / 10).alias("page"), L("").alias("bits"), F.concat(L("e"), "event_id").alias("description"))
    cells = tables.bit_tables(nodes, ["doc"], "ord")
    return cells.select("doc", C("table").alias("tab"), "y", "x", F.when(C("x") == 0, F.concat(L("Bit "), "y")).otherwise(C("text")).alias("text"))


def _region_tree(t):
    r = t("region").select(L(1).cast("bigint").alias("doc"), C("r_regionkey").cast("bigint").alias("node"), L(None).cast("bigint").alias("parent"), C("r_regionkey").cast("int").alias("ord"), L("heading").alias("name"), C("r_name").alias("text"))
    n = t("nation").select(L(1).cast("bigint"), (C("n_nationkey") + 100).cast("bigint"), C("n_regionkey").cast("bigint"), C("n_nationkey").cast("int"), L("para"), "n_name")
    return r.union(n)


@query("q126_reverse_preorder", "WITH n AS (SELECT r_regionkey AS node, r_regionkey AS a, -1 AS b FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, n_nationkey FROM nation) SELECT node::BIGINT AS node, (row_number() OVER (ORDER BY a DESC, b DESC) - 1)::INT AS reverse FROM n")
def _(t, spark):
    return tree.reverse_order(tree.paths(_region_tree(t))).select("node", "reverse")


@query("q127_printed_tree", "WITH n AS (SELECT r_regionkey AS a, -1 AS b, 'heading: ' || r_name AS l FROM region UNION ALL SELECT n_regionkey, n_nationkey, '  para: ' || n_name FROM nation) SELECT string_agg(l, chr(10) ORDER BY a, b) AS text FROM n")
def _(t, spark):
    return tree.printed(tree.paths(_region_tree(t))).select("text")


@query("q128_page_markers", "SELECT n_nationkey % 4 AS page, arg_min(n_nationkey + 100, n_regionkey * 1000 + n_nationkey)::BIGINT AS node FROM nation GROUP BY 1")
def _(t, spark):
    pathed = tree.paths(_region_tree(t)).withColumn("page", ((C("node") - 100) % 4).cast("int"))
    return tree.page_markers(pathed.where("name = 'para' or doc is not null")).select("page", "node")


@query("q129_relative_x", "SELECT event_id, CASE WHEN event_type = 'click' THEN floor(value) ELSE value END - 10 AS x FROM events")
def _(t, spark):
    nodes = t("events").select("event_id", F.when(C("event_type") == "click", "listb").otherwise("para").alias("name"), C("value").alias("x"), C("value").alias("left"), L(10.0).alias("area_x"))
    return tree.relative_x(nodes).select("event_id", "x")


@query("q130_option_products", "SELECT n_nationkey, 'N' || n_nationkey || pin || size || 'T' || temp || var AS code, vd AS variant FROM nation, (VALUES ('C'), ('R')) a(pin), (VALUES ('8'), ('B')) b(size), (VALUES ('6'), ('7')) c(temp), (VALUES ('', 'normal'), ('N', 'x = N')) d(var, vd)")
def _(t, spark):
    rows = [("Pin count", "C", "48"), ("Pin count", "R(1)", "64"), ("Flash size", "8", "64 KB"), ("Flash size", "B", "128 KB"), ("Package", "T", "LQFP"), ("Temperature range", "6", "85"), ("Temperature range", "7", "105"), ("Options", "xx", "x = N"), ("Options", "TR", "tape")]
    options = t("nation").select("n_nationkey", F.explode(F.array(*[F.struct(*[L(v).alias(k) for k, v in zip(("header", "value", "descr"), r)]) for r in rows])).alias("o")).select("n_nationkey", "o.*")
    stems = t("nation").select("n_nationkey", F.concat(L("N"), "n_nationkey").alias("stem"))
    found = products.option_products(stems, products.option_codes(options, ["n_nationkey"]), ["n_nationkey"], "stem")
    return found.select("n_nationkey", "code", F.element_at("options", "variant").alias("variant"))


@query("q131_packages", "SELECT p_partkey, v.package, v.family, p_size AS pins, v.filters FROM part, LATERAL (VALUES ('LQFP' || p_size, 'LQFP', 'SMPS'), ('UFQFPN' || p_size, 'UFQFPN', 'SMPS')) v(package, family, filters)")
def _(t, spark):
    d = t("part").select("p_partkey", F.concat(L("Pin number:LPQF"), "p_size", L("/UQFN"), "p_size", L(" with SMPS")).alias("domain"))
    return products.packages(d, "domain").select("p_partkey", "package", "family", "pins", F.array_join("filters", "+").alias("filters"))


@query("q132_register_rows", "SELECT l_orderkey, 'ADC_CR' || l_linenumber AS register, '0x' || l_linenumber AS \"offset\", bit::INT AS bit, 'F' || l_partkey AS field FROM lineitem, LATERAL (SELECT unnest(generate_series(0, l_suppkey % 3)) AS bit) WHERE l_returnflag <> 'N'")
def _(t, spark):
    text = F.when(C("l_returnflag") == "N", F.concat(L("Reserved "), "l_partkey")).otherwise(F.concat(L("F "), "l_partkey", L(" [7:0]")))
    cells = t("lineitem").select("l_orderkey", F.concat(L("ADC_CR "), "l_linenumber").alias("register"), F.concat(L("0x "), "l_linenumber").alias("offset"), F.concat(L("Bits:"), C("l_suppkey") % 3, L("-0")).alias("bits"), F.when(C("l_returnflag") == "N", L("Reserved")).otherwise(text).alias("field"))
    return registers.register_rows(cells, ["l_orderkey"])


@query("q133_peripheral_types", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'OTG' WHEN p_partkey % 3 = 1 THEN 'TIM' ELSE 'Z' || p_size END AS type, CASE WHEN p_partkey % 3 = 1 THEN '^TIM' || p_size || '$' END AS instances FROM part")
def _(t, spark):
    k = C("p_partkey") % 3
    caption = F.when(k == 0, "USB OTG_FS map").when(k == 1, F.concat(L("TIM"), "p_size", L(" register map"))).otherwise("map")
    names = F.when(k == 1, F.array(F.concat(L("TIM"), "p_size", L("_CR1")))).otherwise(F.array(L("A_CR"), F.concat(L("Z"), "p_size", L("_SR"))))
    return t("part").select("p_partkey", registers.peripheral_type(caption, names).alias("type"), F.array_join(F.element_at(registers.caption_filters(caption), "instances"), ",").alias("instances"))


@query("q134_expanded_offsets", "SELECT p_partkey, v.name, v.o::BIGINT AS byte_offset FROM part, LATERAL (SELECT 'R' || i AS name, p_size + 4 * i AS o FROM generate_series(0, 3) g(i) WHERE p_partkey % 3 = 0 UNION ALL SELECT 'R' || i, 16 + p_size * i FROM generate_series(1, 3) g(i) WHERE p_partkey % 3 = 1 UNION ALL SELECT 'R' || i, CASE i WHEN 0 THEN p_size ELSE 255 END FROM generate_series(0, 1) g(i) WHERE p_partkey % 3 = 2) v")
def _(t, spark):
    k, size = C("p_partkey") % 3, F.concat(L("0x"), F.hex("p_size"))
    text = F.when(k == 0, F.concat(size, L(" - 0x"), F.hex(C("p_size") + 12))).when(k == 1, F.concat(L("0x10 + "), size, L("*x (x=1..3)"))).otherwise(F.concat(size, L(" or 0xFF")))
    return registers.expanded_offsets(t("part").select("p_partkey", L("Rx").alias("name"), text.alias("offset")), "offset", "name").select("p_partkey", "name", "byte_offset")


@query("q135_linked_types", "SELECT DISTINCT p_brand AS name, CASE p_brand WHEN 'Brand#11' THEN 'Brand#11' ELSE CASE WHEN contains(p_brand, '#2') THEN '#2' ELSE 'other' END END AS type, CASE p_brand WHEN 'Brand#11' THEN 0 ELSE CASE WHEN contains(p_brand, '#2') THEN 1 ELSE 2 END END AS level FROM part")
def _(t, spark):
    instances = t("part").select(C("p_brand").alias("name")).distinct().withColumn("sections", F.array(L("9.1")))
    types = spark.createDataFrame([("Brand#11", "1"), ("#2", "2"), ("other", "9.1")], "type string, section string")
    return registers.linked_types(instances, types).select("name", "type", "level")


@query("q136_matched_fields", "SELECT p_partkey, 'CR' || p_size % 4 AS register, 'F' || p_size AS field, p_size % 8 AS position, 1 + p_size % 5 AS width FROM part")
def _(t, spark):
    stem = F.concat(L("P_CR"), C("p_size") % 4, L("_F"), "p_size")
    mask = F.expr("shiftleft(shiftleft(1L, 1 + p_size % 5) - 1, p_size % 8)")
    macro = lambda name, number: F.struct(name.alias("name"), number.cast("bigint").alias("number"))
    macros = t("part").select("p_partkey", F.explode(F.array(macro(F.concat(stem, L("_Pos")), C("p_size") % 8), macro(F.concat(stem, L("_Msk")), mask), macro(stem, mask), macro(F.concat(L("P_CR"), C("p_size") % 4, L("_NO_Pos")), L(1)))).alias("m")).select("p_partkey", "m.*")
    own = t("part").select("p_partkey", F.concat(L("CR"), C("p_size") % 4).alias("register"), F.concat(L("P_CR"), C("p_size") % 4, L("_")).alias("prefix"))
    return registers.matched_fields(own, macros, ["p_partkey"])


@query("q137_flattened_structs", "WITH m AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS ord, l_partkey, CASE WHEN l_returnflag = 'A' THEN 4 ELSE 2 END AS size, l_partkey % 3 AS n FROM lineitem), s AS (SELECT *, coalesce(sum(size * greatest(n, 1)) OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM m) SELECT l_suppkey, 'T' || l_orderkey AS type, CASE WHEN n = 0 THEN 'M' || l_partkey ELSE 'M' || l_partkey || '.' || i END AS name, (base + i * size)::BIGINT AS byte_offset, size::INT AS size FROM s, LATERAL (SELECT unnest(generate_series(0, greatest(n, 1) - 1)) AS i)")
def _(t, spark):
    ord_ = F.row_number().over(sequence.ordered(["l_suppkey", "l_orderkey"], "l_linenumber", "l_partkey")) - 1
    members = t("lineitem").select("l_suppkey", F.concat(L("T"), "l_orderkey").alias("type"), ord_.alias("ord"), F.when(C("l_returnflag") == "A", "uint32_t").otherwise("uint16_t").alias("member_type"), F.concat(L("M"), "l_partkey").alias("name"), (C("l_partkey") % 3).cast("int").alias("count"))
    return registers.flattened(members, ["l_suppkey"]).select("l_suppkey", "type", "name", "byte_offset", "size")


@query("q138_interrupt_tables", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN starts_with(p_brand, 'Brand#1') THEN 'V:Device=brand#1' WHEN p_size % 2 = 0 THEN NULL ELSE 'W' END AS tab FROM part")
def _(t, spark):
    names = F.when(C("p_size") % 2 == 0, F.array(L("V:Device=brand#1"), L("U:Core=m4"), L("W"))).otherwise(F.array(L("V:Device=brand#1"), L("W")))
    return t("part").select("p_partkey", registers.interrupt_table(names, C("p_brand"), C("p_size") % 5 == 0).alias("tab"))


@query("q139_mixed_functions", "SELECT l_partkey, l_returnflag, array_to_string(list_sort(list(DISTINCT l_linenumber)), '-') AS label FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber) > 1")
def _(t, spark):
    return evaluate.mixed(t("lineitem"), ["l_partkey", "l_returnflag"], "l_linenumber", "label")


@query("q140_named_sources", "WITH s AS (SELECT l_partkey, l_returnflag, array_to_string(list_sort(list(DISTINCT l_linestatus)), '+') AS s FROM lineitem GROUP BY ALL) SELECT l_partkey, string_agg(l_returnflag || '=' || s, ',' ORDER BY l_returnflag) AS names FROM s GROUP BY 1 HAVING count(*) > 1")
def _(t, spark):
    found = evaluate.named_sources(t("lineitem"), ["l_partkey"], "l_returnflag", "l_linestatus")
    return found.select("l_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("names")), lambda e: F.concat(e["key"], L("="), e["value"])), ",").alias("names"))


@query("q141_specialised_lines", f"SELECT {_KSQL}, CASE WHEN l_linenumber = 1 THEN 'vertical' ELSE 'horizontal' END AS kind, CASE WHEN l_linenumber = 1 THEN l_quantity ELSE l_partkey END AS at, least(CASE WHEN l_linenumber = 1 THEN l_partkey ELSE l_quantity END, CASE WHEN l_linenumber = 1 THEN l_partkey + 2 ELSE l_quantity - 3 END) AS lo FROM lineitem WHERE l_linenumber <= 2")
def _(t, spark):
    up = C("l_linenumber") == 1
    q, p = C("l_quantity"), C("l_partkey").cast("double")
    line = g.specialised(q, p, F.when(up, q).otherwise(q - 3), F.when(up, p + 2).when(C("l_linenumber") == 2, p).otherwise(p + 1))
    return t("lineitem").select(*_KEY, line.alias("s")).where("s is not null").select(*_KEY, "s.kind", "s.at", "s.lo")


@query("q142_turned_boxes", f"WITH r AS (SELECT {_KSQL}, {_BOX} FROM lineitem) SELECT {_KSQL}, -t AS l, l AS b, -b AS r, r AS t FROM r")
def _(t, spark):
    return t("lineitem").select(*_KEY, g.rotated(_box(), 90).alias("x")).select(*_KEY, "x.*")


@query("q143_ruling_lines", f"WITH r AS (SELECT {_KSQL}, {_BOX} FROM lineitem) SELECT {_KSQL}, count(*)::BIGINT AS n, min(side) AS side FROM (SELECT {_KSQL}, CASE WHEN t - b <= 0 AND (r - l > 0 OR r - l >= t - b) THEN 'level' WHEN r - l <= 0 THEN 'upright' ELSE s END AS side FROM r, (VALUES ('left'), ('right'), ('bottom'), ('top')) v(s) WHERE NOT (t - b <= 0 OR r - l <= 0) OR s = 'left') GROUP BY ALL")
def _(t, spark):
    return t("lineitem").select(*_KEY, F.explode(g.ruling_lines(_box(), 0.0)).alias("e")).groupBy(*_KEY).agg(one().alias("n"), F.min("e.side").alias("side"))


@query("q144_char_styles", "SELECT event_id, (CASE WHEN event_type = 'click' THEN 'b,' ELSE '' END) || (CASE WHEN event_id % 2 = 0 THEN 'u,' ELSE '' END) || CASE WHEN value > 2.5 * 40 THEN 'sup' ELSE 'n' END AS styles FROM events")
def _(t, spark):
    font = F.when(C("event_type") == "click", "Arial-Bold").otherwise("Arial")
    styles = g.char_style(font, C("value"), L(90.0), L(40.0), C("event_id") % 2 == 0)
    return t("events").select("event_id", F.concat(F.when(F.array_contains(styles, "b"), "b,").otherwise(""), F.when(F.array_contains(styles, "u"), "u,").otherwise(""), F.when(F.array_contains(styles, "sup"), "sup").otherwise("n")).alias("styles"))


@query("q145_latest_by_version", "SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 12, o_orderkey % 7, o_orderkey)) AS latest FROM orders GROUP BY 1")
def _(t, spark):
    rows = t("orders").select(C("o_custkey").cast("string").alias("title"), F.concat(L("v"), C("o_orderkey") % 12, L("."), C("o_orderkey") % 7, L("."), "o_orderkey").alias("version"), "o_orderkey", "o_custkey")
    return catalog.latest(rows, "title", "version").select("o_custkey", C("o_orderkey").alias("latest"))


@query("q146_namespaced_edges", "SELECT 'f' || n_regionkey || ':' || n_name AS subject, 'f' || n_regionkey || ':' || r_name AS object, 'f' || n_regionkey AS ns FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t, spark):
    rows = t("nation").join(t("region"), C("n_regionkey") == C("r_regionkey")).select(C("n_name").alias("subject"), C("r_name").alias("object"), F.concat(L("f"), "n_regionkey").alias("family"))
    return graph.namespaced(rows, "family").select("subject", "object", "ns")


@query("q147_boundary_rows", "SELECT s_suppkey, v.name, s_suppkey * 16 AS lo, s_suppkey * 16 + 15 AS hi FROM supplier, LATERAL (VALUES ('T' || s_suppkey), ('U' || s_suppkey)) v(name) WHERE s_suppkey % 3 <> 0")
def _(t, spark):
    lo, hi = C("s_suppkey") * 16, C("s_suppkey") * 16 + 15
    rows = t("supplier").select("s_suppkey", F.concat(L("T"), "s_suppkey", L(", U"), "s_suppkey").alias("n"), F.concat(L("0x"), F.hex(hi), L(" - 0x"), F.hex(lo)).alias("a"), F.col("s_suppkey").cast("string").alias("bus"), F.when(C("s_suppkey") % 3 != 0, "Section 4.1").otherwise("none").alias("s"))
    return registers.boundary_rows(rows, "n", "a", "bus", "s").select(C("bus").cast("bigint").alias("s_suppkey"), "name", "lo", "hi")


@query("q148_captioned_tables", "SELECT r_regionkey::BIGINT AS doc, 'Table ' || r_regionkey || '. Pin definitions' AS caption FROM region")
def _(t, spark):
    pages = t("region").select("r_regionkey", F.concat(L("<p>Table "), "r_regionkey", L(". Pin definitions</p><table><tr><td>1</td></tr></table><p>Table 9. Other</p><table><tr><td>2</td></tr></table>")).alias("html"))
    docs = t("region").select(C("r_regionkey").cast("bigint").alias("doc"))
    return html.only(html.tables(html.items(pages, "r_regionkey", "html"), "pin +definition"), docs, "doc").select("doc", "caption")


@query("q149_merged_areas", f"WITH n AS ({_NODES}), h AS (SELECT *, event_type = 'signup' AS head FROM n) SELECT doc, event_id AS node, CASE WHEN NOT head THEN last_value(CASE WHEN head THEN event_id END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) END AS parent FROM h")
def _(t, spark):
    # An area ends with each heading, so what belongs to it stands in the next one.
    before = sequence.ordered(["doc"], "ord").rowsBetween(-(1 << 31), -1)
    area = F.coalesce(F.sum(F.when(C("event_type") == "signup", 1)).over(before), L(0)).cast("int")
    nodes = _event_nodes(t).select("doc", area.alias("area"), "ord", C("ord").cast("bigint").alias("node"), L(None).cast("bigint").alias("parent"), F.when(C("event_type") == "signup", "heading").otherwise("para").alias("name"), L(0.0).alias("x"), L(False).alias("italic"), "event_id")
    merged = tree.merged_areas(nodes, 10.0)
    heads = nodes.select("doc", C("node").alias("parent"), C("event_id").alias("head_id"))  # not from merged, which would be made twice
    return merged.join(heads, ["doc", "parent"], "left").select("doc", C("event_id").alias("node"), C("head_id").alias("parent"))


@query("q150_device_defines", "SELECT p_partkey, 'STM32F1' || lpad(CAST(p_size % 90 AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN 'x6' ELSE 'xB' END AS define FROM part")
def _(t, spark):
    name = F.lpad((C("p_size") % 90).cast("string"), 2, "0")
    devices = t("part").select("p_partkey", L("f1").alias("family"), name.alias("name"), F.when(C("p_partkey") % 2 == 0, "4").otherwise("8").alias("size"), L("c").alias("pin"), L("").alias("variant"))
    defines = t("part").select(F.explode(F.array(F.concat(L("STM32F1"), name, L("x6")), F.concat(L("STM32F1"), name, L("xB")))).alias("define")).distinct()
    return registers.device_define(devices, defines).select("p_partkey", "define")


@query("q151_title_chains", f"WITH n AS ({_NODES}), l AS (SELECT *, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS lv FROM n), a AS (SELECT *, last_value(CASE WHEN lv = 0 THEN ord END IGNORE NULLS) OVER w AS a0, last_value(CASE WHEN lv = 1 THEN ord END IGNORE NULLS) OVER w AS a1, last_value(CASE WHEN lv = 0 THEN event_id END IGNORE NULLS) OVER w AS e0, last_value(CASE WHEN lv = 1 THEN event_id END IGNORE NULLS) OVER w AS e1 FROM l WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT event_id, concat_ws('/', e0, CASE WHEN lv >= 1 AND a1 IS NOT NULL AND (a0 IS NULL OR a0 < a1) THEN e1 END, CASE WHEN lv = 2 THEN event_id END) AS chain FROM a")
def _(t, spark):
    nodes = _event_nodes(t).withColumn("level", F.when(C("event_type") == "signup", 0).when(C("event_type") == "click", 1).otherwise(2)).withColumn("title", C("event_id").cast("string"))
    return sequence.title_chain(nodes, ["doc"], "ord", "level", "title", 3).select("event_id", F.array_join("chain", "/").alias("chain"))


@query("q152_assigned_prefixes", "WITH p(x) AS (VALUES ('NATION_1'), ('NATION_'), ('NATION_2'), ('NATION_10')) SELECT n_name, x AS prefix FROM nation JOIN p ON starts_with(n_name, x) QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY length(x) DESC, x) = 1")
def _(t, spark):
    p = spark.createDataFrame([("NATION_1",), ("NATION_",), ("NATION_2",), ("NATION_10",)], "prefix string")
    return spatial.assigned(t("nation").select("n_name"), p, "n_name", "prefix")


@query("q153_prefix_outer", "WITH p(x) AS (VALUES ('NATION_1'), ('NATION_2')) SELECT n_nationkey, x AS prefix FROM nation LEFT JOIN p ON starts_with(n_name, x)")
def _(t, spark):
    p = spark.createDataFrame([("NATION_1",), ("NATION_2",)], "prefix string")
    return spatial.prefix_join(t("nation"), p, "n_name", "prefix", "left").select("n_nationkey", "prefix")


@query("q154_index_by_source", "SELECT l_orderkey, arg_max(l_partkey, (l_shipdate, l_partkey)) FILTER (WHERE l_returnflag = 'A') AS a, arg_max(l_partkey, (l_shipdate, l_partkey)) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def _(t, spark):
    wide = evaluate.index_by_source(t("lineitem").where("l_returnflag in ('A', 'R')"), ["l_orderkey"], "l_returnflag", ["A", "R"], "l_partkey", ["l_shipdate", "l_partkey"])
    return wide.select("l_orderkey", C("A").alias("a"), C("R").alias("r"))


@query("q155_totals", "SELECT l_shipmode_ AS line, sum(greatest(a, b))::BIGINT AS n, sum(greatest(greatest(a, b) - w, 0))::BIGINT AS correct, sum(w)::BIGINT AS wrong FROM (SELECT l_linenumber AS l_shipmode_, l_quantity::BIGINT AS a, (l_partkey % 50) AS b, l_suppkey % 9 AS w FROM lineitem) GROUP BY 1")
def _(t, spark):
    rows = t("lineitem").select(C("l_linenumber").alias("line"), C("l_quantity").cast("bigint").alias("a"), (C("l_partkey") % 50).alias("b"), (C("l_suppkey") % 9).alias("w"))
    return evaluate.totals(rows, ["line"], "a", "b", "w").select("line", C("all").alias("n"), "correct", "wrong")


@query("q156_whitelisted_pairs", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT ((l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O'))")
def _(t, spark):
    pairs = spark.createDataFrame([("F", "A"), ("N", "O")], "x string, y string")
    return evaluate.whitelisted(t("lineitem"), pairs, "l_returnflag", "l_linestatus").select("l_orderkey", "l_linenumber", "l_partkey")


@query("q157_driver_signals", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'kept' ELSE 'ignored' END AS kind FROM customer")
def _(t, spark):
    signals = t("customer").select("c_custkey", "c_nationkey", F.concat("c_mktsegment", L("_"), "c_custkey").alias("signal"))
    drivers = t("nation").select(C("n_nationkey").alias("c_nationkey"), F.explode(F.array(L("BUILD"), L("FURNITURE_"))).alias("driver"))
    kept, ignored = evaluate.driver_signals(signals, drivers, ["c_nationkey"], "signal", "driver")
    return kept.select("c_custkey", L("kept").alias("kind")).union(ignored.select("c_custkey", L("ignored")))


@query("q158_pin_rows", "SELECT p_partkey, v.package, v.position, 'P' || p_size AS name, p_type AS type FROM part, LATERAL (VALUES ('BGA', 'A' || p_size), ('LQFP', CAST(p_size AS VARCHAR)), ('LQFP', CAST(p_size + 1 AS VARCHAR))) v(package, position)")
def _(t, spark):
    size = C("p_size").cast("string")
    places = F.create_map(L("BGA"), F.concat(L("A"), size), L("LQFP"), F.concat(size, L("(1), "), (C("p_size") + 1).cast("string")), L("WLCSP"), L("-"))
    rows = t("part").select("p_partkey", F.concat(L("P"), size, L("(3)")).alias("name"), C("p_type").alias("type"), L("-").alias("structure"), L("-").alias("functions"), places.alias("positions"))
    return registers.pin_rows(rows, ["p_partkey"]).select("p_partkey", "package", "position", "name", "type")


@query("q159_vector_tables", "SELECT l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'VectorTable:Core=m4' ELSE 'VectorTable' END AS tab, l_linenumber AS position, string_agg(DISTINCT 'V' || l_partkey % 5, ',' ORDER BY 'V' || l_partkey % 5) AS names FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def _(t, spark):
    rows = t("lineitem").select("l_suppkey", F.when(C("l_returnflag") == "A", "Vectors (Cortex-M4)").otherwise("Vectors").alias("caption"), F.when(C("l_returnflag") == "N", "-").otherwise(C("l_linenumber").cast("string")).alias("position"), F.concat(L("V"), C("l_partkey") % 5).alias("name"))
    return registers.vector_tables(rows, ["l_suppkey"]).select("l_suppkey", C("table").alias("tab"), "position", F.array_join("names", ",").alias("names"))


@query("q160_graphic_clusters", f"WITH r AS (SELECT {_KSQL}, {_BOX} FROM lineitem), a AS (SELECT *, max(t) OVER (PARTITION BY l_orderkey ORDER BY b, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r), y AS (SELECT *, sum(CASE WHEN m IS NULL OR m < b THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY b, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS region FROM a), c AS (SELECT *, max(r) OVER (PARTITION BY l_orderkey, region ORDER BY l, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM y) SELECT {_KSQL}, region::BIGINT AS region, (sum(CASE WHEN n IS NULL OR n < l THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, region ORDER BY l, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))::BIGINT AS subregion FROM c")
def _(t, spark):
    rows = t("lineitem").select(*_KEY, F.struct("l_partkey", "l_suppkey").alias("tie"), _box().alias("box"))
    return layout.graphic_clusters(rows, ["l_orderkey"], "tie").select(*_KEY, "region", "subregion")


@query("q161_captions_side_by_side", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce((lag(l_partkey) OVER w + l_partkey) / 2.0, 0)::DOUBLE AS \"left\" FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey)")
def _(t, spark):
    rows = t("lineitem").select(*_KEY, (C("l_partkey") + 0.0).alias("part"), L(1).alias("y"), L(1e6).alias("width"), F.struct("l_partkey", "l_linenumber", "l_suppkey").alias("tie"))
    w = sequence.ordered(["l_orderkey"], "tie")
    # Equal places are told apart by the rest of the key, as the query's SQL does.
    placed = rows.withColumn("x", C("part") + F.row_number().over(w) * 1e-9)
    return layout.side_by_side(placed, ["l_orderkey"], "y", "x", "width").select(*_KEY, F.round("left", 3).alias("left"))


@query("q162_graphic_classes", "SELECT l_orderkey, CASE WHEN max((l_returnflag = 'R')::INT) = 1 THEN 'figure' WHEN 2 * sum((l_returnflag = 'A' AND l_linestatus = 'F')::INT) > count(*) OR 3 * sum(l_linenumber) >= 2 * sum(l_quantity) THEN 'table' ELSE 'figure' END AS class FROM lineitem GROUP BY 1")
def _(t, spark):
    kind = F.when(C("l_returnflag") == "R", "image").when(C("l_returnflag") == "A", "line").otherwise("other")
    paths = t("lineitem").select("l_orderkey", kind.alias("kind"), (C("l_linestatus") == "F").alias("stroked"), C("l_linenumber").alias("corners"), C("l_quantity").alias("points"))
    return layout.graphic_class(paths, ["l_orderkey"])


@query("q163_cell_borders", "WITH b(ord, pos, lo, hi, width) AS (VALUES (0, 10.0, 0.0, 4.0, 2.0), (1, 11.0, 2.0, 9.0, 3.0), (2, 30.0, 0.0, 9.0, 1.0)) SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, coalesce((SELECT arg_min(width, ord) FROM b WHERE abs(pos - l_quantity) <= 1 AND l_linenumber + 0.5 BETWEEN lo AND hi), 0)::DOUBLE AS l FROM lineitem")
def _(t, spark):
    cells = t("lineitem").select(L(1).alias("tab"), *_KEY, "l_quantity", C("l_quantity").alias("l"), C("l_linenumber").cast("double").alias("b"), (C("l_quantity") + 100).alias("r"), (C("l_linenumber") + 1).cast("double").alias("t"))
    lines = spark.createDataFrame([(1, 0, "vertical", 10.0, 0.0, 4.0, 2.0), (1, 1, "vertical", 11.0, 2.0, 9.0, 3.0), (1, 2, "vertical", 30.0, 0.0, 9.0, 1.0)], "tab int, ord int, direction string, at double, lo double, hi double, width double")
    return layout.cell_borders(cells, lines, ["tab"], [*_KEY, "l_quantity"], 1.0).select(*_KEY, "l_quantity", "l")


@query("q164_selected_packages", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'LQFP' || p_size ELSE 'LQFP' END AS name FROM part")
def _(t, spark):
    devices = t("part").select("p_partkey", F.concat(L("dev"), C("p_size") % 2).alias("device"), F.concat(L("LQFP"), "p_size").alias("package"))
    packages = t("part").select("p_partkey", F.explode(F.array(F.struct(F.concat(L("LQFP"), "p_size").alias("name"), F.array(L("DEV0")).alias("filters")), F.struct(L("LQFP").alias("name"), F.array().cast("array<string>").alias("filters")))).alias("p")).select("p_partkey", "p.*")
    return registers.selected_packages(devices, packages, ["p_partkey"]).select("p_partkey", "name")


@query("q165_object_links", "WITH k(id, l, r) AS (VALUES (1, 0.0, 100.0), (2, 50.0, 150.0)) SELECT event_id, arg_max(id, id) AS target FROM events JOIN k ON value BETWEEN l AND r GROUP BY 1")
def _(t, spark):
    chars = t("events").select(L(1).alias("page"), "event_id", C("value").alias("x"), L(1.0).alias("y"))
    links = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 2.0, 1, 1), (1, 50.0, 0.0, 150.0, 2.0, 2, 2)], "page int, l double, b double, r double, t double, target int, ord int")
    return layout.object_linked(chars, links, ["page"], "event_id").select("event_id", "target")


@query("q166_split_around", "WITH o AS (SELECT l_orderkey AS k, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM lineitem), m AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o), i AS (SELECT *, sum(CASE WHEN p IS NULL OR p < lo THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m), z AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY k, g), s AS (SELECT k, lag(hi) OVER (PARTITION BY k ORDER BY lo) AS prev, lo, hi, lead(lo) OVER (PARTITION BY k ORDER BY lo) AS nxt FROM z) SELECT k, count(*)::BIGINT AS n, sum(h)::DOUBLE AS height FROM (SELECT k, lo - coalesce(prev, 0) AS h FROM s UNION ALL SELECT k, 60 - hi FROM s WHERE nxt IS NULL) WHERE h >= 3 GROUP BY 1")
def _(t, spark):
    objects = t("lineitem").select(C("l_orderkey").alias("k"), C("l_quantity").alias("olo"), (C("l_quantity") + C("l_linenumber")).alias("ohi"))
    areas = objects.select("k").distinct().select("k", L(0.0).alias("lo"), L(60.0).alias("hi"))
    return layout.split_around(areas, objects, ["k"], 3.0).where("kind = 'text'").groupBy("k").agg(one().alias("n"), F.sum(C("hi") - C("lo")).alias("height"))


@query("q167_heading_texts", "SELECT r_regionkey::BIGINT AS doc, '-1' AS title, 'above' AS texts FROM region UNION ALL SELECT n_regionkey::BIGINT, r_name || ' 1', string_agg(n_name, '|' ORDER BY n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL UNION ALL SELECT r_regionkey::BIGINT, r_name || ' 2', 'x|y' FROM region")
def _(t, spark):
    rows = t("nation").join(t("region"), C("n_regionkey") == C("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.concat(L("<p>"), s["n_name"], L("</p>"))), "").alias("n"))
    pages = rows.select("r_regionkey", F.concat(L("<p>above</p><h1>"), "r_name", L(" 1</h1>"), "n", L("<h2>"), "r_name", L(" 2</h2><p>x</p><table><tr><td>1</td></tr></table><p><b>y</b></p>")).alias("html"))
    return html.heading_texts(html.items(pages, "r_regionkey", "html")).select("doc", "title", F.array_join("texts", "|").alias("texts"))


@query("q168_items_by_type", "SELECT 'heading' AS type, count(*)::BIGINT AS n, sum(length(c_name))::BIGINT AS chars FROM customer UNION ALL SELECT 'text', 2 * count(*), sum(length(c_mktsegment) + length(CAST(c_custkey AS VARCHAR)))::BIGINT FROM customer UNION ALL SELECT 'table', count(*), 0 FROM customer")
def _(t, spark):
    pages = t("customer").select("c_custkey", F.concat(L("<h1>"), "c_name", L("</h1><p><i>"), "c_mktsegment", L("</i></p><ul><li>"), "c_custkey", L("</li></ul><table><tr><td>1</td></tr></table>")).alias("html"))
    found = html.items(pages, "c_custkey", "html").groupBy("type").agg(one().alias("n"), F.sum(F.when(C("type") != "table", F.length("text")).otherwise(0)).alias("chars"))
    return found


@query("q169_asof_by_day", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS parent FROM events")
def _(t, spark):
    days = t("events").withColumn("day", F.to_date("ts"))
    return sequence.split_asof(days, ["user_id"], "day", ["ts", "event_id"], C("event_type") == "signup", C("event_id")).select("event_id", "parent")


_STEM = "'Customer#00000' || CASE p_partkey % 4 WHEN 0 THEN lpad({0}, 4, '0') WHEN 1 THEN left(lpad({0}, 4, '0'), 3) || 'x' WHEN 2 THEN left(lpad({0}, 4, '0'), 2) || 'x' || right({0}, 1) ELSE 'x' || right(lpad({0}, 4, '0'), 3) END"


@query("q172_exclusive_patterns", f"WITH f AS (SELECT DISTINCT {_STEM.format('(p_partkey % 10000)::VARCHAR')} AS stem FROM part), n AS (SELECT stem, regexp_replace(stem, 'x+$', '') AS name FROM f), p AS (SELECT name, min(stem) AS stem FROM n GROUP BY 1) SELECT c_name AS device, stem FROM customer JOIN p ON c_name LIKE replace(name, 'x', '_') || '%' QUALIFY row_number() OVER (PARTITION BY c_name ORDER BY length(name) DESC, length(name) - length(replace(name, 'x', '')), greatest(strpos(name, 'x') - 1, 0), name) = 1")
def _(t, spark):
    files = t("part").select(F.expr(_STEM.format("string(p_partkey % 10000)")).alias("stem"))
    return spatial.devices_of_files(t("customer").select(F.lower("c_name").alias("low"), C("c_name").alias("device")), files, "device", "stem")


def _event_tree(events):
    """Users, their kinds of events, and the hundreds of values of these, as nodes by path; n counts the events of a leaf."""
    e = events.select(C("user_id").alias("doc"), "event_type", F.floor(C("value") / 100).cast("string").alias("k"))
    kind = F.concat(L("u/"), "event_type")
    leaves = e.groupBy("doc", kind.alias("parent"), "k").agg(one().alias("n")).select("doc", F.concat("parent", L("/"), "k").alias("node"), "parent", C("k").alias("label"), "n")
    kinds = e.select("doc", kind.alias("node"), L("u").alias("parent"), C("event_type").alias("label"), L(0).cast("bigint").alias("n")).distinct()
    return leaves.union(kinds).union(e.select("doc", L("u").alias("node"), L(None).cast("string").alias("parent"), L("u").alias("label"), L(0).cast("bigint").alias("n")).distinct())


_TREES = "WITH e AS (SELECT user_id AS doc, event_type AS ty, floor(value / 100)::BIGINT::VARCHAR AS k FROM events), f AS (SELECT DISTINCT * FROM e), t AS (SELECT doc, ty, ty || '(' || string_agg(k, ',' ORDER BY k) || ')' AS canon, count(*) + 1 AS size FROM f GROUP BY 1, 2), u AS (SELECT doc, 'u(' || string_agg(canon, ';' ORDER BY canon) || ')' AS canon, sum(size) + 1 AS size FROM t GROUP BY 1), n AS (SELECT f.doc, 'u/' || f.ty || '/' || k AS node, k AS canon, 1 AS size, t.canon AS up FROM f JOIN t ON f.doc = t.doc AND f.ty = t.ty UNION ALL SELECT t.doc, 'u/' || ty, t.canon, t.size, u.canon FROM t JOIN u ON t.doc = u.doc UNION ALL SELECT doc, 'u', canon, size, NULL FROM u)"


@query("q173_equal_subtrees", f"{_TREES}, m AS (SELECT canon, count(*) AS copies, max(size) AS size, min((doc, node)) AS first FROM n GROUP BY 1 HAVING count(*) > 1), o AS (SELECT canon FROM n GROUP BY 1 HAVING count(DISTINCT coalesce(up, '')) = 1 AND max(up) IN (SELECT canon FROM m)) SELECT size::BIGINT AS size, copies::BIGINT AS copies, first[1] AS doc, first[2] AS node FROM m WHERE canon NOT IN (SELECT canon FROM o)")
def _(t, spark):
    digested = subtrees.digests(_event_tree(t("events")), [C("label")])
    return subtrees.equal_subtrees(digested).select("size", "copies", "doc", "node")


_HALF = "SELECT user_id AS doc, 'u/' || event_type AS ty, 'u/' || event_type || '/' || floor(value / 100)::BIGINT AS node, count(*) AS n FROM events WHERE hour(ts) {0} 12 GROUP BY ALL"


def _side(half):
    return f"(SELECT doc, node, ty AS parent, n FROM {half} UNION ALL SELECT DISTINCT doc, ty, 'u', 0 FROM {half} UNION ALL SELECT DISTINCT doc, 'u', NULL, 0 FROM {half})"


@query("q174_tree_difference", f"WITH a AS ({_HALF.format('<')}), b AS ({_HALF.format('>=')}), l AS {_side('a')}, r AS {_side('b')}, d AS (SELECT coalesce(l.doc, r.doc) AS doc, coalesce(l.parent, r.parent) AS parent, l.node AS l_node, r.node AS r_node, l.n AS ln, r.n AS rn FROM l FULL JOIN r ON l.doc = r.doc AND l.node = r.node), k AS (SELECT doc, l_node AS node FROM d WHERE l_node IS NOT NULL AND r_node IS NOT NULL) SELECT doc, l_node, r_node, CASE WHEN l_node IS NULL THEN 'added' WHEN r_node IS NULL THEN 'removed' ELSE 'changed' END AS what FROM d WHERE (l_node IS NULL OR r_node IS NULL OR ln <> rn) AND (parent IS NULL OR EXISTS (SELECT 1 FROM k WHERE k.doc = d.doc AND k.node = d.parent))")
def _(t, spark):
    halves = [_event_tree(t("events").where(F.hour("ts") < 12)), _event_tree(t("events").where(F.hour("ts") >= 12))]
    return subtrees.difference(*halves, "label", [C("label"), C("n")])


_WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+')"


@query("q175_found_phrases", f"WITH d AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT DISTINCT lower(text) AS phrase FROM benchmark UNION SELECT array_to_string(w[2:4], ' ') FROM d WHERE len(w) >= 4), q AS (SELECT phrase, array_to_string({_WORDS.format('phrase')}, ' ') AS f FROM p), t AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS j FROM d) SELECT doc_id, phrase, len(string_split(left(j, strpos(j, ' ' || f || ' ')), ' ')) - 2 AS word FROM t JOIN q ON contains(j, ' ' || f || ' ')")
def _(t, spark):
    docs = t("documents").select("doc_id", F.lower("text").alias("text"))
    w, gap = f"[{search.LETTER}]++", f"[^{search.LETTER}]++"
    opening = F.regexp_extract("text", f"^[^{search.LETTER}]*+{w}{gap}({w}{gap}{w}{gap}{w})", 1)
    openings = docs.select(F.regexp_replace(opening, gap, " ").alias("phrase"))
    phrases = t("benchmark").select(F.lower("text").alias("phrase")).union(openings).distinct()
    return search.found_phrases(docs, phrases, "doc_id", "text", "phrase").groupBy("doc_id", "phrase").agg(F.min("word").cast("bigint").alias("word"))


def _hosts(pages):
    """Of each page its host and links, and of each host its pages: two stages."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    links = F.size(F.regexp_extract_all("html", L("(?i)<a "), L(0)))
    return [
        rebuild.Stage("pages", "page_id", lambda d: d.select("page_id", host.alias("host"), links.alias("links"), F.length("html").alias("size"))),
        rebuild.Stage("hosts", "host", lambda d: d.groupBy("host").agg(one().alias("pages"), F.sum("links").alias("links"), F.max("size").cast("bigint").alias("longest"))),
    ]


@query("q176_incremental_rebuild", "SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, count(*)::BIGINT AS pages, sum(len(regexp_extract_all(html, '(?i)<a ')))::BIGINT AS links, max(length(html))::BIGINT AS longest FROM pages GROUP BY 1")
def _(t, spark):
    """Built from an earlier state of the table (its last page missing, its first one different, one more page) and then brought up to date."""
    pages, root = t("pages"), lineage.new_path(spark)
    ends = F.broadcast(pages.agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last")).withColumn("_one", L(1)))
    earlier = pages.withColumn("_one", L(1)).join(ends, "_one").where("page_id < _last").withColumn("html", F.when(C("page_id") == C("_first"), "<a >").otherwise(C("html")))
    gone = earlier.where("page_id = _first").withColumns({"page_id": L(-1).cast("bigint"), "url": L("http://gone.example/")})
    rebuild.rebuilt(earlier.unionByName(gone).select(*pages.columns), root, _hosts(pages))
    found, _ = rebuild.rebuilt(pages, root, _hosts(pages))
    return found.select("host", "pages", "links", "longest")


@query("q177_streamed_versions", "SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 12, o_orderkey % 7, o_orderkey)) AS latest FROM orders GROUP BY 1")
def _(t, spark):
    """The orders arrive in three batches by their keys' hash; each customer's latest is kept by the state."""
    root = lineage.new_path(spark)
    rows = t("orders").select(C("o_custkey").cast("string").alias("title"), F.concat(L("v"), C("o_orderkey") % 12, L("."), C("o_orderkey") % 7, L("."), "o_orderkey").alias("version"))
    rows.repartition(3, F.xxhash64("version")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    versions.start(versions.changes(stream, "title", C("version")), f"{root}/changes", f"{root}/state").awaitTermination()
    found = versions.current(spark.read.schema(f"{versions.CHANGES}, batch bigint").parquet(f"{root}/changes"))
    return found.select(C("doc").cast("bigint").alias("o_custkey"), F.element_at(F.split("version", r"\."), -1).cast("bigint").alias("latest"))


_FORMS = [  # peripheral, register, offset (with the size as {x}), elements: number from index 0 or 1, name and offset of element i
    ("HRTIM", "TIMxCR", "0x{x} or 0x1FF", 0, 2, "'TIM' || chr((65 + i)::INT) || 'CR'", "CASE i WHEN 0 THEN s ELSE 511 END"),
    ("SAI", "xCR1", "0x{x}(x=A)0x1FF(x=B)", 0, 2, "'CR1' || chr((65 + i)::INT)", "CASE i WHEN 0 THEN s ELSE 511 END"),
    ("FDCAN", "F1R2", "0x{x}", 0, 51, "'F' || (i + 3) // 2 || 'R' || ((i + 1) % 2 + 1)", "s + 4 * i"),
    ("GFXMMU", "LUT0H", "0x{x}", 0, 1023, "'LUT' || i || 'H'", "s + 8 * i"),
    ("HSEM", "C1R1", "0x{x}", 0, 30, "'C1R' || (i + 1)", "s + 4 * i"),
    ("RTC", "BKP0R", "0x50 - 0x5C", 0, 4, "'BKP' || i || 'R'", "80 + 4 * i"),
    ("MON", "UCFGR", "0x{x} + 0x10*x (x= moni-ring unit number)", 1, 5, "'UCFGR.' || i", "s + 16 * i"),
    ("DMA", "CxCR", "0x{x} + 4*channel number", 0, 16, "'C' || i || 'CR'", "s + 4 * i"),
    ("TIM", "CR1", "0x{x}", None, 1, "'CR1'", "s"),
]


@query("q183_register_forms", "WITH p AS (SELECT p_partkey, p_size AS s FROM part) " + " UNION ALL ".join(f"SELECT p_partkey, {n} AS name, ({o})::BIGINT AS byte_offset FROM p, generate_series({a or 0}, {(a or 0) + c - 1}) g(i) WHERE p_partkey % 27 = {k}" for k, (_, _, _, a, c, n, o) in enumerate(_FORMS)))
def _(t, spark):
    """Every form of a register array."""
    k = C("p_partkey") % 27
    of = lambda values: F.get(F.array(*values), k.cast("int"))
    text = [F.concat(*[x for part in f[2].split("{x}") for x in (F.hex("p_size"), L(part))][1:]) for f in _FORMS]
    rows = t("part").where(k < len(_FORMS)).select("p_partkey", of([L(f[0]) for f in _FORMS]).alias("peripheral"), of([L(f[1]) for f in _FORMS]).alias("name"), of(text).alias("offset"))
    return registers.expanded_offsets(rows, "offset", "name", "peripheral").select("p_partkey", "name", "byte_offset")


@query("q184_single_registers", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'G' || p_size WHEN 1 THEN 'CR' || p_size WHEN 2 THEN 'SR' || p_size WHEN 3 THEN 'MAPR' WHEN 4 THEN 'COMP1_CSR' ELSE 'M' || p_size END AS name, CASE p_partkey % 6 WHEN 0 THEN 'OTG_FS' WHEN 2 THEN 'ADC$' END AS instances, CASE p_partkey % 6 WHEN 3 THEN 'STM32F10[57]' WHEN 5 THEN 'STM32F10[123]' END AS devices, CASE p_partkey % 6 WHEN 1 THEN 'DLYB' END AS own, CASE p_partkey % 6 WHEN 5 THEN 'STM32F10[123]' WHEN 3 THEN 'STM32F10[57]' END AS line FROM part")
def _(t, spark):
    k = (C("p_partkey") % 6).cast("int")
    of = lambda *values: F.get(F.array(*[v if not isinstance(v, str) else L(v) for v in values]), k)
    number = lambda text: F.concat(L(text), "p_size")
    register = of(number("OTG_FS_G"), number("DLYB_CR"), number("ADC_SR"), "AFIO_MAPRconnectivitylinedevices", "COMP1_CSR", F.concat(L("FLASH_M"), "p_size", L("low,medium,highandXLdensitydevices")))
    others = of("OTG_HS_X", number("DLYB_CFG"), "ZDC_CR", "AFIO_EVCR", "COMP2_CSR", "FLASH_SR")
    caption, chapter = of("USB OTG_FS map", "map", "map", "map", "map", "map"), of("usb", "delay", "adc", "afio connectivity line", "comp", "flash low medium high and xl density devices")
    taken = registers.taken_name(caption, F.array(register, others))
    filters = registers.chapter_filters(chapter, taken)
    first = lambda key: F.get(F.element_at(filters, key), L(0))
    return t("part").select("p_partkey", registers.single_register(register, taken).alias("r"), first("instances").alias("own"), first("devices").alias("line")).select("p_partkey", "r.*", "own", "line")
