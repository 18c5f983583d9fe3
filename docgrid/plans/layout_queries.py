"""Queries over geometry, ordered scans and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import clustered, layout, sequence, spatial
from .registry import query

C, L = F.col, F.lit
_RECTS = [(1, 0.0, 0.0, 10.0, 0.05), (2, 5.0, 0.02, 20.0, 0.1), (3, 30.0, 0.0, 50.0, 0.03), (4, 45.0, 0.02, 48.0, 0.09)]
_R = "r(id, l, b, r, t) AS (VALUES " + ", ".join(f"({i}, {l:.1f}::DOUBLE, {b}::DOUBLE, {r:.1f}::DOUBLE, {t}::DOUBLE)" for i, l, b, r, t in _RECTS) + ")"


#: A box for each line of an order; id tells them apart.
_BOXED = "r AS (SELECT l_orderkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_quantity AS l, l_linenumber::DOUBLE AS b, l_quantity + l_partkey % 7 AS r, (l_linenumber + l_suppkey % 3)::DOUBLE AS t FROM lineitem)"


def _boxed(t):
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t("lineitem").select("l_orderkey", ident.alias("id"), g.box(C("l_quantity"), C("l_linenumber").cast("double"), C("l_quantity") + C("l_partkey") % 7, (C("l_linenumber") + C("l_suppkey") % 3).cast("double")).alias("box"))


def _rects(spark):
    return spark.createDataFrame(_RECTS, "id int, l double, b double, r double, t double")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LSQL = ", ".join(_LINE)


@query("q27_rect_contains_join", f"WITH {_R} SELECT {_LSQL}, id FROM lineitem JOIN r ON l_quantity BETWEEN l AND r AND l_discount BETWEEN b AND t")
def _(t, spark):
    return spatial.range_join(t("lineitem"), _rects(spark), "l_quantity", "l_discount").select(*_LINE, "id")


@query("q28_rect_union_agg", "SELECT l_orderkey, min(l_quantity) AS l, min(l_discount) AS b, max(l_quantity) AS r, max(l_tax) AS t FROM lineitem GROUP BY 1")
def _(t, spark):
    x = t("lineitem").select("l_orderkey", F.struct(C("l_quantity").alias("l"), C("l_discount").alias("b"), C("l_quantity").alias("r"), C("l_tax").alias("t")).alias("box"))
    return x.groupBy("l_orderkey").agg(g.box_union(C("box")).alias("u")).select("l_orderkey", "u.*")


@query("q29_overlap_quirk_vs_exact", f"WITH {_BOXED} SELECT x.id AS i, y.id AS j, x.l_orderkey AS doc, (y.l BETWEEN x.l AND x.r AND y.b BETWEEN x.b AND x.t) OR (y.r BETWEEN x.l AND x.r AND y.t BETWEEN x.b AND x.t) AS compat, x.l <= y.r AND y.l <= x.r AND x.b <= y.t AND y.b <= x.t AS exact FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.id <> y.id")
def _(t, spark):
    r = _boxed(t)
    return r.alias("x").join(r.alias("y"), F.expr("x.l_orderkey = y.l_orderkey and x.id <> y.id")).select(C("x.id").alias("i"), C("y.id").alias("j"), C("x.l_orderkey").alias("doc"), g.overlaps_corner(C("x.box"), C("y.box")).alias("compat"), g.intersects(C("x.box"), C("y.box")).alias("exact"))


@query("q30_affine_map", f"SELECT {_LSQL}, 2.0 * l_quantity + 3.0 * l_linenumber + 5.0 AS x, -1.0 * l_quantity + 4.0 * l_linenumber + 7.0 AS y FROM lineitem".replace("2.0", "2::DOUBLE").replace("3.0", "3::DOUBLE").replace("5.0", "5::DOUBLE").replace("-1.0", "-1::DOUBLE").replace("4.0", "4::DOUBLE").replace("7.0", "7::DOUBLE"))
def _(t, spark):
    x, y = g.affine(C("l_quantity"), C("l_linenumber"), (2.0, 3.0, -1.0, 4.0, 5.0, 7.0))
    return t("lineitem").select(*_LINE, x.alias("x"), y.alias("y"))


@query("q31_line_direction", f"SELECT {_LSQL}, CASE WHEN l_discount = l_tax AND l_linenumber = 1 THEN 'point' WHEN l_discount = l_tax THEN 'vertical' WHEN l_linenumber = 1 THEN 'horizontal' ELSE 'angled' END AS direction FROM lineitem")
def _(t, spark):
    return t("lineitem").select(*_LINE, g.direction(C("l_discount"), L(1.0), C("l_tax"), C("l_linenumber").cast("double")).alias("direction"))


@query("q32_gap_clusters", "WITH e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, sum((d IS NULL OR d >= 43200000000)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM e")
def _(t, spark):
    e = t("events").withColumn("at", F.unix_micros(C("ts").cast("timestamp")))
    return sequence.gap_clusters(e, ["user_id"], ["ts", "event_id"], C("at"), 43200000000).select("event_id", "cluster")


@query("q33_region_merge_sweep", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS lo, epoch_us(ts) + (floor(value)::BIGINT * 60000000) AS hi FROM events), m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e) SELECT event_id, sum((p IS NULL OR p < lo)::INT) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS region FROM m")
def _(t, spark):
    lo = F.unix_micros(C("ts").cast("timestamp"))
    e = t("events").select("event_id", "user_id", lo.alias("lo"), (lo + F.floor("value").cast("bigint") * 60000000).alias("hi"))
    return sequence.merged_intervals(e, ["user_id"], "lo", "hi", "event_id").select("event_id", "region")


@query("q34_glyph_bbox_first_known", "SELECT event_id, first_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS first_known FROM events")
def _(t, spark):
    w = sequence.ordered(["event_type", "user_id"], "ts", "event_id").rowsBetween(sequence.Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.first(F.when(C("value") > 50, C("event_id")), ignorenulls=True).over(w).alias("first_known"))


@query("q35_style_class", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'h1' WHEN p_size >= 30 THEN 'h2' WHEN p_size >= 15 THEN 'n' ELSE 'fn' END AS size_class, CASE WHEN p_size % 10 > 2.5 THEN 'super' WHEN p_size % 10 < -1.5 THEN 'sub' ELSE 'normal' END AS script FROM part")
def _(t, spark):
    return t("part").select("p_partkey", g.classified(C("p_size"), {"h1": 40, "h2": 30, "n": 15}, "fn").alias("size_class"), g.script_style(C("p_size") % 10, L(0), L(10)).alias("script"))


@query("q36_grid_line_coalesce", "WITH v AS (SELECT DISTINCT l_returnflag AS k, round(l_discount * 100 + l_tax * 1000)::BIGINT AS v FROM lineitem), c AS (SELECT *, sum((p IS NULL OR v - p >= 3)::INT) OVER (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY v) AS p FROM v)) SELECT k, c::BIGINT AS line, min(v) AS lo, max(v) AS hi FROM c GROUP BY k, c")
def _(t, spark):
    v = t("lineitem").select(C("l_returnflag").alias("k"), F.round(C("l_discount") * 100 + C("l_tax") * 1000).cast("bigint").alias("v")).distinct()
    return sequence.gap_clusters(v, ["k"], ["v"], C("v"), 3, out="line").groupBy("k", "line").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("q37_caption_nearest_below", "SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM events QUALIFY event_type = 'error'")
def _(t, spark):
    w = sequence.ordered(["user_id"], "ts", "event_id").rowsBetween(1, sequence.Window.unboundedFollowing)
    return t("events").withColumn("below", F.first(F.when(C("event_type") == "purchase", C("event_id")), ignorenulls=True).over(w)).where("event_type = 'error'").select("event_id", "below")


@query("q38_table_append_offset", "SELECT n_name, (sum(c) OVER (ORDER BY n_regionkey) - c + k)::BIGINT AS y FROM (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS c0, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN count(*) OVER (PARTITION BY n_regionkey) ELSE 0 END AS c1 FROM nation) x JOIN (SELECT n_regionkey AS rk, sum(c) OVER (ORDER BY n_regionkey) AS s, c FROM (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1)) z ON rk = n_regionkey".replace("(sum(c) OVER (ORDER BY n_regionkey) - c + k)", "(s - c + k)"))
def _(t, spark):
    rows = t("nation").withColumn("y", F.row_number().over(sequence.ordered(["n_regionkey"], "n_nationkey")) - 1)
    return layout.appended(rows, ["n_regionkey"], "y").select("n_name", "y")


@query("q71_isclose_pairs", f"SELECT {_LSQL}, abs(l_discount - l_tax) <= greatest(1e-9 * greatest(abs(l_discount), abs(l_tax)), 0.005) AS close, least(l_discount, l_tax) AS lo, greatest(l_discount, l_tax) AS hi FROM lineitem")
def _(t, spark):
    return t("lineitem").select(*_LINE, g.is_close(C("l_discount"), C("l_tax"), absolute=0.005).alias("close"), F.least("l_discount", "l_tax").alias("lo"), F.greatest("l_discount", "l_tax").alias("hi"))


@query("q72_rotation_remap", f"SELECT {_LSQL}, CASE WHEN l_linenumber % 4 <> 0 THEN 1::DOUBLE ELSE l_quantity END AS l, CASE WHEN l_linenumber % 4 <> 0 THEN 100 - (l_quantity + l_linenumber % 3) ELSE 1::DOUBLE END AS b FROM lineitem WHERE l_linenumber % 3 <> 0 UNION ALL SELECT {_LSQL}, 0::DOUBLE, 0::DOUBLE FROM lineitem WHERE l_linenumber % 3 = 0")
def _(t, spark):
    q = C("l_quantity")
    loose = F.struct(q.alias("l"), L(1.0).alias("b"), (q + C("l_linenumber") % 3).alias("r"), L(2.0).alias("t"))
    tight = F.struct(L(0.0).alias("l"), L(0.0).alias("b"), L(1.0).alias("r"), L(1.0).alias("t"))
    flat = loose["l"] == loose["r"]
    box = F.when(flat, g.usable(loose, tight)).otherwise(g.page_rotated(loose, C("l_linenumber") % 4 * 90, L(100.0)))
    return t("lineitem").select(*_LINE, box.alias("box")).select(*_LINE, "box.l", "box.b")


@query("q73_rgba_pack", "SELECT p_partkey, ((p_size::BIGINT % 256) << 24) | ((p_partkey % 256) << 16) | (7 << 8) | 255 AS rgba FROM part")
def _(t, spark):
    return t("part").select("p_partkey", g.rgba(C("p_size") % 256, C("p_partkey") % 256, L(7), L(255)).alias("rgba"))


@query("q74_translate_super", "SELECT p_partkey, translate(p_name || p_size, '0123456789+-', '⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻') AS name FROM part")
def _(t, spark):
    return t("part").select("p_partkey", g.superscript(F.concat("p_name", C("p_size").cast("string"))).alias("name"))


@query("q78_charlines_index", "SELECT user_id, floor(value * 10 + 0.5) / 10 AS y, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY ALL")
def _(t, spark):
    e = t("events").withColumn("value", F.floor(C("value") * 10 + 0.5) / 10)
    return layout.char_lines(e, ["user_id"], "value", ["ts", "event_id"], "event_id").select("user_id", "y", F.array_join("chars", ",").alias("ids"))


@query("q79_link_ranges", "WITH l(lo, hi, url) AS (VALUES (0, 300, 'a'), (200, 500, 'b'), (450, 460, 'c')) SELECT event_id, arg_max(url, url) AS url FROM events JOIN l ON event_id >= lo AND event_id < hi GROUP BY 1")
def _(t, spark):
    links = spark.createDataFrame([(0, 300, "a", 1), (200, 500, "b", 2), (450, 460, "c", 3)], "lo bigint, hi bigint, url string, ord int")
    return layout.linked(t("events"), links, "event_id").select("event_id", "url")


@query("q80_template_param_join", "WITH p(lang, cols) AS (VALUES ('en', 2), ('de', 1), ('fr', 1)) SELECT doc_id, coalesce(cols, 0) AS cols, CASE WHEN lang = 'en' AND n_chars > 1000 THEN 'acrobat' ELSE 'default' END AS template FROM documents LEFT JOIN p USING (lang)")
def _(t, spark):
    p = spatial.bounded(spark.createDataFrame([("en", 2), ("de", 1), ("fr", 1)], "lang string, cols int"))
    return t("documents").join(p, "lang", "left").select("doc_id", F.coalesce("cols", L(0)).alias("cols"), F.when((C("lang") == "en") & (C("n_chars") > 1000), "acrobat").otherwise("default").alias("template"))


@query("q81_complement_gaps", "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS lo, epoch_us(ts) + 3600000000 AS hi FROM events), m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e) SELECT user_id, (lo - p) // 1000000 AS gap_s FROM m WHERE p < lo")
def _(t, spark):
    lo = F.unix_micros(C("ts").cast("timestamp"))
    return layout.gaps(t("events").select("user_id", "event_id", lo.alias("lo"), (lo + 3600000000).alias("hi")), ["user_id"], "lo", "hi", "event_id").select("user_id", F.expr("(until - since) div 1000000").alias("gap_s"))


@query("q82_objects_minus_covered", f"WITH {_R} SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ANTI JOIN r ON l_quantity BETWEEN l AND r AND l_discount BETWEEN b AND t")
def _(t, spark):
    return spatial.outside(t("lineitem"), _rects(spark), "l_quantity", "l_discount").select(*_LINE).distinct()


@query("q83_majority_class", "SELECT l_orderkey, CASE WHEN 3 * sum((l_quantity > 25)::INT) >= 2 * count(*) THEN 'table' ELSE 'figure' END AS kind FROM lineitem GROUP BY 1")
def _(t, spark):
    x = t("lineitem").groupBy("l_orderkey").agg(F.count_if(C("l_quantity") > 25).alias("a"), F.count(L(1)).alias("n"))
    return x.select("l_orderkey", F.when(3 * C("a") >= 2 * C("n"), "table").otherwise("figure").alias("kind"))


@query("q84_edges_explode", f"WITH {_BOXED} SELECT id, 'left' AS side, l AS x0, b AS y0, l AS x1, t AS y1 FROM r UNION ALL SELECT id, 'right', r, b, r, t FROM r UNION ALL SELECT id, 'bottom', l, b, r, b FROM r UNION ALL SELECT id, 'top', l, t, r, t FROM r")
def _(t, spark):
    return _boxed(t).select("id", F.explode(g.edges(C("box"))).alias("e")).select("id", "e.*")


@query("q85_missing_lines", "WITH v AS (SELECT DISTINCT l_partkey AS k, l_quantity::INT AS v FROM lineitem), n AS (SELECT k, v, lead(v) OVER (PARTITION BY k ORDER BY v) AS nx FROM v) SELECT n.k, (n.v + nx) // 2 AS line FROM n WHERE nx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v w WHERE w.k = n.k AND w.v = (n.v + nx) // 2)")
def _(t, spark):
    v = t("lineitem").select(C("l_partkey").alias("k"), C("l_quantity").cast("int").alias("v")).distinct()
    mid = v.withColumn("nx", F.lead("v").over(sequence.ordered(["k"], "v"))).where("nx is not null").select("k", F.expr("(v + nx) div 2").cast("int").alias("line"))
    return mid.join(v.withColumnRenamed("v", "line"), ["k", "line"], "left_anti")


#: Rows a task sums up where nearly each is a group of its own.
_TASK_ROWS = 200_000


@query("q86_border_lookup", "WITH l(lo, hi, width, ord) AS (VALUES (0, 20, 1, 1), (10, 40, 3, 2), (30, 60, 2, 3)) SELECT event_id, arg_min(width, ord) AS width FROM events JOIN l ON value BETWEEN lo AND hi GROUP BY 1")
def _(t, spark):
    lines = spark.createDataFrame([(0.0, 0.0, 20.0, 0.0, 1, 1), (10.0, 0.0, 40.0, 0.0, 3, 2), (30.0, 0.0, 60.0, 0.0, 2, 3)], "l double, b double, r double, t double, width int, ord int")
    hit = spatial.range_join(t("events").select("event_id", "value", L(0).alias("_y")), lines, "value", "_y").select("event_id", "width", "ord")
    # Moved first, to as many tasks as the rows, counted by a job, need: nearly each row is a group of its own, and a task
    # that reads a large file would hold all of its groups.
    return hit.repartition(t("events").count() // _TASK_ROWS + 1, "event_id").groupBy("event_id").agg(F.min_by("width", "ord").alias("width"))


@query("q87_header_detection", "SELECT l_orderkey, l_linenumber, avg((l_returnflag = 'R')::INT) > 0.33 AS header FROM lineitem GROUP BY ALL")
def _(t, spark):
    return layout.header_rows(t("lineitem").select("l_orderkey", "l_linenumber", (C("l_returnflag") == "R").alias("bold")), ["l_orderkey"], "l_linenumber", 0.33)


@query("q88_register_reshape", f"SELECT {_LSQL}, CASE WHEN l_linenumber > 3 THEN l_quantity::BIGINT + 16 ELSE l_quantity::BIGINT END AS x, CASE WHEN l_linenumber > 3 THEN l_linenumber - 3 ELSE l_linenumber END AS y FROM lineitem")
def _(t, spark):
    x = t("lineitem").select(*_LINE, C("l_quantity").cast("bigint").alias("x"), C("l_linenumber").alias("y"))
    return layout.widened(x, "x", "y", rows=3, by=16)


@query("q89_left_aligned", "SELECT l_orderkey, bool_or(l_discount + 0.02 < l_tax) AS left_aligned FROM lineitem GROUP BY 1")
def _(t, spark):
    return t("lineitem").groupBy("l_orderkey").agg(F.bool_or(C("l_discount") + 0.02 < C("l_tax")).alias("left_aligned"))


#: Widths of 1 to 1,000,000, by the zeros at the end of a number.
_POWER = "CASE " + " ".join(f"WHEN {{0}} % {10**k} = 0 THEN {10**k}" for k in range(6, 0, -1)) + " ELSE 1 END"


def _width(of):
    return F.expr(_POWER.format(of)).cast("double")


@query("q170_nested_ranges", f"WITH i AS (SELECT o_orderkey, o_totalprice AS l, o_totalprice + {_POWER.format('o_orderkey')} AS r FROM orders) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderkey FROM lineitem JOIN i ON l_extendedprice BETWEEN l AND r")
def _(t, spark):
    spans = t("orders").select("o_orderkey", C("o_totalprice").alias("l"), (C("o_totalprice") + _width("o_orderkey")).alias("r"), L(0).alias("b"), L(0).alias("t"))
    lines = t("lineitem").select(*_LINE, "l_extendedprice", L(0).alias("_y"))
    return spatial.range_join(lines, spans, "l_extendedprice", "_y", most=200_000).select(*_LINE, "o_orderkey")


_SIDES = "l_extendedprice AS l, l_tax AS b, l_extendedprice + {0} AS r, l_tax + 0.03125 * (l_partkey % 4) AS t"


@query("q171_nested_boxes", f"WITH x AS (SELECT l_suppkey, l_orderkey AS i, l_linenumber AS li, l_partkey AS pi, {_SIDES.format(_POWER.format('l_partkey'))} FROM lineitem WHERE l_returnflag = 'R'), y AS (SELECT l_suppkey, l_orderkey AS j, l_linenumber AS lj, l_partkey AS pj, {_SIDES.format(_POWER.format('l_orderkey'))} FROM lineitem WHERE l_returnflag = 'A') SELECT x.l_suppkey, i, li, pi, j, lj, pj FROM x JOIN y ON x.l_suppkey = y.l_suppkey AND x.l <= y.r AND y.l <= x.r AND x.b <= y.t AND y.b <= x.t")
def _(t, spark):
    def side(flag, width, names, box):
        sides = [c.cast("double") for c in (C("l_extendedprice"), C("l_tax"), C("l_extendedprice") + _width(width), C("l_tax") + 0.03125 * (C("l_partkey") % 4))]
        return t("lineitem").where(C("l_returnflag") == flag).select("l_suppkey", *[C(c).alias(n) for c, n in zip(("l_orderkey", "l_linenumber", "l_partkey"), names)], g.box(*sides).alias(box))

    found = spatial.box_join(side("R", "l_partkey", ("i", "li", "pi"), "box"), side("A", "l_orderkey", ("j", "lj", "pj"), "other"), ["l_suppkey"])
    return found.select("l_suppkey", "i", "li", "pi", "j", "lj", "pj")


_CHARS = "SELECT user_id AS doc, event_id // 2500 AS page, floor(value / 100)::BIGINT AS y, event_id % 100 AS x, event_id AS idx FROM events"


def page_chain(t):
    """Characters laid out by page; then lines, words in lines, and each word with its line's characters."""
    chars = t("events").select(C("user_id").alias("doc"), F.expr("event_id div 2500").alias("page"), F.floor(C("value") / 100).alias("y"), (C("event_id") % 100).alias("x"), C("event_id").alias("idx"))
    table = clustered.laid_out(chars, ["doc", "page"], ["y", "x"], buckets=8)
    line = ["doc", "page", "y"]
    words = sequence.gap_clusters(table, line, ["x", "idx"], C("x"), 20).groupBy(*line, "cluster").agg(F.min("x").alias("l"), F.max("x").alias("r"))
    lines = layout.char_lines(table, ["doc", "page"], "y", ["x", "idx"], "idx")
    return words.join(lines, line)


@query("q181_page_chain", f"WITH c AS ({_CHARS}), g AS (SELECT *, x - lag(x) OVER w AS d FROM c WINDOW w AS (PARTITION BY doc, page, y ORDER BY x, idx)), k AS (SELECT *, sum((d IS NULL OR d >= 20)::INT) OVER (PARTITION BY doc, page, y ORDER BY x, idx ROWS UNBOUNDED PRECEDING) AS cluster FROM g), l AS (SELECT doc, page, y, string_agg(idx, ',' ORDER BY x, idx) AS ids FROM c GROUP BY ALL) SELECT doc, page, y, cluster::BIGINT AS cluster, min(x) AS l, max(x) AS r, any_value(ids) AS ids FROM k JOIN l USING (doc, page, y) GROUP BY doc, page, y, cluster")
def _(t, spark):
    return page_chain(t).select("doc", "page", "y", "cluster", "l", "r", F.array_join("chars", ",").alias("ids"))
