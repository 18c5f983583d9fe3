"""Queries over relations: catalogs, comparisons, memory maps, graphs, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lineage
from ..functions import numbers, rules
from ..operators import evaluate, graph, memmap, sequence, spatial
from ..sources import ontology
from .registry import query

C, L = F.col, F.lit
one = lambda: F.count(L(1))


@query("q21_catalog_sync_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 25)")
def _(t, spark):
    return evaluate.coverage(t("orders").select(C("o_orderkey").alias("k")), t("lineitem").where("l_quantity >= 25").select(C("l_orderkey").alias("k")), "k").select(C("k").alias("o_orderkey"))


@query("q22_latest_version_numeric", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def _(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("q23_latest_version_lexical", "SELECT o_custkey, CAST(max('v' || o_orderkey) AS VARCHAR) AS latest FROM orders GROUP BY 1")
def _(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.max(F.concat(L("v"), "o_orderkey")).alias("latest"))


@query("q24_unique_mapping_violations", "SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(t, spark):
    return t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n")).where("n > 1")


@query("q25_toc_dedup", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY ALL")
def _(t, spark):
    return t("events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("q26_chapter_ranges_lead", "SELECT event_id, user_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 999999999) AS until FROM events")
def _(t, spark):
    return t("events").select("event_id", "user_id", sequence.lead_ranges(C("event_id"), sequence.ordered(["user_id"], "event_id"), L(999999999)).alias("until"))


@query("q39_island_lists", "WITH e AS (SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, k::BIGINT AS island, min(event_type) AS type, count(*)::BIGINT AS n FROM i GROUP BY user_id, k")
def _(t, spark):
    days = t("events").withColumn("day", F.to_date("ts"))  # a user's events are no one task's
    return sequence.split_islands(days, ["user_id"], "day", ["ts", "event_id"], "event_type", lambda p, v: p != v).groupBy("user_id", C("island")).agg(F.min("event_type").alias("type"), one().alias("n"))


@query("q40_lookahead_5", "SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS purchase FROM events")
def _(t, spark):
    return t("events").select("event_id", sequence.first_within(C("event_id"), C("event_type") == "purchase", sequence.ordered(["user_id"], "ts", "event_id"), 5).alias("purchase"))


@query("q41_asof_parent", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS parent FROM events")
def _(t, spark):
    return t("events").select("event_id", sequence.asof_parent(C("event_type") == "signup", C("event_id"), sequence.ordered(["user_id"], "ts", "event_id")).alias("parent"))


@query("q42_struct_offsets", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM lineitem")
def _(t, spark):
    found = memmap.struct_offsets(t("lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], C("l_quantity").cast("bigint"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "byte_offset")


@query("q43_register_expand", "SELECT p_partkey, 'R' || ((o - p_size * 16) // 4) AS register, o AS byte_offset FROM (SELECT p_partkey, p_size, unnest(generate_series(p_size * 16, p_size * 16 + (p_partkey % 5) * 4, 4)) AS o FROM part)")
def _(t, spark):
    p = t("part").select("p_partkey", F.concat(L("R"), L("x")).alias("register"), (C("p_size") * 16).cast("bigint").alias("lo"), (C("p_size") * 16 + (C("p_partkey") % 5) * 4).cast("bigint").alias("hi"))
    return memmap.expanded_range(p, "lo", "hi", 4, "register").select("p_partkey", "register", "byte_offset")


@query("q44_filter_resolution", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND regexp_matches(p_brand, '(?i)brand#1')) OR (p_partkey % 3 = 2 AND regexp_matches(p_brand, '(?i)brand#2|#3'))")
def _(t, spark):
    filters = F.when(C("p_partkey") % 3 == 1, F.create_map(L("devices"), F.array(L("brand#1")))).when(C("p_partkey") % 3 == 2, F.create_map(L("devices"), F.array(L("brand#2"), L("#3")))).otherwise(F.create_map(L("other"), F.array(L("zzz"))))
    return t("part").where(rules.filters_pass(filters, "devices", C("p_brand"))).select("p_partkey")


_PATTERNS = [(1, "^Brand", 1), (2, "^Brand#1", 2), (3, "^Brand#1.", 3), (4, "#2$", 2), (5, ".", 0)]


@query("q45_best_match_rank", "WITH p(id, pat, n) AS (VALUES " + ", ".join(map(str, _PATTERNS)) + ") SELECT p_partkey, id FROM part JOIN p ON regexp_matches(p_brand, pat) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, id) = 1")
def _(t, spark):
    p = spark.createDataFrame(_PATTERNS, "id int, pat string, n int")
    met = spatial.pattern_join(t("part").select("p_partkey", "p_brand"), p.withColumn("filters", F.array_repeat(L("f"), C("n"))), "p_brand", "pat")
    return memmap.best_match(met, ["p_partkey"], "filters").groupBy("p_partkey").agg(F.min("id").alias("id"))


_PREFIXES = ["Customer#", "Customer#00000", "Customer#0000001", "Customer#00000002", "Customer#0000003"]


@query("q46_longest_pattern_first", "WITH p(x) AS (VALUES " + ", ".join(f"('{x}')" for x in _PREFIXES) + ") SELECT c_custkey, x AS prefix FROM customer JOIN p ON starts_with(c_name, x) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(x) DESC) = 1")
def _(t, spark):
    p = spark.createDataFrame([(x,) for x in _PREFIXES], "prefix string")
    return sequence.best(spatial.prefix_join(t("customer"), p, "c_name", "prefix"), ["c_custkey"], F.length("prefix").desc()).select("c_custkey", "prefix")


@query("q47_device_tree_dedup", "WITH o AS (SELECT l_orderkey, string_agg(CAST(l_suppkey % 5 AS VARCHAR) || l_returnflag, ',' ORDER BY CAST(l_suppkey % 5 AS VARCHAR) || l_returnflag) AS tree FROM lineitem GROUP BY 1) SELECT min(l_orderkey) AS device, count(*)::BIGINT AS compatible FROM o GROUP BY tree")
def _(t, spark):
    rows = t("lineitem").select(C("l_orderkey").alias("device"), (C("l_suppkey") % 5).alias("s"), "l_returnflag")
    return memmap.deduplicated(rows, "device", "s", "l_returnflag").select("device", F.size("compatible").cast("bigint").alias("compatible"))


@query("q48_bitfield_coalesce", "SELECT l_orderkey, l_returnflag, min(l_linenumber)::BIGINT AS position, (max(l_linenumber) + 1 - min(l_linenumber))::BIGINT AS width FROM lineitem GROUP BY ALL")
def _(t, spark):
    return memmap.coalesced_fields(t("lineitem"), ["l_orderkey", "l_returnflag"], "l_linenumber").select("l_orderkey", "l_returnflag", C("position").cast("bigint"), C("width").cast("bigint"))


@query("q49_mask_width", "SELECT p_partkey, p_size % 7 + 1 AS width FROM part")
def _(t, spark):
    mask = F.expr("shiftleft(shiftleft(1L, p_size % 7 + 1) - 1, p_size % 11)")
    return t("part").select("p_partkey", numbers.mask_width(mask).alias("width"))


_THREE = "WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS addr, 'A' AS src, 'R' || (l_partkey % 3) AS name FROM lineitem WHERE l_quantity < 30 UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'B', 'R' || (l_partkey % 3) || CASE WHEN l_suppkey % 4 = 0 THEN 'X' ELSE '' END FROM lineitem WHERE l_discount < 0.07 UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'C', 'R' || (l_suppkey % 2) FROM lineitem WHERE l_tax < 0.06), w AS (SELECT addr, max(name) FILTER (src = 'A') AS A, max(name) FILTER (src = 'B') AS B, max(name) FILTER (src = 'C') AS C FROM s GROUP BY 1), n AS (SELECT *, list_distinct(list_filter([A, B, C], lambda x: x IS NOT NULL)) AS ns FROM w), z AS (SELECT *, (A IS NOT NULL)::INT + (B IS NOT NULL)::INT + (C IS NOT NULL)::INT AS present, len(ns) > 1 AND len(list_filter(ns, lambda x: len(list_filter(ns, lambda y: contains(y, x))) = len(ns))) = 0 AS conflict FROM n) "


def _three(t):
    addr, l = C("l_orderkey") * 8 + C("l_linenumber"), t("lineitem")  # noqa: E741
    a = l.where("l_quantity < 30").select(addr.alias("addr"), L("A").alias("src"), F.concat(L("R"), C("l_partkey") % 3).alias("name"))
    b = l.where("l_discount < 0.07").select(addr, L("B"), F.concat(L("R"), C("l_partkey") % 3, F.when(C("l_suppkey") % 4 == 0, "X").otherwise("")))
    c = l.where("l_tax < 0.06").select(addr, L("C"), F.concat(L("R"), C("l_suppkey") % 2))
    return evaluate.agreement(evaluate.by_source(a.union(b).union(c), ["addr"], "src", ["A", "B", "C"], "name"), ["A", "B", "C"])


@query("q50_three_way_pivot", _THREE + "SELECT present::INT AS present, count(*)::BIGINT AS n, sum(conflict::INT)::BIGINT AS conflicts, sum((present = 3 AND NOT conflict)::INT)::BIGINT AS same FROM z GROUP BY 1")
def _(t, spark):
    return _three(t).groupBy("present").agg(one().alias("n"), F.count_if("conflict").alias("conflicts"), F.count_if("identical").alias("same"))


@query("q51_conflict_contains", _THREE + "SELECT addr, coalesce(A, '') || '/' || coalesce(B, '') || '/' || coalesce(C, '') AS names FROM z WHERE conflict")
def _(t, spark):
    return _three(t).where("conflict").select("addr", F.concat_ws("/", *[F.coalesce(x, L("")) for x in "ABC"]).alias("names"))


@query("q52_majority_vote", _THREE + "SELECT pair, count(*)::BIGINT AS n FROM (SELECT unnest(['A+B', 'A+C', 'B+C']) AS pair, unnest([A = B, A = C, B = C]) AS same FROM z) WHERE same GROUP BY 1")
def _(t, spark):
    return evaluate.majority(_three(t), ["A", "B", "C"])


@query("q53_topn_conflicts_family", "WITH g AS (SELECT c_mktsegment AS family, o_orderpriority AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT family, name, n::BIGINT AS n, round(100.0 * n / sum(n) OVER (PARTITION BY family), 2)::DOUBLE AS share FROM g QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, name) <= 3")
def _(t, spark):
    g = t("orders").join(t("customer"), C("o_custkey") == C("c_custkey")).groupBy(C("c_mktsegment").alias("family"), C("o_orderpriority").alias("name")).agg(one().alias("n"))
    g = g.withColumns({"share": F.expr("round(100.0D * n / sum(n) over (partition by family), 2)"), "k": F.expr("row_number() over (partition by family order by n desc, name)")})
    return g.where("k <= 3").drop("k")


@query("q54_having_counts", "SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY 1 HAVING count(*) >= 10")
def _(t, spark):
    return t("part").groupBy("p_type").agg(one().alias("n")).where("n >= 10")


@query("q55_coverage_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t, spark):
    return evaluate.coverage(t("customer").select("c_custkey"), t("orders").where("o_orderstatus = 'P'").select(C("o_custkey").alias("c_custkey")), "c_custkey")


@query("q56_prefix_identifiers", "WITH a AS (SELECT DISTINCT n, left(c_name, n) AS id FROM customer, generate_series(15, 18) g(n) WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')), b AS (SELECT DISTINCT n, left(c_name, n) AS id FROM customer, generate_series(15, 18) g(n) WHERE c_mktsegment IN ('FURNITURE', 'AUTOMOBILE', 'HOUSEHOLD')) SELECT n::INT AS n, side, count(*)::BIGINT AS c FROM (SELECT a.n, 'removed' AS side FROM a ANTI JOIN b USING (n, id) UNION ALL SELECT b.n, 'added' FROM b ANTI JOIN a USING (n, id) UNION ALL SELECT a.n, 'both' FROM a SEMI JOIN b USING (n, id)) GROUP BY ALL")
def _(t, spark):
    cut = lambda *own: t("customer").where(C("c_mktsegment").isin("HOUSEHOLD", *own)).select("c_name", F.explode(F.sequence(L(15), L(18))).alias("n")).select("n", F.expr("left(c_name, n)").alias("id"))
    return evaluate.two_way(cut("BUILDING", "MACHINERY"), cut("FURNITURE", "AUTOMOBILE"), ["n", "id"]).groupBy("n", "side").agg(one().alias("c"))


@query("q57_two_way_diff", "WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 3) SELECT k, CASE WHEN l.k IS NULL THEN 'removed' WHEN o.k IS NULL THEN 'added' ELSE 'both' END AS side FROM o FULL JOIN l USING (k)")
def _(t, spark):
    return evaluate.two_way(t("orders").where("o_orderstatus <> 'P'").select(C("o_orderkey").alias("k")), t("lineitem").where("l_linenumber = 3").select(C("l_orderkey").alias("k")), ["k"])


@query("q58_token_subset", "WITH b AS (SELECT item_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), d AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents), m AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN b USING (w) GROUP BY ALL) SELECT doc_id, item_id FROM m JOIN n USING (item_id) WHERE k = n")
def _(t, spark):
    """Documents that hold every token of an item: joined on each item's least frequent token, then tested in full."""
    tokens = lambda c: F.array_distinct(F.split(c, " "))
    items = t("benchmark").select("item_id", tokens("text").alias("w"))
    pairs = items.select("item_id", F.explode("w").alias("t"))
    # Only ids and tokens are exploded, and of them only those of an item get beyond the scan.
    words = t("documents").select("doc_id", F.explode(tokens("text")).alias("t"))
    small = spatial.estimated_bytes(t("benchmark")) <= spatial.BROADCAST_BYTES
    hint = F.broadcast if small else lambda d: d
    counts = words.join(hint(pairs.select("t").distinct()), "t", "left_semi").groupBy("t").agg(one().alias("n"))
    rare = sequence.best(pairs.join(counts, "t", "left"), ["item_id"], F.coalesce("n", L(0)), "t").select("item_id", "t")
    met = words.join(hint(rare), "t").groupBy("doc_id").agg(F.collect_list("item_id").alias("i"))  # at most one row an item
    texts = t("documents").select("doc_id", tokens("text").alias("dw")).join(met, "doc_id").select("doc_id", "dw", F.explode("i").alias("item_id"))
    return texts.join(hint(items), "item_id").where(F.size(F.array_except("w", "dw")) == 0).select("doc_id", "item_id")


@query("q59_package_eval_ratio", "SELECT c_mktsegment AS segment, count(*)::BIGINT AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS correct, round(100.0 * sum((o_orderstatus = 'F')::INT) / count(*), 3)::DOUBLE AS pct FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t, spark):
    x = t("orders").join(t("customer"), C("o_custkey") == C("c_custkey")).groupBy(C("c_mktsegment").alias("segment")).agg(one().alias("n"), F.count_if(C("o_orderstatus") == "F").alias("correct"))
    return x.withColumn("pct", F.expr("round(100.0D * correct / n, 3)"))


@query("q60_grouping_sets_totals", "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def _(t, spark):
    x = t("lineitem").groupingSets([[C("l_returnflag"), C("l_linestatus")], [C("l_returnflag")], []], C("l_returnflag"), C("l_linestatus")).agg(one().alias("n"))
    return x.select(F.coalesce("l_returnflag", L("all")).alias("flag"), F.coalesce("l_linestatus", L("all")).alias("status"), "n")


@query("q61_memo_first_value", "SELECT l_orderkey, l_linenumber, l_partkey, min(l_orderkey) OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus) AS delegate FROM lineitem")
def _(t, spark):
    l = t("lineitem")  # noqa: E741
    keys = ["l_suppkey", "l_returnflag", "l_linestatus"]
    return l.join(l.groupBy(*keys).agg(F.min("l_orderkey").alias("delegate")), keys).select("l_orderkey", "l_linenumber", "l_partkey", "delegate")


def _edges(t):
    return graph.edges(
        (t("nation"), "n_name", "in_region", "n_regionkey"), (t("customer"), "c_name", "in_nation", "c_nationkey"), (t("supplier"), "s_name", "in_nation", "s_nationkey")
    )


@query("q62_graph_edges_instances", "SELECT 'in_region' AS predicate, count(DISTINCT n_name)::BIGINT AS subjects FROM nation UNION ALL SELECT 'in_nation', count(DISTINCT s)::BIGINT FROM (SELECT c_name AS s FROM customer UNION ALL SELECT s_name FROM supplier)")
def _(t, spark):
    return _edges(t).groupBy("predicate").agg(F.count_distinct("subject").alias("subjects"))


@query("q63_graph_annotation_lookup", "SELECT l_orderkey, l_partkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS positions FROM lineitem GROUP BY ALL")
def _(t, spark):
    return graph.annotated(t("lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber").select("l_orderkey", "l_partkey", F.array_join("annotation", ",").alias("positions"))


@query("q64_subclass_closure", "SELECT r_name AS ancestor, count(*)::BIGINT AS descendants FROM (SELECT r_name, n_name AS d FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT r_name, c_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey) GROUP BY 1")
def _(t, spark):
    r, n, c = t("region"), t("nation"), t("customer")
    up = n.join(r, C("n_regionkey") == C("r_regionkey")).select(C("n_name").alias("child"), C("r_name").alias("parent")).union(c.join(n, C("c_nationkey") == C("n_nationkey")).select("c_name", "n_name"))
    return graph.closure(up, "child", "parent").join(r, C("ancestor") == C("r_name"), "left_semi").groupBy("ancestor").agg(one().alias("descendants"))


@query("q65_set_ops", "(SELECT 'both' AS kind, c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders)) UNION ALL (SELECT 'only', c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)) UNION ALL (SELECT 'any', c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 200000))")
def _(t, spark):
    a, b = t("customer").where("c_acctbal > 0").select("c_custkey"), t("orders").select(C("o_custkey").alias("c_custkey"))
    u = t("customer").where("c_acctbal > 9000").select("c_custkey").union(t("orders").where("o_totalprice > 200000").select("o_custkey")).distinct()
    k = lambda n, d: d.select(L(n).alias("kind"), "c_custkey")
    return k("both", a.intersect(b)).union(k("only", a.subtract(b))).union(k("any", u))


@query("q69_histogram_bins", "SELECT floor(o_totalprice / 10000)::BIGINT AS bin, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(t, spark):
    return t("orders").groupBy(F.floor(C("o_totalprice") / 10000).alias("bin")).agg(one().alias("n"))


@query("q70_latex_counts", "SELECT 'pages' AS what, count(*)::BIGINT AS n FROM pages UNION ALL SELECT 'documents', count(*)::BIGINT FROM documents UNION ALL SELECT 'changed_lines', (SELECT count(*)::BIGINT FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(x, '^[+-][^+-]'))")
def _(t, spark):
    row = lambda n, d: d.agg(one().alias("n")).select(L(n).alias("what"), "n")
    lines = t("documents").select(F.explode(F.split("text", "\n")).alias("x")).where(C("x").rlike("^[+-][^+-]"))
    return row("pages", t("pages")).union(row("documents", t("documents"))).union(row("changed_lines", lines))


@query("q93_sole_child_collapse", "SELECT l_orderkey, min(l_partkey) AS child FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def _(t, spark):
    return t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("child"), one().alias("n")).where("n = 1").drop("n")


@query("q94_tree_level_sort", "SELECT path, level FROM (SELECT r_name AS path, 1 AS level FROM region UNION ALL SELECT r_name || '/' || n_name, 2 FROM region JOIN nation ON n_regionkey = r_regionkey)")
def _(t, spark):
    r, n = t("region"), t("nation")
    return r.select(C("r_name").alias("path"), L(1).alias("level")).union(n.join(r, C("n_regionkey") == C("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name"), L(2))).orderBy("path")


@query("q95_option_fallback_coalesce", "SELECT c_custkey, coalesce(a, b, -1) AS found FROM (SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS a, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AS b FROM customer)")
def _(t, spark):
    o = t("orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.min(F.when(C("o_orderstatus") == "P", C("o_orderkey"))).alias("a"), F.min(F.when(C("o_orderpriority").startswith("1"), C("o_orderkey"))).alias("b"))
    return t("customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("a", "b", L(-1)).alias("found"))


@query("q98_register_map_long", "SELECT l_orderkey, l_linenumber * 4 AS byte_offset, bit, l_returnflag || bit AS field FROM (SELECT l_orderkey, l_linenumber, l_returnflag, unnest(generate_series(0, l_suppkey % 3)) AS bit FROM lineitem)")
def _(t, spark):
    x = t("lineitem").select("l_orderkey", (C("l_linenumber") * 4).alias("byte_offset"), "l_returnflag", F.explode(F.sequence(L(0).cast("bigint"), C("l_suppkey") % 3)).alias("bit"))
    return x.select("l_orderkey", "byte_offset", "bit", F.concat("l_returnflag", C("bit").cast("string")).alias("field"))


@query("q99_lastwins_union", "SELECT o_orderkey, CASE WHEN o_orderpriority < '3' THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority < '3'")
def _(t, spark):
    o = t("orders")
    a, b = o.where("o_orderstatus <> 'F'").select("o_orderkey", L(1).alias("k"), L("old").alias("v")), o.where("o_orderpriority < '3'").select("o_orderkey", L(2), L("new"))
    return a.union(b).groupBy("o_orderkey").agg(F.max_by("v", "k").alias("v"))


@query("q100_define_priority", "WITH c(b, k) AS (VALUES ('Brand#11', 1), ('Brand#1', 2), ('Brand#', 3)) SELECT p_partkey, b FROM part JOIN c ON starts_with(p_brand, b) WHERE NOT (p_size < 5 AND b = 'Brand#11') QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k) = 1")
def _(t, spark):
    c = spark.createDataFrame([("Brand#11", 1), ("Brand#1", 2), ("Brand#", 3)], "b string, k int")
    x = spatial.prefix_join(t("part"), c, "p_brand", "b").where("not (p_size < 5 and b = 'Brand#11')")
    return sequence.best(x, ["p_partkey"], "k").select("p_partkey", "b")


@query("q101_driver_prefix_filter", "WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), d AS (SELECT DISTINCT p_partkey, w FROM w) SELECT p_partkey, w, starts_with(w, 'part') OR starts_with(w, 'b') AS kept FROM d")
def _(t, spark):
    d = t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return d.withColumn("kept", C("w").startswith("part") | C("w").startswith("b"))


@query("q102_set_diff_3key", "WITH a AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity > 10), b AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity < 20) SELECT coalesce(a.o, b.o) AS o, coalesce(a.p, b.p) AS p, coalesce(a.s, b.s) AS s, CASE WHEN b.o IS NULL THEN 'removed' ELSE 'added' END AS side FROM a FULL JOIN b ON a.o = b.o AND a.p = b.p AND a.s = b.s WHERE a.o IS NULL OR b.o IS NULL")
def _(t, spark):
    x = t("lineitem").select(C("l_orderkey").alias("o"), C("l_partkey").alias("p"), C("l_suppkey").alias("s"), "l_quantity")
    return evaluate.two_way(x.where("l_quantity > 10"), x.where("l_quantity < 20"), ["o", "p", "s"]).where("side <> 'both'")


@query("q103_whitelisted_pairs", "WITH d AS (SELECT DISTINCT least(x.o_orderpriority, y.o_orderpriority) AS a, greatest(x.o_orderpriority, y.o_orderpriority) AS b FROM (SELECT DISTINCT o_orderpriority FROM orders) x, (SELECT DISTINCT o_orderpriority FROM orders) y WHERE x.o_orderpriority <> y.o_orderpriority) SELECT a, b FROM d WHERE NOT (a LIKE '1%' AND b LIKE '2%')")
def _(t, spark):
    names = t("orders").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("n"))  # a handful of codes
    pairs = names.select(F.explode(F.flatten(F.transform("n", lambda a: F.transform(F.filter("n", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    known = pairs.where("a like '1%' and b like '2%'")
    return pairs.join(known, ["a", "b"], "left_anti")


@query("q106_type_pivot", "SELECT l_orderkey, max(l_linenumber) FILTER (l_returnflag = 'A') AS A, max(l_linenumber) FILTER (l_returnflag = 'N') AS N, max(l_linenumber) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def _(t, spark):
    return t("lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_linenumber"))


@query("q107_instance_type_rank", "WITH p AS (SELECT p_partkey, p_brand FROM part), y(name) AS (VALUES ('Brand#11'), ('Brand#2'), ('#3')), m AS (SELECT p_partkey, name, 0 AS level FROM p JOIN y ON p_brand = name UNION ALL SELECT p_partkey, name, 1 FROM p JOIN y ON contains(p_brand, name)) SELECT p_partkey, name, level FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY level, name) = 1")
def _(t, spark):
    y = F.broadcast(spark.createDataFrame([("Brand#11",), ("Brand#2",), ("#3",)], "name string"))  # three literal rows
    return spatial.ranked_join(t("part"), (y, C("p_brand") == C("name")), (y, F.contains("p_brand", "name")), keys=["p_partkey"], order=["name"]).select("p_partkey", "name", "level")


@query("q108_dup_removal", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT (l_returnflag = 'N' AND EXISTS (SELECT 1 FROM lineitem z WHERE z.l_orderkey = lineitem.l_orderkey AND z.l_returnflag = 'R'))")
def _(t, spark):
    l = t("lineitem")  # noqa: E741
    dup = l.where("l_returnflag = 'R'").select("l_orderkey").distinct().withColumn("d", L(True))
    return memmap.materialised(l.join(dup, "l_orderkey", "left").where("not (l_returnflag = 'N' and coalesce(d, false))"), t("part"), "l_partkey", "p_partkey")[0].select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")


@query("q109_enum_vectors", "SELECT CAST(left(o_orderpriority, 1) AS INT) AS position, regexp_replace(replace(o_orderpriority, ' ', '_') || '_IRQn', '_IRQn$', '') AS name, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def _(t, spark):
    x = t("orders").select(F.concat(F.replace("o_orderpriority", L(" "), L("_")), L("_IRQn")).alias("e"))
    return memmap.enum_vectors(x, "e").groupBy("position", "name").agg(one().alias("n"))


@query("q110_package_ranked_select", "WITH p(x, lo) AS (VALUES ('Customer#00000', 0), ('Customer#000000', 10), ('Customer#0000001', 0)) SELECT c_custkey, x FROM customer JOIN p ON starts_with(c_name, x) AND c_nationkey >= lo QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY -length(x), x) = 1")
def _(t, spark):
    p = spark.createDataFrame([("Customer#00000", 0), ("Customer#000000", 10), ("Customer#0000001", 0)], "x string, lo int")
    return sequence.best(spatial.prefix_join(t("customer"), p, "c_name", "x").where("c_nationkey >= lo"), ["c_custkey"], -F.length("x"), "x").select("c_custkey", "x")


@query("q111_edge_load_counts", "SELECT p AS predicate, count(*)::BIGINT AS n FROM (SELECT DISTINCT s, 'in_region' AS p, o FROM (SELECT n_name AS s, n_regionkey AS o FROM nation) UNION ALL SELECT DISTINCT s, 'in_nation', o FROM (SELECT c_name AS s, c_nationkey AS o FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier)) GROUP BY 1")
def _(t, spark):
    return _edges(t).distinct().groupBy("predicate").agg(one().alias("n"))


@query("q112_index_last_wins", "SELECT l_partkey, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS last_supplier FROM lineitem GROUP BY 1")
def _(t, spark):
    return graph.last_wins(t("lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"], "l_suppkey").select("l_partkey", C("l_suppkey").alias("last_supplier"))


@query("q113_ratio_totals", "WITH g AS (SELECT l_suppkey, count(DISTINCT l_returnflag) AS f, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1) SELECT count(*)::BIGINT AS n, min(q)::BIGINT AS lo, max(q)::BIGINT AS hi, sum(q)::BIGINT AS total, round(100.0 * sum((f >= 2)::INT) / count(*), 1)::DOUBLE AS pct FROM g")
def _(t, spark):
    g = t("lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("f"), F.sum(C("l_quantity").cast("bigint")).alias("q"))
    return g.agg(one().alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.sum("q").alias("total"), F.expr("round(100.0D * count_if(f >= 2) / count(1), 1)").alias("pct"))


@query("q114_group_by_key_list", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, max(split_part(c_name, '#', 2)) AS last FROM customer GROUP BY 1")
def _(t, spark):
    return t("customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.max(F.split_part("c_name", L("#"), L(2))).alias("last"))


@query("q115_good_dead_letter", "SELECT CASE WHEN l_quantity > 0 AND l_discount <= 0.09 THEN 'good' ELSE 'bad' END AS side, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def _(t, spark):
    from ..sources.catalog import split_valid

    good, bad = split_valid(t("lineitem"), (C("l_quantity") > 0) & (C("l_discount") <= 0.09))
    return good.agg(one().alias("n")).select(L("good").alias("side"), "n").union(bad.agg(one().alias("n")).select(L("bad"), "n")).where("n > 0")


@query("q116_xml_roundtrip", "SELECT p_partkey, p_name, p_size FROM part")
def _(t, spark):
    return memmap.xml_round_trip(t("part").select("p_partkey", "p_name", "p_size"))


@query("q182_ontology_round_trip", "SELECT c_name AS subject, 'livesIn' AS predicate, n_name AS object, c_mktsegment AS annotation, true AS single FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT r_name, 'hasNation', n_name, NULL, false FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t, spark):
    """Customers and nations as an ontology in RDF/XML, and read back; market segments are annotations of the edges."""
    lives = t("customer").join(t("nation"), C("c_nationkey") == C("n_nationkey")).select(C("c_name").alias("subject"), L("livesIn").alias("predicate"), C("n_name").alias("object"), C("c_mktsegment").alias("annotation"))
    has = t("nation").join(t("region"), C("n_regionkey") == C("r_regionkey")).select(C("r_name").alias("subject"), L("hasNation").alias("predicate"), C("n_name").alias("object"), L(None).cast("string").alias("annotation"))
    path = lineage.new_path(spark)
    ontology.save(lives.union(has), path)
    return ontology.load(spark, path)[0]


_PINS = "SELECT l_orderkey AS device, 'K' || l_orderkey % 5 AS package, l_linenumber AS pin, 'P' || {0}(l_partkey % 20) AS name FROM lineitem WHERE l_returnflag <> '{1}' GROUP BY ALL"
_PAIRS = [("P1", "P3"), ("P12", "P4"), ("P7", "P5")]


def _pins(t, agg, flag):
    x = t("lineitem").where(C("l_returnflag") != flag).groupBy(C("l_orderkey").alias("device"), C("l_linenumber").alias("pin")).agg(F.concat(L("P"), agg(C("l_partkey") % 20)).alias("name"))
    return x.withColumn("package", F.concat(L("K"), C("device") % 5))


@query("q185_package_report", f"WITH a AS ({_PINS.format('min', 'A')}), b AS ({_PINS.format('max', 'N')}), n AS (SELECT device, any_value(package) AS package, count(*) AS x, (SELECT count(*) FROM b WHERE b.device = a.device) AS y FROM a GROUP BY device), m AS (SELECT n.device, n.package, coalesce(a.pin, b.pin) AS pin, a.name AS xn, b.name AS yn FROM n JOIN (a FULL JOIN b ON a.device = b.device AND a.pin = b.pin) ON n.device = coalesce(a.device, b.device) WHERE n.y > 0), w AS (SELECT device, count(*) AS wrong FROM m WHERE CASE WHEN xn IS NULL OR yn IS NULL THEN (package, pin) NOT IN (('K1', 1), ('K2', 2)) ELSE NOT contains(xn, yn) AND NOT contains(yn, xn) AND (least(xn, yn), greatest(xn, yn)) NOT IN (('P1', 'P3'), ('P12', 'P4'), ('P5', 'P7')) END GROUP BY 1), d AS (SELECT n.*, CASE WHEN y = 0 THEN 'missing' WHEN wrong > 0 THEN 'wrong' ELSE 'ok' END AS state, CASE WHEN y = 0 THEN 0 ELSE greatest(x, y) END AS n, coalesce(wrong, 0) AS wrong, device % 7 = 0 AS valid FROM n LEFT JOIN w USING (device)), r AS (SELECT count(*) AS total_devices, count(*) FILTER (state = 'missing') AS missing_devices, count(*) FILTER (state = 'ok') AS correct_devices, count(*) FILTER (state = 'wrong') AS wrong_devices, count(*) FILTER (state = 'ok' OR (state = 'wrong' AND valid)) AS validated_devices, sum(n)::BIGINT AS total_pins, sum(n - wrong)::BIGINT AS correct_pins, sum(wrong)::BIGINT AS wrong_pins, sum(n - CASE WHEN valid THEN 0 ELSE wrong END)::BIGINT AS validated_pins FROM d) SELECT *, round(correct_devices * 100.0 / total_devices, 3)::DOUBLE AS correct_devices_pct, round(validated_devices * 100.0 / total_devices, 3)::DOUBLE AS validated_devices_pct, round(correct_pins * 100.0 / total_pins, 3)::DOUBLE AS correct_pins_pct, round(validated_pins * 100.0 / total_pins, 3)::DOUBLE AS validated_pins_pct FROM r")
def _(t, spark):
    ours, theirs = _pins(t, F.min, "A"), _pins(t, F.max, "N")
    pads = spark.createDataFrame([("K1", 1), ("K2", 2)], "package string, pin int")
    pairs = spark.createDataFrame(_PAIRS, "a string, b string")
    return evaluate.package_report(ours, theirs, pads, pairs, t("lineitem").where(C("l_orderkey") % 7 == 0).select(C("l_orderkey").alias("device")))


@query("q186_interrupt_report", f"WITH a AS (SELECT device::VARCHAR || CASE WHEN device % 11 = 0 THEN '@m4' ELSE '' END AS device, pin, replace(name, 'P1', 'P1_I') AS name FROM ({_PINS.format('min', 'A')})), b AS (SELECT device::VARCHAR AS device, pin, replace(name, 'P1', 'I_P1') AS name FROM ({_PINS.format('max', 'N')})), k AS (SELECT * FROM a WHERE NOT contains(device, '@') AND NOT starts_with(device, '13')), n AS (SELECT device, count(*) AS n, device IN (SELECT device FROM b) AS has FROM k GROUP BY 1), m AS (SELECT k.device, k.name AS x, b.name AS y FROM k JOIN n ON k.device = n.device AND has LEFT JOIN b ON b.device = k.device AND b.pin = k.pin), w AS (SELECT device, count(*) FILTER (y IS NULL) AS missing, count(*) FILTER (y IS NOT NULL AND NOT contains(x, y) AND NOT contains(y, x) AND len(list_filter(string_split(x, '_'), lambda v: NOT list_contains(string_split(y, '_'), v))) > 0 AND len(list_filter(string_split(y, '_'), lambda v: NOT list_contains(string_split(x, '_'), v))) > 0 AND (least(x, y), greatest(x, y)) NOT IN (('P1', 'P3'), ('P12', 'P4'), ('P5', 'P7'))) AS wrong FROM m GROUP BY 1), r AS (SELECT count(*) AS total_devices, count(*) FILTER (NOT has) AS missing_devices, count(*) FILTER (has AND coalesce(missing, 0) + coalesce(wrong, 0) = 0) AS correct_devices, count(*) FILTER (has AND coalesce(missing, 0) + coalesce(wrong, 0) > 0) AS wrong_devices, sum(CASE WHEN has THEN n END)::BIGINT AS total_vectors, sum(missing)::BIGINT AS missing_vectors, sum(wrong)::BIGINT AS wrong_vectors FROM n LEFT JOIN w USING (device)) SELECT *, total_vectors - missing_vectors - wrong_vectors AS correct_vectors, round(correct_devices * 100.0 / total_devices, 1)::DOUBLE AS correct_devices_pct, round((total_vectors - missing_vectors - wrong_vectors) * 100.0 / total_vectors, 1)::DOUBLE AS correct_vectors_pct FROM r")
def _(t, spark):
    named = lambda df, core, word: df.select(F.concat(C("device").cast("string"), core).alias("device"), C("pin").alias("position"), F.replace("name", L("P1"), L(word)).alias("name"))
    ours = named(_pins(t, F.min, "A"), F.when(C("device") % 11 == 0, "@m4").otherwise(""), "P1_I")
    theirs = named(_pins(t, F.max, "N"), L(""), "I_P1")
    return evaluate.interrupt_report(ours, theirs, spark.createDataFrame(_PAIRS, "a string, b string"), ["13"])
