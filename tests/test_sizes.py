"""What may be broadcast, dealt to tasks or shuffled, told by plans and by small tables with few keys."""

from conftest import rows
from pyspark.sql import functions as F

from docgrid.operators import layout, registers, spatial
from docgrid.plans import extraction_queries, layout_queries
from docgrid.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registers_are_not_broadcast(spark):
    own = spark.range(2).selectExpr("id as k", "concat('CR', id) as register", "concat('P_CR', id, '_') as prefix")
    macros = spark.range(6).selectExpr("id div 3 as k", "concat('P_CR', id div 3, element_at(array('_F_Pos', '_F_Msk', '_F'), int(id % 3) + 1)) as name", "if(id % 3 = 0, 4, 48) as number")
    found = registers.matched_fields(own, macros, ["k"])
    assert "Broadcast" not in plan(found)
    assert rows(found) == [(0, "CR0", "F", 4, 2), (1, "CR1", "F", 4, 2)]


def test_few_boxes_are_broadcast_and_many_are_not(spark, monkeypatch):
    points = spark.range(50).selectExpr("id", "double(id) as x", "1.0D as y")
    boxes = spark.range(3).selectExpr("id as box", "double(id * 10) as l", "0.0D as b", "double(id * 10 + 15) as r", "2.0D as t")
    few = spatial.range_join(points, boxes, "x", "y").select("id", "box")
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 2)
    many = spatial.range_join(points, boxes, "x", "y").select("id", "box")
    assert "BroadcastHashJoin" in plan(few) and "Broadcast" not in plan(many)
    assert rows(few) == rows(many) == sorted(((p, b) for p in range(50) for b in range(3) if 10 * b <= p <= 10 * b + 15), key=repr)


def test_merged_boxes_are_sorted_by_numbers(spark, monkeypatch):
    points = spark.range(50).selectExpr("id", "double(id) as x", "1.0D as y")
    boxes = spark.range(3).selectExpr("id as box", "double(id * 10) as l", "0.0D as b", "double(id * 10 + 15) as r", "2.0D as t")
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 2)
    text = plan(spatial.range_join(points, boxes, "x", "y"))
    assert "SortMergeJoin [_cx" in text and "lambda" not in text
    widths = [0.0, 2.0**-10, 0.001, 1.0, 1.5, 2.0**50, 2.0**51, float("inf"), float("nan"), None]
    levels = [r[0] for r in spark.createDataFrame([(w,) for w in widths], "w double").coalesce(1).select(spatial.cell_level(F.col("w"), spatial.FINEST)).collect()]
    assert levels == [0, 0, 1, 5, 6, 30, 31, 31, 31, 0]


def test_points_are_moved_once_where_few_boxes_are_wide(spark, monkeypatch):
    width = "case id % 100 when 0 then 100 when 1 then 10 when 2 then 10 else 1 end"
    points = spark.range(300).selectExpr("id", "case id when 7 then null when 8 then double('nan') when 9 then double('inf') else id * 0.37D end as x", "double(id % 5) as y")
    boxes = spark.range(200).selectExpr("id as box", "double(id - 20) as l", "double(id % 3) as b", f"case id when 11 then double('inf') when 12 then double('nan') else double(id - 20) + {width} end as r", "double(id % 3 + id % 2) as t")
    hit = F.expr("x between l and r and y between b and t")
    wanted = rows(points.join(boxes, hit).select("id", "box"))
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 2)
    for most in (None, 5):
        assert rows(spatial.range_join(points, boxes, "x", "y", most=most).select("id", "box")) == wanted
    plain, once = boxes.where("box not in (11, 12)"), points.where("id not in (8, 9)").withColumn("y", F.lit(1.0))
    found = spatial.range_join(once, plain.withColumns({"b": F.lit(1.0), "t": F.lit(1.0)}), "x", "y")
    assert "explode([[5,0]])" in plan(found).replace(" ", "") and "_nl" not in plan(found)  # three widths, one level
    assert found.count() == once.join(plain, F.expr("x between l and r")).count() > 300
    monkeypatch.setattr(spatial, "CUT", 4)
    assert rows(spatial.range_join(points, boxes, "x", "y").select("id", "box")) == wanted


def test_no_row_is_dealt_without_heavy_cells(spark):
    side = spark.range(20).selectExpr("id % 5 as k", "id")
    assert spatial._split_heavy(side, side, ["k"], 4) == (side, side, ["k"])
    assert spatial._split_heavy(side, side, ["k"], 3)[2] == ["k", "_i", "_j"]


def test_literal_links_are_broadcast(spark):
    chars = spark.range(30).selectExpr("1 as page", "id as event_id", "double(id) as x", "1.0D as y")
    links = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 2.0, 1, 1), (1, 5.0, 0.0, 15.0, 2.0, 2, 2)], "page int, l double, b double, r double, t double, target int, ord int")
    found = layout.object_linked(chars, links, ["page"], "event_id")
    assert "BroadcastHashJoin" in plan(found)
    assert rows(found) == sorted(((1, k, 1 if k < 5 else 2) for k in range(16)), key=repr)


def test_border_lines_are_broadcast(spark, tmp_path):
    spark.range(12).selectExpr("id as event_id", "double(id * 5) as value").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["q86_border_lookup"](spark, str(tmp_path))
    assert "BroadcastHashJoin" in plan(found)
    assert rows(found) == sorted(((k, 1 if k < 5 else 3 if k < 9 else 2) for k in range(12)), key=repr)


def test_border_look_up_is_summed_up_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(12).selectExpr("id as event_id", "double(id * 5) as value").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(layout_queries, "_TASK_ROWS", 4)
    found = QUERIES["q86_border_lookup"](spark, str(tmp_path))
    assert "4), REPARTITION_BY_NUM" in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
    assert rows(found) == sorted(((k, 1 if k < 5 else 3 if k < 9 else 2) for k in range(12)), key=repr)


def test_boxes_of_small_keys_need_no_cells(spark, monkeypatch):
    box = "named_struct('l', double(id % 7), 'b', double(id % 3), 'r', double(id % 7 + id % 4), 't', double(id % 3 + id % 2))"
    side = lambda n, name, out: spark.range(n).selectExpr("if(id % 4 = 0, null, id % 5) as k", f"id as {name}", f"{box} as {out}")
    left, right = side(60, "i", "box"), side(70, "j", "other")
    found = lambda: rows(spatial.box_join(left, right, ["k"]).select("k", "i", "j"))
    plain, text = found(), plan(spatial.box_join(left, right, ["k"]))
    assert plain and "_cx" not in text
    for most in (0, 9 * 10):  # all keys are crowded; some are
        monkeypatch.setattr(spatial, "KEY_PAIRS", most)
        assert "_cx" in plan(spatial.box_join(left, right, ["k"])) and found() == plain


def test_points_and_boxes_of_small_keys_need_no_cells(spark, monkeypatch):
    points = spark.range(90).selectExpr("if(id % 10 = 0, null, id % 4) as k", "id", "double(id % 13) as x", "double(id % 3) as y")
    boxes = spark.range(30).selectExpr("if(id % 7 = 0, null, int(sqrt(id)) % 5) as k", "id as box", "double(id % 11) as l", "0.0D as b", "double(id % 11 + id % 4) as r", "double(id % 3) as t")
    found = lambda: spatial.range_join(points, boxes, "x", "y", ["k"]).select("k", "id", "box")
    few = rows(found())
    assert few == rows(points.join(boxes, "k").where("x between l and r and y between b and t").select("k", "id", "box")) and few
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 2)
    assert rows(found()) == few and "_cx" not in plan(found()) and "Broadcast" not in plan(found())
    for most in (0, 80):  # all keys are crowded; some are
        monkeypatch.setattr(spatial, "KEY_PAIRS", most)
        assert "_cx" in plan(found()) and rows(found()) == few


def test_keys_are_counted_one_side_at_a_time(spark, monkeypatch):
    left, right = spark.range(40).selectExpr("if(id < 30, id % 3, null) as k"), spark.range(12).selectExpr("if(id < 9, 0, id % 3) as k")
    seen, write = [], spatial.written
    monkeypatch.setattr(spatial, "written", lambda df: seen.append(plan(df)) or write(df))
    assert rows(spatial._crowded(left, right, ["k"])) == [] and len(seen) == 2 and "Join" not in "".join(seen)
    for most, wanted in ((9, [(0,), (1,), (2,)]), (10, [(0,)]), (99, [(0,)]), (100, [])):  # 10 x 10, 10 x 1 and 10 x 1 pairs
        monkeypatch.setattr(spatial, "KEY_PAIRS", most)
        assert rows(spatial._crowded(left, right, ["k"])) == wanted


def test_names_are_cut_and_gathered_in_tasks_of_their_parts(spark, tmp_path, monkeypatch):
    spark.range(12).selectExpr("id as p_partkey", "concat('a cold ', id) as p_name").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(extraction_queries, "_TASK_CHARS", 40)
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 2)
    for name, sides, wanted in (("q118_found_words", 1, 2), ("q119_text_in_boxes", 2, "cold")):
        found = QUERIES[name](spark, str(tmp_path))
        # 98 characters: three tasks, to which nothing but parts and names is moved.
        assert plan(found).count("3), REPARTITION_BY_NUM") == plan(found).count("Exchange") == sides
        assert rows(found) == sorted(((k, wanted) for k in range(12)), key=repr)


def test_types_without_structures_skip_the_recursion(spark):
    rows_ = [("A", 0, "uint16_t", "x", 2), ("A", 1, "char", "RESERVED0", 3), ("A", 2, "uint32_t", "y", 0), ("B", 0, "A", "a", 2), ("B", 1, "uint8_t", "b", 0), ("C", 0, "uint8_t", "c", 0)]
    members = spark.createDataFrame([(k, *r) for k in (1, 2, None) for r in rows_], "k int, type string, ord int, member_type string, name string, count int")
    names = ["k", "type", "ord", "name", "byte_offset", "size"]
    assert rows(registers.flattened(members, ["k"]).select(names)) == rows(registers._nested(members, ["k"]).select(names))
    flat = registers.flattened(members.where("type <> 'B'"), ["k"])
    assert "UnionLoop" not in plan(flat) and plan(flat).count("Exchange hashpartitioning") == 1


def test_literal_border_lines_are_broadcast(spark):
    cells = spark.range(4).selectExpr("1 as tab", "id", "double(id * 10) as l", "0.0D as b", "double(id * 10 + 5) as r", "2.0D as t")
    lines = spark.createDataFrame([(1, 0, "vertical", 10.5, 0.0, 4.0, 2.0), (1, 1, "vertical", 10.0, 0.0, 4.0, 3.0), (1, 2, "horizontal", 2.0, 20.0, 30.0, 1.0)], "tab int, ord int, direction string, at double, lo double, hi double, width double")
    found = layout.cell_borders(cells, lines, ["tab"], ["id"], 1.0).select("id", "l", "b", "r", "t")
    assert "BroadcastHashJoin" in plan(found)
    assert rows(found) == [(0, 0.0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 0.0, 0.0)]
