"""Incremental rebuild against full builds."""

from conftest import rows
from pyspark.sql import functions as F

from docgrid.operators import rebuild

C = F.col
STAGES = [
    rebuild.Stage("words", "id", lambda d: d.select("id", F.explode(F.split("text", " ")).alias("word"))),
    rebuild.Stage("counts", "word", lambda d: d.groupBy("word").agg(F.count(F.lit(1)).alias("n"))),
    rebuild.Stage("lengths", "size", lambda d: d.groupBy("size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))),
]
STAGES[1] = rebuild.Stage("counts", "word", lambda d: d.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.length("word").alias("size")))


def full(df):
    for stage in STAGES:
        df = stage.build(df)
    return rows(df.select("size", "n", "words"))


def run(df, root):
    found, done = rebuild.rebuilt(df, root, STAGES, parts=8)
    return rows(found.select("size", "n", "words")), {b.stage: b for b in done}


def test_only_what_changed_is_built(spark, tmp_path):
    make = lambda rs: spark.createDataFrame(rs, "id int, text string")
    root = str(tmp_path / "tables")
    pages = [(k, f"word{k} common to all") for k in range(40)] + [(None, "null key"), (50, "twice"), (50, "twice"), (51, None)]
    got, done = run(make(pages), root)
    assert got == full(make(pages)) and done["words"].rows == len(pages)
    got, done = run(make(pages[::-1]), root)
    assert got == full(make(pages)) and all(b.keys == b.rows == b.parts == 0 for b in done.values())
    # One changed, one new, one removed.
    later = [(3, "word3 common to none"), *(p for p in pages if p[0] not in (3, 7)), (99, "brandnew")]
    got, done = run(make(later), root)
    assert got == full(make(later))
    assert (done["words"].keys, done["words"].rows) == (3, 2) and done["words"].parts <= 3
    # Words whose rows changed: what page 3 lost and got, those of page 7, and the new page's; "word3" is as it was.
    assert done["counts"].keys == len({"all", "none", "common", "to", "word7", "brandnew"}) and done["counts"].rows < 3 * len(pages)
    # Sizes 5 (word3..., gone word7), 6, 2, 3, 4, 8 hold words whose counts changed.
    assert done["lengths"].keys <= 6
    got, done = run(make([]), root)
    assert got == [] and done["words"].rows == 0
    got, done = run(make(later), root)
    assert got == full(make(later))


def test_a_run_that_died_is_taken_up(spark, tmp_path):
    make = lambda rs: spark.createDataFrame(rs, "id int, text string")
    root, pages = str(tmp_path / "tables"), [(k, f"a{k % 3} b") for k in range(20)]
    run(make(pages), root)
    later = make([*pages[1:], (77, "a1 c")])

    def fails(d):
        raise RuntimeError("lost")

    broken = [STAGES[0], rebuild.Stage("counts", "word", fails), STAGES[2]]
    try:
        rebuild.rebuilt(later, root, broken, parts=8)
    except RuntimeError:
        pass
    got, done = run(later, root)
    assert got == full(later) and done["words"].keys == 0 and done["counts"].keys > 0


def test_nothing_at_all(spark, tmp_path):
    got, done = run(spark.createDataFrame([], "id int, text string"), str(tmp_path / "none"))
    assert got == [] and done["words"].keys == 0
