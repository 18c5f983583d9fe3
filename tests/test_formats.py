"""Data sources and table functions."""

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from docgrid.functions import table_functions
from docgrid.sources import formats, headers

C = F.col
PAGE = "<h1>T{0}</h1><p>a &lt; b</p><table><caption>pin definition</caption><tr><th>Pin name</th><th>Type</th></tr><tr><td>PA{0}</td><td>I/O</td></tr><tr><td>PB</td><td></td></tr></table>"


@pytest.fixture()
def folder(spark, tmp_path):
    formats.register(spark)
    pages = [(f"D{k % 3}", str(k % 2), f"chapter {k}", PAGE.format(k)) for k in range(12)] + [("D9", "1", "chapter 0", None)]
    spark.createDataFrame(pages, "document string, version string, chapter string, html string").write.format("htmlpages").mode("append").save(str(tmp_path))
    return str(tmp_path)


def test_html_folder(spark, folder):
    df = spark.read.format("htmlpages").option("partitionBytes", 300).load(folder)
    heads = df.where("kind = 'heading'").select("document", "version", "chapter", "text")
    assert rows(heads) == sorted([(f"D{k % 3}", str(k % 2), f"chapter {k}", f"T{k}") for k in range(12)], key=repr)
    assert rows(df.where("kind = 'text'").select("text").distinct()) == [("a < b",), ("pin definition",)] and df.where("document = 'D9'").count() == 0
    assert df.where("document in ('D1', 'D2') and kind = 'heading' and length(text) > 2").count() == 2
    with pytest.raises(Exception, match="can be appended"):
        heads.write.format("htmlpages").mode("overwrite").save(folder)


def test_filters_choose_files(folder):
    parser = formats.HtmlParser({"path": folder})
    reader = formats._Reader(parser)
    left = list(reader.pushFilters([EqualTo(("document",), "D1"), In(("chapter",), ("chapter 1", "chapter 4", "chapter 5")), EqualTo(("kind",), "heading"), GreaterThan(("item",), 3)]))
    assert left == [GreaterThan(("item",), 3)]
    opened = [p for part in reader.partitions() for p in part.paths]
    assert sorted(p.rsplit("/", 1)[1] for p in opened) == ["chapter_1.html", "chapter_4.html"]
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == 2
    with pytest.raises(ValueError, match="mounted"):
        formats.HtmlParser({"path": "hdfs://host/x"})


def test_pushed_filters_cut_the_rows_read(spark, folder):
    def read(condition):
        df = spark.read.format("htmlpages").load(folder).where(condition)
        df.collect()
        metric = lambda node: [node] + [x for k in range(node.children().size()) for x in metric(node.children().apply(k))]
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
        return [n.metrics().get("numOutputRows").get().value() for n in metric(plan) if "BatchScan" in n.nodeName()][0]

    assert read("length(text) >= 0") > 40 and read("kind = 'heading'") == 12 and read("document = 'D1' and kind = 'heading'") == 4


def test_html_stream(spark, folder, tmp_path):
    out, state = str(tmp_path / "_out"), str(tmp_path / "_state")

    def run():
        stream = spark.readStream.format("htmlpages").option("settle", 0).load(folder).where("kind = 'heading'")
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(out).collect())

    first = run()
    assert first == sorted(f"T{k}" for k in range(12)) and run() == first
    spark.createDataFrame([("D7", "1", "chapter 77", PAGE.format(77))], "document string, version string, chapter string, html string").write.format("htmlpages").mode("append").save(folder)
    assert run() == sorted([*first, "T77"])


def test_headers(spark, tmp_path):
    formats.register(spark)
    text = "/* x */ typedef struct {\n __IO uint32_t CR1; // c\n uint32_t R[0x2];\n odd (*f)(void);\n} ADC_T;\n#define A 1\n#define B \\\n (A + 2)\n#define F(x) x\n"
    (tmp_path / "a.h").write_text(text)
    (tmp_path / "b.h").write_text("#define C 3\n")
    df = spark.read.format("cheader").load(str(tmp_path))
    files = headers.scan(spark, str(tmp_path))
    own = headers.structures(files).select(F.regexp_replace("file", r"\.h$", "").alias("d"), "type", C("ord").cast("bigint"), "name", "member_type", C("count").cast("bigint"))
    assert rows(df.where("kind = 'member'").select("document", "owner", "ord", "name", "value", "count")) == rows(own)
    assert rows(df.where("kind = 'define'").select("document", "name", "value")) == [("a", "A", "1"), ("a", "B", "(A + 2)"), ("b", "C", "3")]
    assert df.where("document = 'b'").count() == 1


def test_table_functions(spark):
    table_functions.register(spark)
    pages = spark.createDataFrame([(k, PAGE.format(k)) for k in range(3)] + [(9, None), (10, "")], "page_id int, html string")
    got = spark.sql("SELECT page_id, r.* FROM {p}, LATERAL html_rows(html, 'pin = ^Pin; kind = Type; other = Nothing', 'PIN def') r", p=pages)
    assert got.columns == ["page_id", "tab", "y", "pin", "kind", "other"]
    assert rows(got) == sorted([(k, 0, y, *v, None) for k in range(3) for y, v in enumerate([(f"PA{k}", "I/O"), ("PB", "")])], key=repr)
    one = spark.sql("SELECT page_id, v.* FROM {p}, LATERAL rule_values(html, 'title = <h1>(.*?)</h1>; any = P[A-Z]') v", p=pages)
    assert one.columns == ["page_id", "title", "any"] and rows(one) == sorted([(k, f"T{k}", "PA") for k in range(3)] + [(9, None, None), (10, "", "")], key=repr)
    cells = spark.createDataFrame([(d, y, x, f"{d}{y}{x}") for d in (1, 2, None) for y in (0, 1) for x in (2, 0)] + [(1, 0, 7, "far"), (1, 0, None, "nowhere")], "doc int, y int, x int, value string")
    grid = spark.sql("SELECT * FROM grid_rows(TABLE({c}), 'a, b, c')", c=cells)
    assert grid.columns == ["doc", "y", "a", "b", "c"]
    assert rows(grid) == sorted([(d, y, f"{d}{y}0", None, f"{d}{y}2") for d in (1, 2, None) for y in (0, 1)], key=repr)
    assert spark.sql("SELECT * FROM grid_rows(TABLE({c}), 'a')", c=cells.limit(0)).count() == 0
    for n in (1, 256):
        many = table_functions.gathered(cells, n)
        assert many.count() == (6 if n == 1 else 3)
        assert rows(spark.sql("SELECT * FROM grid_rows(TABLE({c}), 'a, b, c')", c=many)) == rows(grid)
    with pytest.raises(Exception, match="y is an array, but value is not"):
        spark.sql("SELECT * FROM grid_rows(TABLE({c}), 'a')", c=many.withColumn("value", F.lit("v")))


@pytest.mark.parametrize(("text", "message"), [
    ("SELECT * FROM {p}, LATERAL rule_values(html, html)", "must be a constant string"), ("SELECT * FROM {p}, LATERAL rule_values(html, 'a = (')", "the pattern of a cannot be read"),
    ("SELECT * FROM {p}, LATERAL rule_values(html, 'a = x; A = y')", "a name of its own"), ("SELECT * FROM {p}, LATERAL rule_values(page_id, 'a = x')", "must be a string"),
    ("SELECT * FROM {p}, LATERAL html_rows(html, 'y = x')", "may not be called y"), ("SELECT * FROM grid_rows(TABLE({p}), 'a')", "has no column doc"), ("SELECT * FROM grid_rows(TABLE({c}), 'a, a')", "not a list of different names"),
])
def test_wrong_arguments_are_told(spark, text, message):
    table_functions.register(spark)
    pages = spark.createDataFrame([(1, "x")], "page_id int, html string")
    cells = spark.createDataFrame([(1, 0, 0, "a")], "doc int, y int, x int, value string")
    with pytest.raises(AnalysisException, match=message):
        spark.sql(text, **({"p": pages} if "{p}" in text else {"c": cells})).collect()
