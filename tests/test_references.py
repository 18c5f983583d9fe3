"""Character references that a text was cut off in: read or kept, as the caller wants."""

import os

import pytest
from conftest import rows

from docgrid.plans.registry import QUERIES
from docgrid.sources import html

HTML = "<html lang=\"en\"><article><h1>a &amp;&lt; b&ampx; c&amp</h1><p>x</p></article></html>"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([(7, "http://a.org/en/1", HTML)], "page_id bigint, url string, html string").write.parquet(os.path.join(path, "pages.parquet"))
    return path


def test_headings_keep_open_references(spark, pages):
    assert rows(QUERIES["q01_page_headings"](spark, pages)) == [(7, "a &< b&ampx; c&amp")]


def test_data_source_keeps_open_references(spark, pages):
    assert rows(QUERIES["q178_html_source"](spark, pages)) == [("D7", "chapter 7", "a &< b&ampx; c&amp")]


def test_items_read_open_references_by_default():
    assert html.parse("<p>c&amp</p>")[0]["html"] == html.parse("<p>c&amp;</p>")[0]["html"] == "c&amp;"
    assert html.parse("<p>&#65; &#x42; &eacute; &copy &</p>", terminated=True)[0]["html"] == "A B é &amp;copy &amp;"
