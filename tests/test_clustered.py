"""Tables laid out by page."""

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from docgrid.operators import clustered
from docgrid.plans import layout_queries


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_chain_has_one_exchange(spark, no_broadcast):
    """The one that lays the table out; windows, groups and the join of the chain have none."""
    found = layout_queries.page_chain(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_tables_are_opened_again(spark, tmp_path, no_broadcast):
    df = spark.range(500).select((F.col("id") % 7).alias("doc"), (F.col("id") % 3).alias("page"), "id")
    clustered.laid_out(df, ["doc", "page"], ["id"], path=f"{tmp_path}/t", buckets=4)
    again = clustered.opened(spark, "doc bigint, page bigint, id bigint", ["doc", "page"], ["id"], f"{tmp_path}/t", buckets=4)
    assert rows(again) == rows(df)
    summed = again.groupBy("doc", "page", (F.col("id") % 2).alias("odd")).count()
    assert "Exchange" not in summed._jdf.queryExecution().executedPlan().toString()
    one = again.where("doc = 3 and page = 1")
    assert rows(one) == rows(df.where("doc = 3 and page = 1")) and "EqualTo(doc,3)" in one._jdf.queryExecution().executedPlan().toString()
