"""Tables laid out by document and page, so that the steps of a layout analysis need no exchange of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..lineage import new_path

BUCKETS = 64


def laid_out(df: DataFrame, keys: list[str], order: list[str], name: str | None = None, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df as a table in buckets of its keys, a file each, sorted by keys and order.

    Windows, groups and joins by the keys, or by these and more columns, read it without an exchange; the one made here is
    all that a chain of them costs. Two tables of equal keys and numbers of buckets are joined as they lie. Within a file
    documents follow one another, so the statistics of its row groups let filters on them pass over the rest. Take as keys
    what no single value of holds a large share of the rows: document and page, rather than the document alone.

    The session is told that being clustered by some of the keys is enough for a join by more of them.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = name or f"docgrid_{uuid.uuid4().hex}"
    # Dealt as the buckets are, so that each task writes one file.
    rows = df.repartition(buckets, *keys).sortWithinPartitions(*keys, *order)
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path or new_path(spark)).saveAsTable(name)
    return spark.table(name)


def opened(spark: SparkSession, schema: str, keys: list[str], order: list[str], path: str, buckets: int = BUCKETS) -> DataFrame:
    """A table that another session laid out with the same keys, order and number of buckets."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"docgrid_{uuid.uuid4().hex}"
    listed = lambda names: ", ".join(f"`{n}`" for n in names)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({listed(keys)}) SORTED BY ({listed([*keys, *order])}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
