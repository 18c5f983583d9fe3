"""Graphs as edge tables: subject, predicate, object, with annotations as further columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import forget, written


def edges(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """Union of (table, subject column, predicate name, object column)."""
    tables = [t.select(F.col(s).cast("string").alias("subject"), F.lit(p).alias("predicate"), F.col(o).cast("string").alias("object")) for t, s, p, o in parts]
    return reduce(DataFrame.unionByName, tables)


def instances(graph: DataFrame, types: DataFrame, wanted: str) -> DataFrame:
    """Subjects of a class or of any class below it, at any depth. types: (child, parent)."""
    below = closure(types, "child", "parent").where(F.col("ancestor") == wanted).select(F.col("descendant").alias("object"))
    below = below.union(below.sparkSession.createDataFrame([(wanted,)], "object string"))
    return graph.where("predicate = 'type'").join(below.distinct(), "object", "left_semi").select("subject").distinct()


def annotated(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Annotations of each relation, gathered and sorted."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("annotation"))


def closure(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(descendant, ancestor) over any number of steps. Paths are doubled each round, so a chain of n takes log2(n)
    rounds; pairs are distinct, so cycles end."""
    found = written(df.select(F.col(child).alias("descendant"), F.col(parent).alias("ancestor")).where("descendant is not null and ancestor is not null").distinct())
    size = found.count()
    while True:
        longer = found.join(found.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("_next")), "ancestor").select("descendant", F.col("_next").alias("ancestor"))
        shorter, found = found, written(found.union(longer).distinct())
        before, size = size, found.count()
        forget(shorter)
        if size == before:
            return found


def last_wins(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """An index from keys to the value that comes last."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def namespaced(df: DataFrame, family: str, columns: tuple[str, ...] = ("subject", "object")) -> DataFrame:
    """Names of a device family's own namespace: `family:name`, and the family as column ns."""
    return df.withColumns({c: F.concat(F.col(family), F.lit(":"), F.col(c)) for c in columns} | {"ns": F.col(family)})


def save(df: DataFrame, path: str) -> None:
    """Edge tables are kept partitioned by predicate, so a look-up of one relation reads its files only."""
    df.write.mode("overwrite").partitionBy("predicate").parquet(path)


def load(spark: SparkSession, path: str, *predicates: str) -> DataFrame:
    """The stored graph, or only some of its relations."""
    df = spark.read.parquet(path)
    return df.where(F.col("predicate").isin(*predicates)) if predicates else df


def clear(spark: SparkSession, path: str) -> None:
    """Delete a stored graph."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
