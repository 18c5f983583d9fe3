"""Catalogs of documents: local and remote JSON lists, their difference, versions, and validated sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import best

SCHEMA = "title string, description string, url string, version string, latest_update string, resource_type string"


def remote(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of fetched JSON lists (each an object with an array `rows`)."""
    return spark.read.schema(f"rows array<struct<{', '.join(f.replace(' ', ':') for f in SCHEMA.split(', '))}>>").json(list(paths), multiLine=True).select(F.explode("rows").alias("r")).select("r.*")


def local(spark: SparkSession, path: str) -> DataFrame:
    """A catalog that store() wrote, one row a line; a missing one is empty."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)


def with_filename(df: DataFrame) -> DataFrame:
    """filename: title, `-v`, the version without `.0` and with `_` for other dots."""
    version = F.replace(F.replace(F.col("version"), F.lit(".0"), F.lit("")), F.lit("."), F.lit("_"))
    return df.withColumns({"filename": F.concat("title", F.lit("-v"), version, F.lit(".pdf")), "short_type": F.left("title", F.lit(2))})


def new_documents(remote_df: DataFrame, local_df: DataFrame) -> DataFrame:
    """Documents of the remote list that the local one lacks; a document is its filename."""
    return with_filename(remote_df).dropDuplicates(["filename"]).join(with_filename(local_df).select("filename").distinct(), "filename", "left_anti")


def version_key(version: Column) -> Column:
    """What versions are ordered by: their parts between dots and underscores, each by its leading number and then by what
    follows it (`1.0b` comes behind `1.0`, parts without a number before all numbers). Of two versions of which one is the
    beginning of the other, the longer is the later: `1.0` before `1.0.0`."""
    number = lambda x: F.coalesce(F.regexp_extract(x, r"^\d{1,18}", 0).try_cast("bigint"), F.lit(-1).cast("bigint"))
    parts = F.split(F.regexp_replace(version, "^v", ""), r"[._]")
    return F.transform(parts, lambda x: F.struct(number(x).alias("number"), F.regexp_replace(x, r"^\d{1,18}", "").alias("rest")))


def latest(df: DataFrame, name: str, version: str, lexicographic: bool = False) -> DataFrame:
    """The latest version of each document: by version_key(), or by text order in the compatible form; null versions come
    first, and of equal ones the last in text order is taken."""
    key = F.col(version) if lexicographic else version_key(F.col(version))
    return best(df, [name], key.desc_nulls_last(), F.col(version).desc_nulls_last())


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the rest (nulls included) for a quarantine table."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def unique_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """df, which fails at run time if a key has more than one value."""
    counted = df.groupBy(key).agg(F.count_distinct(value).alias("_n"))
    checked = counted.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.concat(F.lit("several values for "), F.col(key).cast("string"))))
    return df.join(checked.where("_ok is null").select(key), key)


def store(df: DataFrame, path: str) -> None:
    """A catalog is one small JSON file sorted by title and version."""
    df.coalesce(1).sortWithinPartitions("title", "version").write.mode("overwrite").json(path)
