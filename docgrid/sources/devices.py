"""Device databases in XML: one row a device, kept as a table partitioned by family for look-ups of one device."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "_family string, _name string, _pin string, _size string, _package string, _variant string, driver array<struct<_name:string,_type:string,instance:array<struct<_name:string>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, family, name, pin, size, package, variant, drivers: map name -> instances) of all files below the path."""
    rows = spark.read.format("xml").option("rowTag", "device").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").schema(SCHEMA).load(path)
    parts = ["family", "name", "pin", "size", "package", "variant"]
    named = F.transform(F.coalesce("driver", F.array().cast("array<struct<_name:string,_type:string,instance:array<struct<_name:string>>>>")), lambda d: F.struct(d["_name"].alias("key"), F.transform(F.coalesce(d["instance"], F.array().cast("array<struct<_name:string>>")), lambda i: i["_name"]).alias("value")))
    rows = rows.select(*[F.col(f"_{p}").alias(p) for p in parts], F.map_from_entries(named).alias("drivers"))
    return rows.select(F.concat(F.lit("stm32"), *[F.coalesce(p, F.lit("")) for p in parts]).alias("identifier"), "*")


def store(devices: DataFrame, path: str) -> None:
    devices.write.mode("overwrite").partitionBy("family").parquet(path)


def names(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers only; no other column is read."""
    return spark.read.parquet(path).select("identifier").orderBy("identifier")


def one(spark: SparkSession, path: str, family: str, identifier: str) -> DataFrame:
    """The row of one device; only its family's files are read."""
    return spark.read.parquet(path).where((F.col("family") == family) & (F.col("identifier") == identifier))
