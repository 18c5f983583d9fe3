"""Memory maps as long tables: device, peripheral, register, field, with addresses in bits as bigint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import ordered, running_offset


def expanded_range(df: DataFrame, lo: str, hi: str, step: int, name: str) -> DataFrame:
    """A register array from byte offset lo to hi: one row an element, `x` in its name replaced by the index."""
    at = df.select("*", F.posexplode(F.sequence(lo, hi, F.lit(step).cast("bigint"))).alias("index", "byte_offset"))
    return at.withColumn(name, F.replace(name, F.lit("x"), F.col("index").cast("string")))


def coalesced_fields(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Bits of one name become one field from the lowest to the highest; gaps count to the width."""
    return df.groupBy(*keys).agg(F.min(position).alias("position"), (F.max(position) + 1 - F.min(position)).alias("width"))


def materialised(instances: DataFrame, types: DataFrame, type_key: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Instances with the columns of their types, and the instances whose type is missing."""
    found = instances.join(types, F.col(type_key) == F.col(key), "left")
    return found.where(F.col(key).isNotNull()), found.where(F.col(key).isNull()).select(*instances.columns)


def enum_vectors(df: DataFrame, name: str) -> DataFrame:
    """Interrupt vectors from enumerators: the leading number is the position, the suffix `_IRQn` goes."""
    return df.select(F.regexp_extract(name, r"^(\d+)", 1).cast("int").alias("position"), F.regexp_replace(name, "_IRQn$", "").alias("name"))


def best_match(candidates: DataFrame, keys: list[str], filters: str) -> DataFrame:
    """The candidate with most filters for each key; more than one of equal rank makes `ambiguous` true."""
    ranked = candidates.withColumn("_n", F.size(filters)).withColumn("_top", F.max("_n").over(_all(keys)))
    top = ranked.where("_n = _top")
    return top.withColumn("ambiguous", F.count(F.lit(1)).over(_all(keys)) > 1).drop("_n", "_top")


def _all(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def deduplicated(df: DataFrame, device: str, *tree: str) -> DataFrame:
    """Devices with equal trees become one: (device, compatible)."""
    prints = df.groupBy(device).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*tree)))), 256).alias("print"))
    return prints.groupBy("print").agg(F.min(device).alias(device), F.sort_array(F.collect_list(device)).alias("compatible")).drop("print")


def struct_offsets(members: DataFrame, type_col: str, order: list[str], size: Column) -> DataFrame:
    """Byte offset of each member of a C structure; reserved members take room like any other."""
    return members.withColumn("byte_offset", running_offset(size, ordered([type_col], *order)))


def folded(channels: DataFrame, device: str, address: str, is_parent: Column, name: str) -> DataFrame:
    """Channels folded into the nearest parent at or before their address: (parent, delta) for every row."""
    w = ordered([device], address)
    parent = F.last(F.when(is_parent, F.struct(name, address)), ignorenulls=True).over(w)
    return channels.withColumn("_p", parent).select("*", F.col(f"_p.{name}").alias("parent"), (F.col(address) - F.col(f"_p.{address}")).alias("delta")).drop("_p")


def bit_addresses(df: DataFrame) -> DataFrame:
    """paddr, offset, position (and widths) -> bit address of each field."""
    return df.withColumn("bit_address", (F.col("paddr") + F.col("offset")).cast("bigint") * 8 + F.col("position"))


def xml_round_trip(df: DataFrame) -> DataFrame:
    """Rows written as XML elements and parsed again."""
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    text = df.select(F.to_xml(F.struct(*df.columns)).alias("x"))
    return text.select(F.from_xml("x", schema).alias("r")).select("r.*")


def write_svd(df: DataFrame, path: str) -> None:
    """Peripherals (nested registers and fields) as XML; addresses in hexadecimal."""
    df.write.format("xml").option("rootTag", "device").option("rowTag", "peripheral").mode("overwrite").save(path)


def read_svd(spark, path: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", "peripheral")
    return (reader.schema(schema) if schema else reader).load(path)
