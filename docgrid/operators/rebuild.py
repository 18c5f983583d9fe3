"""Incremental rebuild: stages that are built again only for the keys whose input has changed.

Each stage keeps three tables under its folder, all partitioned by a hash of the stage's key: `rows` (what it made),
`digests` (for each key of the next stage, a digest of the rows that it finds here) and `seen` (for each key of its own,
the digest of the input it was last built from). A key whose digest differs from the one seen is built again, and a key
that is gone goes. Of the partitions that these keys lie in, the other keys' rows are carried over and the partition is
replaced (dynamic overwrite); no other partition is read or written. What a stage has `seen` is written last, so a run that
dies half way is taken up by the next one, and running twice makes no difference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import forget, written

PARTS = 64


@dataclass(frozen=True)
class Stage:
    """build makes rows of whole groups of the input's rows with equal keys, each group by itself; its rows keep the key."""

    name: str
    key: str
    build: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Built:
    """What a run did in a stage: keys built again or removed, input rows given to build, partitions replaced."""

    stage: str
    keys: int
    rows: int
    parts: int


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def digest(columns: list[str]) -> Column:
    """Aggregate: a digest of a group's rows in whatever order, from sums, so that no task holds a group."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.concat_ws("-", F.count(F.lit(1)), half(1), half(16), half(31))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, parts: list[int] | None = None) -> DataFrame | None:
    """A table, or those of its partitions; None if there is none yet."""
    if not _exists(spark, path):
        return None
    df = spark.read.parquet(path)
    return df if parts is None else df.where(F.col("part").isin(parts))


def _replace(df: DataFrame, path: str, parts: list[int]) -> None:
    """The partitions `parts` of a table hold the rows of df from now on, and are gone if it has none for them."""
    if not _exists(df.sparkSession, path):  # a partition without rows keeps the columns when all others are gone
        df.drop("part").limit(0).write.parquet(f"{path}/part=-1")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    spark = df.sparkSession
    held = {r.part for r in df.select("part").distinct().collect()}  # of the partitions' numbers only
    for part in set(parts) - held:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _among(df: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    return df.join(keys.select(F.col("key").alias("_key")), df[key].eqNullSafe(F.col("_key")), how)


def rebuilt(source: DataFrame, root: str, stages: list[Stage], parts: int = PARTS) -> tuple[DataFrame, list[Built]]:
    """Bring the tables under root in line with source. Returns the last stage's rows and what was done in each stage.

    Keys of all stages may be null. The stages and the number of partitions must be those of the runs before.
    """
    spark, done = source.sparkSession, []
    table, now = source, None
    for at, stage in enumerate(stages):
        home = f"{root}/{stage.name}"
        following = stages[at + 1].key if at + 1 < len(stages) else stage.key
        if now is None:
            now = source.groupBy(F.col(stage.key).alias("key")).agg(digest(source.columns).alias("digest"))
        else:  # what the stage before has told of each of its partitions
            now = now.groupBy("key").agg(digest(["part", "digest"]).alias("digest"))
        seen = _read(spark, f"{home}/seen")
        seen = seen.select(F.col("key").alias("_key"), F.col("digest").alias("_seen")) if seen is not None else now.limit(0).toDF("_key", "_seen")
        both = now.join(seen, now["key"].eqNullSafe(seen["_key"]), "full").where("not (digest <=> _seen)")
        changed = written(both.select(F.when(F.col("digest").isNull(), F.col("_key")).otherwise(F.col("key")).alias("key"), "digest").withColumn("part", _part("key", parts)))
        touched = sorted(r.part for r in changed.select("part").distinct().collect())  # at most `parts` numbers
        if touched:
            alive = changed.where("digest is not null")
            if at:  # only partitions of the stage before that hold one of these keys
                told = _read(spark, f"{root}/{stages[at - 1].name}/digests")
                holding = [r.part for r in _among(told, "key", alive, "left_semi").select("part").distinct().collect()]
                table = _read(spark, f"{root}/{stages[at - 1].name}/rows", holding).drop("part")
            given = written(_among(table, stage.key, alive, "left_semi"))
            fresh = stage.build(given).withColumn("part", _part(stage.key, parts))
            before = _read(spark, f"{home}/rows", touched)
            whole = fresh if before is None else fresh.unionByName(_among(before, stage.key, changed, "left_anti"))
            whole = written(whole)
            _replace(whole, f"{home}/rows", touched)
            told = whole.groupBy("part", F.col(following).alias("key")).agg(digest([c for c in whole.columns if c != "part"]).alias("digest"))
            _replace(told, f"{home}/digests", touched)
            _replace(now.withColumn("part", _part("key", parts)).where(F.col("part").isin(touched)), f"{home}/seen", touched)
            done.append(Built(stage.name, changed.count(), given.count(), len(touched)))
            forget(whole)
            forget(given)
        else:
            done.append(Built(stage.name, 0, 0, 0))
        forget(changed)
        now = _read(spark, f"{home}/digests")
        if now is None:  # nothing has ever been built
            for rest in stages[at:]:
                table = rest.build(table.limit(0))
            return table, [*done, *(Built(rest.name, 0, 0, 0) for rest in stages[at + 1 :])]
    return _read(spark, f"{root}/{stages[-1].name}/rows").drop("part"), done
