"""Incremental ingest: new documents of a folder, checked, de-duplicated, and appended to a table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import split_valid


def ingest(spark: SparkSession, source: str, schema: str, valid: Column, key: str, target: str, quarantine: str, checkpoint: str, at: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Rows of new Parquet files: those that pass go to target once a key, the rest to quarantine.

    With an event time, keys are remembered in the state until the watermark has passed them. Without one there is no
    state: a batch is compared with the keys already in target and quarantine.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    unique = rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if at else rows

    def stored(path: str, number: int) -> DataFrame | None:
        """Keys that earlier batches have written."""
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            return None
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).where(F.col("batch") < number).select(key)

    def write(batch: DataFrame, number: int) -> None:
        if not at:
            batch = batch.dropDuplicates([key])
            for path in (target, quarantine):
                if (known := stored(path, number)) is not None:
                    batch = batch.join(known, key, "left_anti")
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # both parts read it; a lost block is computed again
        good, bad = split_valid(batch, valid)
        # Each batch has a folder of its own, so a repeated batch replaces what it wrote.
        good.write.mode("overwrite").parquet(f"{target}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        batch.unpersist()

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by time window; windows close when the watermark passes."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
