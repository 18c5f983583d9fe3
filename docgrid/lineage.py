"""Tables that cut a lineage: written to the shared folder the cluster names, so they outlive any executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode (as in tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docgrid-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, with a folder for each value of the columns `by`, if any."""
    path = new_path(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files under a table made by written(); its rows must no longer be needed."""
    spark = df.sparkSession
    for name in {m[0] for f in df.inputFiles() if (m := re.match(r".*/docgrid-[0-9a-f]{32}(?=/)", f))}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
