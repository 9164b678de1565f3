"""Cutting a plan that several others read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of spark.checkpoint.dir; a temporary folder only in local mode with none set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Rows worked out once, as Parquet in a folder cut-<random> of the shared folder: for wide tables, since a checkpoint holds rows as they lie in memory and is always read whole.

    The shuffle files of this write are dropped as it ends, since nothing else reads them; else those of all steps of a query would lie on the disks together until the driver collects garbage."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inspectra-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found
