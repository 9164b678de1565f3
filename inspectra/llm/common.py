"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode with none set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inspectra-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition in `packed`.
PACK = 1 << 16


def packed(df: DataFrame, n: int | None = None, rows: int = PACK) -> DataFrame:
    """A stored table of n rows (counted if not given) in as many partitions as they fill. Each shuffle leaves some files for each partition before it; of one partition, joins and groups need none."""
    return df.coalesce(max(1, -(-(df.count() if n is None else n) // rows)))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each made different from all taken ones (and one another) by underscores in front."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in seen:
            name = "_" + name
        seen.add(name.lower())
        out.append(name)
    return out
