"""A table that micro-batches change a few buckets of at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Rows in buckets of a key. Micro-batch N writes the buckets that it touches whole, as `data/number=N/bucket=B`, then the number of each bucket's
    last version (`manifest/number=N`, one small row a bucket). It reads what the manifest of N - 1 names, so nothing that is read is ever
    overwritten, and a micro-batch that runs again replaces its own files only. What it writes is in proportion to the buckets touched, not to the table.

    The manifest (as many rows as buckets) and the touched buckets' numbers go through the driver, no rows do. Older versions stay until a retention job drops the numbers that no manifest names.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self, number: int) -> dict[int, int]:
        """{bucket: number of its last version} after micro-batch `number`."""
        if number < 0:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version int").parquet(f"{self.folder}/manifest/number={number}").collect()}

    def touched(self, *rows: DataFrame) -> list[int]:
        """The buckets of rows with the key."""
        found: set[int] = set()
        for df in rows:
            found |= {r.b for r in df.select(self.bucket().alias("b")).distinct().collect()}
        return sorted(found)

    def read(self, number: int, only: list[int] | None = None) -> DataFrame:
        """The table after micro-batch `number` (before the first: -1), or some of its buckets."""
        named = [f"{v}/{b}" for b, v in self.versions(number).items() if only is None or b in only]
        if not named:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, number int, bucket int").option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data")
        return rows.where(F.concat_ws("/", "number", "bucket").isin(named)).drop("number", "bucket")

    def write(self, rows: DataFrame, touched: list[int], number: int) -> None:
        """The touched buckets' new rows, whole. A large bucket is written by several tasks, as many as its size asks for: each sorts what it writes."""
        out = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/number={number}")
        versions = self.versions(number - 1) | dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(versions.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/number={number}")
