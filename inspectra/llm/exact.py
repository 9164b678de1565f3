"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so. Every distinct chunk moves
once, to be verified: all chunks under one SHA-256 identifier are compared byte for byte.
Documents then are ordered lists of verified identifiers, some 2 % of their length, and only
those lists are grouped and compared; texts are not moved again.

Groups of one recipe are counted with map-side sums and joined back from a checkpoint, so the rows of
a hot recipe are one side of a join that adaptive execution splits; no group meets in one task.

Defined cases: null counts as the empty text; every row gets a row, repeated rows too (rows
that repeat a doc_id of a group are kept or dropped together); a group whose ids are all null
has keep_id null and keeps all its rows, as no id tells which; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_GEAR = np.random.default_rng(42).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def chunk_ends(data: bytes, mean_bits: int = 11, most: int = 1 << 16) -> list[int]:
    """Ends of the chunks: where the hash of the last 32 bytes ends in zeros, or `most` bytes after the last end."""
    if len(data) <= 64:
        return [len(data)] if data else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    ends, last = [], 0
    for e in (*(np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1).tolist(), len(data)):
        while e - last > most:
            last += most
            ends.append(last)
        if e > last:
            last = e
            ends.append(e)
    return ends


def identity(chunk: bytes) -> bytes:
    return sha256(chunk).digest()


def chunks(data: bytes, mean_bits: int = 11) -> list[bytes]:
    ends = chunk_ends(data, mean_bits)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_bits: int = 11, identify: Callable[[bytes], bytes] = identity) -> DataFrame:
    """(doc_id, recipe, text_sha256, n_bytes): the ordered chunk identifiers of each row, joined to one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1)]
            own = [b"".join(identify(c) for c in chunks(t, mean_bits)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(own, pa.binary()), pa.array([sha256(t).hexdigest() for t in texts]), pa.array([len(t) for t in texts], pa.int64())],
                names=["doc_id", "recipe", "text_sha256", "n_bytes"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, recipe binary, text_sha256 string, n_bytes long")


def clashing_chunks(docs: DataFrame, text_col: str = "text", mean_bits: int = 11, identify: Callable[[bytes], bytes] = identity) -> DataFrame:
    """Identifiers that stand for more than one byte string. Each distinct chunk of a task is moved once, none is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {c for t in b.column(0) if t.is_valid for c in chunks(t.as_py(), mean_bits)}
            yield pa.RecordBatch.from_arrays([pa.array([identify(c) for c in own], pa.binary()), pa.array(own, pa.binary())], names=["id", "chunk"])

    pieces = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id binary, chunk binary")
    return pieces.groupBy("id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high").select("id")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_bits: int = 11, identify: Callable[[bytes], bytes] = identity) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; the largest doc_id of equal texts stays."""
    own = cut(recipes(docs, id_col, text_col, mean_bits, identify))
    if not clashing_chunks(docs, text_col, mean_bits, identify).isEmpty():
        # Never seen with SHA-256. The identifiers prove nothing then, so whole texts are compared.
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("recipe"))
        own = own.withColumn("text_sha256", F.sha2("recipe", 256))
    groups = cut(own.groupBy("recipe").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    joined = own.join(groups, "recipe", "left").withColumn("keep_id", F.when(F.col("size").isNotNull(), F.col("top")).otherwise(F.col("doc_id")))
    return joined.select(
        "doc_id",
        "keep_id",
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
