"""Quality selection by importance resampling.

Two generative models over hashed word uni- and bigrams, one of the target text (a bounded sample
of documents labelled good, `max_rows`, smallest hash of doc_id first) and one of the raw text
(all documents), give each document the log ratio of
its likelihoods. Gumbel noise, hashed from the doc_id, is added, and the k largest keys are
taken: a sample without replacement with odds in proportion to the ratio.

The models are counts of 2**`bits` buckets; a task counts its documents first and sends a row
for each bucket. The k-th key is found by radix selection, some rounds of counts of at most
2**12 ranges, so neither a sort nor k rows ever meet in one task. Ties of keys go to smaller ids.

Defined cases: null and wordless texts have log ratio 0; repeated rows of a doc_id get the same
key and are taken or left together, which can take the sample over k; null ids draw as the
text "null"; no target rows: every ratio is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: bytes | None, bits: int) -> np.ndarray:
    """Bucket of each word and each pair of neighbours of a text, repeats included."""
    words = text.lower().split() if text else []
    w = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    h = np.concatenate([w, w[:-1] * np.uint64(0x100000001B3) ^ w[1:] * _MIX])
    return (h * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, raw, target) over all rows of docs (text, target boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            for text, target in zip(b.column(0), b.column(1).to_pylist()):
                own = np.bincount(found, minlength=1 << bits) if len(found := buckets(text.as_py(), bits)) > 1 << bits - 4 else None
                for k in (0, 1) if target else (0,):
                    if own is None:
                        np.add.at(n[k], found, 1)
                    else:
                        n[k] += own
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col("text").cast("binary").alias("t"), "target").mapInArrow(run, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, bits: int, smooth: float = 1.0) -> np.ndarray:
    """The log ratio of each bucket; at most 2**bits rows reach the driver."""
    rows = counts.toPandas()
    n = np.full((2, 1 << bits), smooth)
    n[0, rows.bucket] += rows.raw
    n[1, rows.bucket] += rows.target
    if not len(rows) or not rows.target.sum():
        return np.zeros(1 << bits)
    n /= n.sum(1, keepdims=True)
    return np.log(n[1]) - np.log(n[0])


def score(docs: DataFrame, ratios: np.ndarray, bits: int, seed: int = 7) -> DataFrame:
    """(doc_id, log_ratio, key): the log ratio of each row, and the ratio with hashed Gumbel noise."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            got = [float(own[buckets(t.as_py(), bits)].sum()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "log_ratio"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, log_ratio double")
    bits52 = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 12)
    uniform = (bits52.cast("double") + 0.5) / float(1 << 52)
    return rows.withColumn("key", F.col("log_ratio") - F.log(-F.log(uniform)))


def kth_largest(rows: DataFrame, k: int, ranges: int = 1 << 12, few: int = 10_000) -> tuple[float, int] | None:
    """(key, doc_id) of the k-th row in the order key descending, doc_id ascending. Counts of ranges until `few` rows are left; keys are
    doubles, or whole numbers that are divided exactly."""
    whole = rows.schema["key"].dataType.simpleString() != "double"
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    inside = rows
    for _ in range(20):
        n = inside.count()
        if n <= few or low == high:
            break
        if whole:
            at = F.floor((F.col("key").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(-(-(high - low + 1) // ranges)).cast("decimal(38,0)"))
        else:
            at = F.floor((F.col("key") - low) / ((high - low) / ranges))
        counts = inside.groupBy(F.least(at.cast("long"), F.lit(ranges - 1).cast("long")).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        for r in counts.orderBy(F.desc("r")).collect():  # `ranges` rows at most
            if k <= r.n:
                low, high = r.a, r.b
                break
            k -= r.n
        inside = rows.where(F.col("key").between(low, high))
    if low == high and not whole and inside.count() > few:  # one key for all that is left: the same search over ids
        nameless = inside.where("doc_id is null").count()
        top = kth_largest(inside.where("doc_id is not null").select((-F.col("doc_id")).alias("key"), "doc_id"), k - nameless, ranges, few)
        return (low, top[1]) if top is not None else (low, None)
    last = inside.orderBy(F.desc("key"), F.asc("doc_id")).limit(k).orderBy(F.asc("key"), F.desc("doc_id")).first()
    return last.key, last.doc_id


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, bits: int = 16, seed: int = 7, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, log_ratio, key, selected) for every row. `share` of the rows is taken; None: the share of good ones among the labelled."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("target"))
    if share is None:
        share = good.agg(F.avg(F.col("target").cast("int"))).first()[0] or 1.0
    # The ids of the target sample (max_rows at most) are broadcast, so no text is shuffled to find its label.
    few = good.where("target").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    marked = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    ratios = log_ratios(gram_counts(marked, bits), bits)
    own = cut(score(docs, ratios, bits, seed))
    last = kth_largest(own, round(share * own.count()))
    # Of rows with one key those without an id come first.
    tie = F.col("doc_id").isNull() if last is None or last[1] is None else F.col("doc_id").isNull() | (F.col("doc_id") <= last[1])
    taken = F.lit(False) if last is None else (F.col("key") > last[0]) | ((F.col("key") == last[0]) & tie)
    return own.withColumn("selected", taken)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
