"""Language identification by bit-sliced n-gram Bloom filters.

One table of slots serves all languages: bit L of a slot is language L's Bloom filter, so the
AND of an n-gram's slots is the mask of all languages that hold it. A document's n-grams
are looked up at once; each language's popcount is corrected for the false positives that its
own fill predicts, and the largest decides.

A language holds an n-gram if a share `least_share` of its training documents do, and at least
`relative` of the largest share of any language (so foreign lines in a text teach little).
Training counts are summed by Spark over a bounded sample (`max_rows`, smallest hash first).

Defined cases: null texts and texts without a letter are `und` with score 0; a text none of whose
n-grams is known takes the first language in order, with score 0; ties take the first language;
repeated rows each get a row; no training rows: all `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SLOTS = 1 << 18
HASHES = 3
_A, _B, _C, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class _Letters(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c.lower() if c.isalpha() else " "
        return out


_LETTERS = _Letters()


def grams(text: str | None) -> np.ndarray:
    """Hashes of the letter trigrams of a text (blanks mark word ends), repeats included; empty without a letter."""
    t = f" {' '.join((text or '').translate(_LETTERS).split())} "
    if len(t) < 3:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = c[:-2] * _A ^ c[1:-1] * _B ^ c[2:] * _C
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ h >> np.uint64(32)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(18 * i) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


class Filters:
    """The slot table. 64 languages to a word of the mask; more languages take more words."""

    def __init__(self, langs: list[str], grams_: np.ndarray, lang_of: np.ndarray):
        self.langs = langs
        self.table = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), np.uint64)
        for word in range(len(self.table)):
            own = lang_of // 64 == word
            bit = np.uint64(1) << (lang_of[own] % 64).astype(np.uint64)
            for s in _slots(grams_[own]):
                np.bitwise_or.at(self.table[word], s, bit)
        fill = [(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))]
        self.false_positive = np.array(fill) ** HASHES if langs else np.zeros(0)

    def scores(self, text: str | None) -> np.ndarray | None:
        """Corrected popcount of each language; None without a letter or a language."""
        h = grams(text)
        if not len(h) or not self.langs:
            return None
        hits = np.zeros(len(self.langs))
        for word, slots in enumerate(self.table):
            a, b, c = (slots[s] for s in _slots(h))
            mask = a & b & c
            for i in range(word * 64, min(len(self.langs), word * 64 + 64)):
                hits[i] = np.count_nonzero(mask >> np.uint64(i % 64) & np.uint64(1))
        return np.clip((hits - len(h) * self.false_positive) / np.maximum(1 - self.false_positive, 1e-9), 0, None)

    def predict(self, text: str | None) -> tuple[str, float]:
        s = self.scores(text)
        if s is None:
            return "und", 0.0
        i, total = int(s.argmax()), float(s.sum())
        return self.langs[i], float(s[i] / total) if total else 0.0


def fit(docs: DataFrame, allowed, max_rows: int = 20_000, least_share: float = 0.002, relative: float = 0.3) -> Filters:
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & allowed(F.col("doc_id"))).select("doc_id").distinct()
    few = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = cut(docs.select("doc_id", "lang", "text").where("lang is not null").join(F.broadcast(few), "doc_id").select("lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own.setdefault(lang, []).append(np.unique(grams(text)))
        for lang, parts in own.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    sizes = sample.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    shares = counts.join(sizes, "lang").withColumn("share", F.col("n") / F.col("docs"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    kept = shares.join(best, "gram").where((F.col("share") >= least_share) & (F.col("share") >= F.col("best") * relative) & (F.col("n") > 1))
    rows = kept.select("gram", "lang").toPandas()  # trigrams of the bounded sample
    langs = sorted(r.lang for r in sizes.select("lang").collect())
    at = {x: i for i, x in enumerate(langs)}
    return Filters(langs, rows.gram.to_numpy(np.int64).view(np.uint64), rows.lang.map(at).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, without a shuffle. The filters (2 MB for each 64 languages) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            got = [own.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs, lambda i: ~held_out(i))
    return identify(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
