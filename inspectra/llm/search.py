"""Ranked lexical search: presence masks over bitmaps, the best masks first.

1. Items (the queries) are taken in blocks of at most `block` (item, term) entries, each a bound on what tasks are told: its terms and weights.
2. One pass over the documents: a task cuts its rows into shards of `shard` documents. A shard is one row: ids and lengths,
   and for each term of the block that it holds a bitmap of its documents and their term counts. Nothing is shuffled; shards are written once.
3. Corpus totals and document frequencies are sums over shards (popcounts), combined before their shuffle.
4. In each shard an item's bitmaps, turned by bit operations, give every document a mask of the item's terms that it holds. Documents are grouped by mask. A
   mask's bound is the sum of its terms' largest parts in this shard. Masks are evaluated by falling bound until the bound is below
   the k-th score so far: none behind it can enter, ties included, so the shard's k best are exact.
5. The k best of the shards' k best, by item: the one shuffle, behind Spark's group limit.

All of the score is in 64-bit integers but for the weight's logarithm. `score` names the two fixed factors.

Defined cases: a null text has no terms and is no document of N; a text or an item without terms ranks nothing; rows that repeat a doc_id are ranked each,
equal scores by ascending doc_id, null ids last; rows that repeat an item_id and its text are one item, with
another text one of their own; a null item_id is an id like others; empty tables give no rows; other columns are ignored. Long texts: a text is held whole in its task, of its terms only counts stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Letters, digits and all bytes above ASCII stay, A-Z in lower case; anything else parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
TOP = 20
SHARD = 8192
#: (item, term) entries of a block of items: a few MB in each task.
BLOCK = 200_000


def terms(text: bytes | None) -> list[bytes]:
    # Only blanks part what is folded; split() knows no blank above ASCII in bytes.
    return text.translate(_FOLD).split() if text else []


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, terms binary[], times int[]): one row for each item with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(terms(t.as_py())) for t in b.column(1)]
            columns = [b.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "terms", "times"])

    rows = items.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("t"))
    found = rows.dropDuplicates(["key"]).mapInArrow(run, "key long, terms array<binary>, times array<int>")
    return cut(found.where(F.size("terms") > 0))


_SHARD = "ids array<long>, lengths array<long>, terms array<struct<term: int, bits: binary, counts: binary>>, n long, total long"


def _shards(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str, shard: int) -> DataFrame:
    """A row for each `shard` documents of a task; in bitmaps of the known terms a document is a bit, in the order of ids."""
    said = docs.sparkSession.sparkContext.broadcast(known)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        ids, lengths, found = zip(*held)
        doc = np.repeat(np.arange(len(held)), [len(f) for f in found])
        term = np.fromiter((t for f in found for t in f), np.int32, len(doc))
        count = np.fromiter((c for f in found for c in f.values()), np.int32, len(doc))
        order = np.argsort(term, kind="stable")
        term, doc, count = term[order], doc[order], count[order]
        edge = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        lists = []
        for lo, hi in zip(edge, np.r_[edge[1:], len(term)]):
            bits = np.zeros(len(held), np.uint8)
            bits[doc[lo:hi]] = 1
            lists.append({"term": int(term[lo]), "bits": np.packbits(bits, bitorder="little").tobytes(), "counts": count[lo:hi].tobytes()})
        row = {"ids": list(ids), "lengths": list(lengths), "terms": lists, "n": sum(n > 0 for n in lengths), "total": sum(lengths)}
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.struct([("term", pa.int32()), ("bits", pa.binary()), ("counts", pa.binary())]))), ("n", pa.int64()), ("total", pa.int64())])
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = said.value, []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = terms(t.as_py())
                held.append((i, len(own), Counter(number[w] for w in own if w in number)))
                if len(held) == shard:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return cut(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, _SHARD))


def best_in_shard(ids: np.ndarray, present: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], top: int) -> list[tuple[int, int]]:
    """(position, score) of the `top` best of a shard. present: a row of bits for each term; parts: of each term the positions of its documents and what it adds to them."""
    n = len(ids)
    own = np.flatnonzero(np.bitwise_or.reduce(present))  # of the bytes, those in which any term has a document
    wide = np.unpackbits(present[:, own], axis=1, bitorder="little")
    at = (own[:, None] * 8 + np.arange(8)).ravel()
    masks = np.packbits(wide, axis=0, bitorder="little").T  # documents x bytes of their mask
    hit = masks.any(1)
    masks, at = np.ascontiguousarray(masks[hit]), at[hit]
    if not len(at):
        return []
    distinct, group = np.unique(masks.view(np.dtype((np.void, masks.shape[1]))).ravel(), return_inverse=True)
    bits = np.unpackbits(distinct.view(np.uint8).reshape(len(distinct), -1), axis=1, bitorder="little")[:, : len(parts)]
    bound = bits.astype(np.int64) @ np.array([added.max() for _, added in parts], np.int64)
    order = np.argsort(-bound, kind="stable")
    by_mask = np.argsort(group, kind="stable")
    begin = np.r_[0, np.cumsum(np.bincount(group, minlength=len(distinct)))]
    key = np.zeros(0, np.int64)
    best, done, step = np.zeros((0, 2), np.int64), 0, 4 * top
    while done < len(order):
        if len(best) >= top and bound[order[done]] < best[top - 1, 1]:
            break
        sizes = np.cumsum(begin[order[done:] + 1] - begin[order[done:]])
        until = done + int(np.searchsorted(sizes, step)) + 1
        key = np.sort(at[np.concatenate([by_mask[begin[g] : begin[g + 1]] for g in order[done:until]])])
        score = np.zeros(len(key), np.int64)
        for places, added in parts:
            p = np.minimum(np.searchsorted(places, key), len(places) - 1)
            score += np.where(places[p] == key, added[p], 0)
        best = np.concatenate([best, np.stack([key, score], 1)[score > 0]])
        best = best[np.lexsort((ids[best[:, 0]], -best[:, 1]))][:top]
        done, step = until, step * 2
    return [(int(p), int(s)) for p, s in best if p < n]


def _ranked(shards: DataFrame, queries: list[tuple[int, list[int], list[int]]], weight: dict[int, int], n_docs: int, total: int, top: int) -> DataFrame:
    """(key, doc_id, score): the `top` best of every shard for each query (key, terms, times)."""
    said = shards.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = said.value
        for b in batches:
            for row in b.to_pylist():
                raw = np.array(row["lengths"], np.int64)
                ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
                m = 75 + (25 * raw * n_docs) // total
                bitmap, part = {}, {}
                for t in row["terms"]:
                    bits = np.frombuffer(t["bits"], np.uint8)
                    places = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
                    tf = np.frombuffer(t["counts"], np.int32).astype(np.int64)
                    bitmap[t["term"]], part[t["term"]] = bits, (places, weight[t["term"]] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[places])))
                out: list[tuple] = []
                for key, own, times in queries:
                    held = [(t, k) for t, k in zip(own, times) if t in bitmap]
                    if held:
                        parts = [(part[t][0], k * part[t][1]) for t, k in held]
                        out += [(key, row["ids"][p], s) for p, s in best_in_shard(ids, np.stack([bitmap[t] for t, _ in held]), parts, top)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["key", "doc_id", "score"])

    return shards.select("ids", "lengths", "terms").mapInArrow(run, "key long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item with a score above 0."""
    wanted = _items(items, item_col, item_text)
    entries = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-entries // block))
    out = None
    for k in range(blocks):
        rows = wanted.where(F.pmod("key", F.lit(blocks)) == k).select("key", "terms", "times").collect()  # about `block` entries
        known: dict[bytes, int] = {}
        queries = [(r.key, [known.setdefault(bytes(t), len(known)) for t in r.terms], list(r.times)) for r in rows]
        shards = _shards(docs, known, id_col, text_col, shard)
        n_docs, total = shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        pieces = shards.select(F.inline("terms")).select("term", F.expr("octet_length(counts) div 4").alias("n"))
        weighed = pieces.groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(F.lit(1000) * F.ln((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1)))
        weights = {r.term: r.w for r in weighed.select("term", weight.alias("w")).collect()}  # at most the block's terms
        found = _ranked(shards, queries, weights, n_docs, max(total, 1), top)
        out = found if out is None else out.unionByName(found)
    # An item's rows are few a task behind the group limit; nulls of doc_id come last.
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = items.select(F.xxhash64(item_col, item_text).alias("key"), F.col(item_col).alias("item_id")).dropDuplicates(["key"])
    return ranked.join(named, "key").select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM held),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY term, big_n),
q AS (SELECT item_id, term, count(*)::BIGINT AS times
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))))::BIGINT AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN held USING (doc_id), total GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
