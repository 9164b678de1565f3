"""Ranked search against a plain computation over all pairs of items and documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectra.llm.search import best_in_shard, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top):
    split = lambda t: TERM.findall((t or "").translate(FOLD))
    held = [(i, split(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, w in held:
            tf, m = Counter(w), 75 + (25 * len(w) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in split(text) if tf[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


def got(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("shard,block", [(3, 200_000), (7, 5), (8192, 1)])
def test_equals_brute_force(spark, shard, block):
    rng = random.Random(shard)
    vocabulary = [f"W{i}" for i in range(30)] + ["naïve", "日本", "A-b", "x_y", "9"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 40])))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, " .,- "), (None, "W1 W2"), (5, docs[5][1]), (6, "W3 w3 W3"), (63, "W1 " * 50_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(9)] + [(9, None), (10, "!"), (11, "unknown"), (None, "W3 w3 9"), (1, "日本 w4"), (2, "W2 W2 W2"), (2, "W2 W2 W2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"key": F.lit(1), "rank": F.lit("x"), "terms": F.lit(0)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"key": F.lit("k"), "times": F.lit(2)})
    assert got(search(d, q, 4, shard=shard, block=block)) == sorted(plain(docs, items, 4), key=str)


def test_ties_take_the_smallest_ids_over_shards(spark):
    docs = [(i, "alpha beta") for i in range(50, 0, -1)] + [(100, "gamma")]
    found = search(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, "alpha")], "item_id long, text string"), 5, shard=8)
    assert [(r.rank, r.doc_id) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert search(docs, none).count() == 0
    assert search(docs.limit(0), none.union(spark.createDataFrame([(1, "a")], none.schema))).count() == 0


def test_terms_keep_bytes_above_ascii():
    assert terms("Ab\x1cC\u0085d E_f [g] É".encode()) == [b"ab", "c\u0085d e".encode(), b"f", b"g", "É".encode()]


def test_masks_stop_early_and_stay_exact():
    """Evaluated or not, the k best of a shard are those of all its documents."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, width = int(rng.integers(1, 300)), int(rng.integers(1, 70))
        has = rng.random((width, n)) < rng.random((width, 1))
        has = has[has.any(1)]
        if not len(has):
            continue
        parts = [(np.flatnonzero(h), rng.integers(0, 4, int(h.sum())).astype(np.int64)) for h in has]
        total = np.zeros(n, np.int64)
        for places, added in parts:
            total[places] += added
        want = [(int(i), int(total[i])) for i in np.lexsort((np.arange(n), -total)) if total[i] > 0][:5]
        assert best_in_shard(np.arange(n), np.packbits(has, axis=1, bitorder="little"), parts, 5) == want
