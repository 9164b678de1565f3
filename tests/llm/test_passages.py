import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inspectra.llm.passages import merged, repeated_anchors
from inspectra.llm.substring import substring_dedup
from inspectra.llm.suffixes import repeated_starts, suffix_dedup


def corpus(seed, alphabet, n, most):
    rng = random.Random(seed)
    shared = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, most))) for _ in range(5)]
    out = [None, "", " "]
    for _ in range(n):
        t = "".join(rng.choice([*shared, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, most)))]) for _ in range(rng.randint(0, 5)))
        out.append(t)
        if rng.random() < 0.2:
            out.append(t)
    return out


def brute_bytes(texts, width):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, width):
    data = [(t or "").encode().split() for t in texts]
    first = {}
    for d, w in enumerate(data):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = []
    for d, w in enumerate(data):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def test_merged():
    assert merged([(5, 9), (0, 3), (2, 4), (8, 1 << 62)], 12) == [[0, 4], [5, 12]]


def test_repeated_starts():
    rng = random.Random(1)
    for _ in range(30):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(4)]
        n = {}
        for p in parts:
            for i in range(len(p) - 5):
                n[p[i : i + 6]] = n.get(p[i : i + 6], 0) + 1
        want = [[i for i in range(len(p) - 5) if n[p[i : i + 6]] > 1] for p in parts]
        assert [x.tolist() for x in repeated_starts(parts, 6)] == want


#: Limits of ordinary groups, and such that nearly all groups are hot or too large.
HOT = [{}, {"often": 2, "many": 3}, {"many": 2}]


@pytest.mark.parametrize("limits", [*HOT, {"most": 40}, {"most": 40, "often": 3}])
def test_suffix_dedup(spark, limits):
    texts = corpus(2, "ab é", 40, 60) + ["abcdefgh" * 30]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs string").repartition(3)
    got = {r.doc_id: (r.n_items, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, 24, **limits).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, 24)


@pytest.mark.parametrize("limits", HOT)
def test_substring_dedup(spark, limits):
    texts = corpus(4, ["a ", "b ", "ç\n", "d  "], 40, 30)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs string").repartition(3)
    got = {r.doc_id: (r.n_items, r.n_removed, r.kept_sha256) for r in substring_dedup(df, 5, **limits).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, 5)


def test_common_passage_with_differing_surroundings(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    shared = " ".join(word() for _ in range(40))
    texts = [" ".join([*(word() for _ in range(20)), shared, *(word() for _ in range(20))]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_items, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, 60, often=5, many=10, most=400).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, 60)
    got = {r.doc_id: (r.n_items, r.n_removed, r.kept_sha256) for r in substring_dedup(df, often=5, many=10).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, 13)


def test_repeated_anchors_over_batches():
    rng = random.Random(3)
    rows = sorted([(rng.randrange(12), rng.randrange(5), 0, i, False) for i in range(200)] + [(3, 0, 0, -1, False), (40, 0, 0, -1, False), (50, 1, 0, 7, False)], key=lambda x: (x[0], x[3]))
    rows += [(9, 2, 0, 1000, True)]
    n = Counter(a for a, _, _, r, known in rows if not known and r >= 0)
    for size in (1, 3, 50, 500):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("anchor", "doc_id", "own", "run", "known"), r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = Counter(tuple(r.values()) for b in repeated_anchors(iter(batches), 18) for r in b.to_pylist())
        want = Counter((d, o, 2 * r + (known or a == 3 or n[a] > 18)) for a, d, o, r, known in rows if r >= 0 and (known or n[a] > 1 or a == 3))
        assert got == want


def test_repeated_id_with_two_texts(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (8, f"{z} {y}"), (5, z)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    texts = [t for _, t in rows]
    got = sorted((r.n_items, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, 24).collect())
    assert got == sorted(brute_bytes(texts, 24))
    got = sorted((r.doc_id, r.n_items, r.n_removed) for r in substring_dedup(df, 5).collect())
    assert got == [(3, 30, 0), (5, 30, 0), (5, 30, 0), (5, 30, 30), (8, 60, 60)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(df).count() == 0 and substring_dedup(df).count() == 0
