"""The learned operators and op1 as registered: held-out accuracy, and counts, masks and choices by brute force."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from inspectra.llm import language, quality
from inspectra.llm.registry import QUERIES
from tests.llm.test_simhash import plain, roots

SF = "/root/testdata/sf0.001"


def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1(spark):
    docs = documents(spark, SF)
    ids = sorted(docs)
    fps = [plain(docs[i].text) for i in ids]
    want = {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, roots(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF).collect()} == want


def test_op6_held_out(spark):
    """Floors of 0.9 for toxic and 0.99 for clean documents, where some 300 toxic ones teach (sf0.1)."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    n = Counter()
    for r in QUERIES["op6_toxicity"](spark, sf).collect():
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and labels.get(r.doc_id) is not None:
            n[labels[r.doc_id], r.predicted] += 1
    assert n[1, 1] >= 0.9 * (n[1, 0] + n[1, 1]) > 20
    assert n[0, 0] >= 0.99 * (n[0, 0] + n[0, 1]) > 300


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    right = Counter()
    for r in QUERIES["op8_language"](spark, sf).collect():
        lang, text = docs[r.doc_id].lang, docs[r.doc_id].text
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and lang is not None:
            right[r.lang_pred == lang] += 1
    assert right[True] >= 0.97 * right.total() > 100


def test_language_masks():
    """The bit-sliced table answers as one set of slots per language would, and counts are corrected by each fill."""
    texts = {"de": "der hund und die katze", "en": "the dog and the cat", "fr": "le chien et le chat", "xx": "ñandú über"}
    langs = sorted(texts)
    held = {x: language.grams(t) for x, t in texts.items()}
    filters = language.Filters(langs, np.concatenate([held[x] for x in langs]), np.concatenate([np.full(len(held[x]), i) for i, x in enumerate(langs)]))
    slots = {x: [set(s.tolist()) for s in map(np.concatenate, [language._slots(h)])] for x, h in held.items()}
    every = {x: slots[x][0] for x in langs}
    for text in [*texts.values(), "the katze et le hund über"]:
        h = language.grams(text)
        each = list(zip(*(s.tolist() for s in language._slots(h))))
        for i, x in enumerate(langs):
            hits = sum(all(s in every[x] for s in g) for g in each)
            wrong = (len(every[x]) / language.SLOTS) ** language.HASHES
            assert math.isclose(filters.scores(text)[i], max(0.0, (hits - len(h) * wrong) / (1 - wrong)))


def bucket_of(text, bits):
    mask = (1 << 64) - 1
    mix = int(quality._MIX)
    w = [crc32(x) + 1 for x in (text or "").encode().lower().split()]
    grams = w + [(a * 0x100000001B3 & mask) ^ (b * mix & mask) for a, b in zip(w, w[1:])]
    return [(g * mix & mask) >> 64 - bits for g in grams]


def test_op7_ratios_and_choice(spark):
    docs = documents(spark, SF)
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.quality is not None:
            labels[r.doc_id].append(r.quality)
    good = {i for i, q in labels.items() if max(q) > 0}
    raw, target = Counter(), Counter()
    for i, r in docs.items():
        own = bucket_of(r.text, 16)
        raw.update(own)
        if i in good:
            target.update(own)
    n, m = raw.total() + (1 << 16), target.total() + (1 << 16)
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    noise = []
    for i, r in got.items():
        want = sum(math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in bucket_of(docs[i].text, 16))
        assert math.isclose(r.log_ratio, want, rel_tol=1e-9, abs_tol=1e-6)
        noise.append(r.key - r.log_ratio)
    assert abs(np.mean(noise) - 0.5772) < 0.4 and len(set(noise)) == len(noise)
    k = round(len(good) / len(labels) * len(docs))
    assert {i for i, r in got.items() if r.selected} == set(sorted(got, key=lambda i: (-got[i].key, i))[:k])


def test_resample_cases(spark):
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "bad"), (5, "x " * 3000)]
    df = spark.createDataFrame([(i, t, "z", 1.0) for i, t in rows], "doc_id long, text string, key string, log_ratio double")
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = quality.resample(df, labels, share=0.5).collect()
    assert len(got) == 6 and {r.doc_id: r.log_ratio for r in got if r.doc_id in (1, 2)} == {1: 0.0, 2: 0.0}
    assert len({r.selected for r in got if r.doc_id == 3}) == 1
    none = quality.resample(df, labels.where("false"), share=1.0).collect()
    assert all(r.log_ratio == 0 and r.selected for r in none)
    assert quality.resample(df.where("false"), labels).count() == 0


def test_ties_of_large_ids(spark):
    """Ids that differ above 2**53 only by one are told apart."""
    base = 1 << 60
    df = spark.createDataFrame([(base + i, 1.5) for i in range(400)] + [(None, 1.5)], "doc_id long, key double")
    for k in (2, 7, 250, 401):
        assert quality.kth_largest(df, k, ranges=8, few=50) == (1.5, base + k - 2)
    assert quality.kth_largest(df, 1, ranges=8, few=50) == (1.5, None)


@pytest.mark.parametrize("name", ["op2_substring", "op9_suffixes"])
def test_counts_are_those_of_the_texts(spark, name):
    docs = documents(spark, SF)
    for r in QUERIES[name](spark, SF).collect():
        data = (docs[r.doc_id].text or "").encode()
        n = len(data.split()) if name == "op2_substring" else len(data)
        assert (r.n_words if name == "op2_substring" else r.n_bytes) == n and 0 <= r.n_removed <= n
