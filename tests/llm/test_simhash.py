import random

import numpy as np
import xxhash

from inspectra.llm.simhash import simhash, simhash_components, trie_links


def plain(text):
    table = {c: c + 32 for c in range(65, 91)}
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if x]
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, budget=2):
    ids = list(range(len(fps)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                ids[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for t in [None, "", " \t\n", "One", "One two", "A b C", "É b c\x0bd e f g A", "a b c " * 500]:
        assert simhash(t.encode() if t is not None else None) == plain(t)


def test_trie_links_match_all_pairs():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(80):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    v = np.array(sorted(fps), np.uint64)
    i, j = trie_links(v, 2, prefix=0, most=64)
    ids = list(range(len(v)))
    for a, b in zip(i, j):
        ids[a] = int(b)
    assert ids == roots([int(x) for x in v])


def test_components_on_rows(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [None, "", " ", "solo", "solo", "x y"]
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(t))
        t[rng.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    rows = [(i * 3 + 1, t, "node", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash_components(df).collect()}
    fps = [plain(t) for t in texts]
    want = roots(fps)
    assert len(got) == len(rows)
    for i, f in enumerate(fps):
        fp, comp = got[i * 3 + 1]
        assert fp & (1 << 64) - 1 == f and comp == want[i] * 3 + 1


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
