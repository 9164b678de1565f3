import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inspectra.llm.jaccard import boundary, op12_jaccard, similar
from inspectra.llm import near
from inspectra.llm.common import packed
from inspectra.llm.components import components
from inspectra.llm.near import COMMON, _counted, near_components, nodes_of, parity, rows_of, walked

pipeline = pytest.importorskip("corpus_pipeline")


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def roots(texts):
    sets = [plain(t) for t in texts]
    low = list(range(len(texts)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                low[y] = x
    return [find(i) for i in range(len(texts))]


def planted(seed=11):
    """Originals, copies with 1 to 30 words changed, chains of copies of copies, and a common passage before differing text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [word() for _ in range(60)]
    out = [None, "", " ", "One", "one", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(5, 260))]
        out.append(" ".join(base))
        for edits in (1, 2, 3, 6, 9, 30):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
            if edits == 3:
                base = t
        out.append(" ".join(shared + [word() for _ in range(rng.randint(0, 60))]))
    rng.shuffle(out)
    return out


def test_parity_never_exceeds_the_difference():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 300)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), n - n // 10)) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 5 + 1))}
        x, y = (parity(np.array(sorted(s), np.uint64)) for s in (a, b))
        if len(x) > len(y):
            x, y = y, x
        while len(y) > len(x):
            y = y.reshape(2, -1)[0] ^ y.reshape(2, -1)[1]
        assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)


def batches(rows, names, size):
    return (pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size))


def test_counts_over_batches():
    rng = random.Random(4)
    rows = sorted([(rng.randrange(30), i, 0) for i in range(120)] + [(7, 0, -2), (50, 1, 0), (60, 0, -2)], key=lambda r: (r[0], r[2], r[1])) + [(5, 900, -1), (901, 901, 44)]
    n = Counter(t for t, _, k in rows if k == 0)
    repeated = [r for r in rows for _ in range(1 + rng.randrange(3))]
    want = Counter((i, t, COMMON if t == 7 or n[t] > 5 else n[t]) for t, i, k in rows if k == 0 and (n[t] > 1 or t == 7)) + Counter([(900, 5, COMMON), (901, None, 44)])
    for size in (1, 2, 7, 200):
        for given in (rows, repeated):
            assert Counter(tuple(r.values()) for b in _counted(batches(given, ("token", "node", "n"), size), 5) for r in b.to_pylist()) == want


@pytest.mark.parametrize("limits", [{}, {"often": 5, "many": 12}, {"often": 3, "many": 4}])
def test_components_match_all_pairs(spark, limits):
    """With small limits most buckets are hot: taken in pieces, then split by the next shingles."""
    texts = planted()
    df = spark.createDataFrame([(i * 3 + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_components(df, **limits).collect()}
    assert [got[i * 3 + 1] for i in range(len(texts))] == [3 * r + 1 for r in roots(texts)]


def test_stage_drops_near_copies(spark):
    texts = planted(12)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in pipeline.near(spark, df, "").collect()}
    assert kept == {i for i, r in enumerate(roots(texts)) if i == r}


def test_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join(["changed", *base[1:]])
    rows = [(None, " ".join(base)), (7, near), (7, "quite another text of some words"), (9, " ".join(base[:-1]))]
    got = sorted(((r.doc_id or 0), r.component_id) for r in near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 7), (7, 7), (7, 7), (9, 7)]


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_group_with_failing_proposals(spark):
    """Copies of one text with a fifth of the words changed: some pairs are alike, most are not."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(80):
        t = list(base)
        for _ in range(rng.randint(1, 5)):
            t[rng.randrange(200)] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(t))
    got = {r.doc_id: r.component_id for r in near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == roots(texts)


@pytest.mark.parametrize("light", [None, 0, 30, 10_000])
@pytest.mark.parametrize("many", [2000, 5])
def test_jaccard_join_matches_all_pairs(spark, light, many):
    """At every boundary: all light, all heavy, and sets of both kinds that are alike."""
    texts = planted(21) + ["x y z " * 4000]
    rng = random.Random(2)
    base = [f"v{i}" for i in range(45)]
    texts += [" ".join(base[: rng.randint(28, 45)]) for _ in range(25)] + texts[30:40]
    df = spark.createDataFrame([(i * 3 + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string").repartition(3)
    want = roots(texts)
    words = [bool((t or "").split()) for t in texts]
    got = {r.doc_id: (r.n, r.component_id) for r in similar(df, light=light, many=many).collect()}
    assert [got[i * 3 + 1] for i in range(len(texts))] == [(len(plain(t)) if w else 0, 3 * (r if w else i) + 1) for i, (t, w, r) in enumerate(zip(texts, words, want))]


def test_boundary_is_the_cheapest(spark):
    rows = [(1, 10, 8, list(range(10)), 50), (2, 40, 32, list(range(40)), 90), (3, 400, 320, list(range(400)), 900)]
    nodes = spark.createDataFrame(rows, "node long, size int, need int, shared array<long>, scan long")
    width = [10 - 8 + 2, 40 - 32 + 2, 400 - 320 + 2]
    cost = {b: sum(w * (w - 1) / 2 for (_, n, *_), w in zip(rows, width) if n <= b) + sum(r[4] for r in rows if 5 * r[1] >= 4 * (b + 1)) for b in (0, 10, 40, 400)}
    assert boundary(nodes) == min(cost, key=cost.get)


def test_jaccard_cases(spark):
    schema = "doc_id long, text string, node long, key string"
    rows = [(None, "a b c d e f g h i j", 1, "k"), (4, "A b c d e f g h i j", 1, "k"), (4, "", 1, "k"), (5, None, 1, "k"), (6, "one two", 1, "k"), (7, "ONE\ttwo", 1, "k")]
    got = sorted((str(r.doc_id), r.n, r.component_id) for r in similar(spark.createDataFrame(rows, schema)).collect())
    assert got == [("4", 0, 4), ("4", 6, 4), ("5", 0, 5), ("6", 1, 6), ("7", 1, 6), ("None", 6, 4)]
    assert similar(spark.createDataFrame([], schema)).count() == 0


def test_op12_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = roots([t for _, t in docs])
    least = {}
    for (i, _), r in zip(docs, want):
        least[r] = min(i, least.get(r, i))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op12_jaccard(spark, sf).collect()}
    assert got == {i: (len(plain(t)) if (t or "").split() else 0, least[r] if (t or "").split() else i) for (i, t), r in zip(docs, want)}


def test_trie_join_proposes_first(spark, monkeypatch):
    """The stage walks the trie join of operator 1; its pairs are verified, so the components are those of all pairs, with or without it."""
    texts = planted(31) + ["p q r s t " * 30 + f"u{i}" for i in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, whole = rows_of(df, "doc_id", "text", 5, True)
    nodes = nodes_of(rows, whole, 5, True, 256, 2000)
    fp = {r.node: r.fp & (1 << 64) - 1 for r in nodes.select("node", "fp").collect()}
    found = [(r.a, r.b) for r in walked(nodes).collect()]
    assert found and all(a < b and (fp[a] ^ fp[b]).bit_count() <= 2 for a, b in found)
    root = {n: n for n in fp}
    root |= {r.node: r.root for r in components(walked(nodes)).collect()}
    assert all(root[a] == root[b] for a in fp for b in fp if (fp[a] ^ fp[b]).bit_count() <= 2)
    taken = []
    monkeypatch.setattr(near, "walked", lambda n: taken.append(walked(n)) or taken[0])
    got = {r.doc_id: r.component_id for r in near_components(df).collect()}
    assert len(taken) == 1 and [got[i] for i in range(len(texts))] == roots(texts)


@pytest.mark.parametrize("pack", [3, 1 << 16])
def test_components_of_few_links_shuffle_nothing(spark, pack):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 4), (7, 6)]
    low = {n: n for p in pairs for n in p if n is not None}
    for _ in low:
        for a, b in pairs:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), pack=pack).collect()}
    assert got == {n: r for n, r in low.items() if any(n in p and p[0] != p[1] and None not in p for p in pairs)}


def test_small_tables_are_packed(spark):
    df = spark.range(10).repartition(8)
    assert packed(df).rdd.getNumPartitions() == 1 and packed(df, 10, 3).rdd.getNumPartitions() == 4 and packed(df.limit(0)).count() == 0
    plan = packed(df, 10).groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition alone


def test_keys_of_one_component_are_not_dealt(spark):
    """Nodes 0 to 4 are one component: they meet under key 2 alone, where node 9 stands too, and no list of theirs alone counts as to be scanned."""
    rows = [(i, 10, 8, 0, list(range(10)), 0) for i in range(5)] + [(9, 10, 8, 0, list(range(2, 12)), 9)]
    nodes = spark.createDataFrame(rows, "node long, size int, need int, lone int, shared array<long>, label long")
    assert sorted((r.key, r.node) for r in near._met(near.list_keys(nodes), 2000).collect()) == [(2, n) for n in (0, 1, 2, 3, 4, 9)]
    assert [round(r.scan, 6) for r in near.entries(nodes, 2000).collect()] == [round(1 + (6 - 26 / 6) / near.SCANNED, 6)] * 6
