"""Near-duplicate documents by the Jaccard similarity of five-word shingles, 0.8 at least: operator 1 where a similarity is asked for, and what operator 12 shares with it.

SimHash alone cannot give these pairs: of the links of 0.8 and more some 9 % lie within 2 differing bits of 64 and 80 %
within 8. So the pairs are found exactly, and the Hamming budget is one that never fails: a parity fingerprint
sets a bit for each shingle's hash, two shingles on one bit cancelling out, so two sets differ in at least as many shingles as their
fingerprints in bits, and sets of a similarity of 0.8 in at most a ninth of both sizes.

1. Documents of equal shingle sets are one node, named by the set's digest.
2. Of a third of all shingles (those of small hashes) it is counted which stand in several nodes. A node that is like another has
   nearly all of its own among these: at most n - ceil(0.8 n) can be missing. Only such nodes go on.
3. Their shingles are all counted and put in one order, rare ones first. A shingle that is frequent in a task, or in
   more than MANY nodes, is a common one: its rows are dealt by node, and all common ones come last, in the order of their hashes. Any one order finds the same pairs.
   Two alike sets share, for every c, their first c common shingles among the first n - ceil(0.8 n) + c of each.
4. In the pipeline the trie join of operator 1 comes first (`walked`): nodes whose SimHash fingerprints, over the same shingles, differ in two bits at most are verified on the whole sets, and what is alike is one component from the start.
   Nodes meet under keys of c shingles (here c is 1; operator 12 takes 2 for small sets). Keys of the same nodes are one, and keys whose nodes are in one component already are not dealt at all.
   In a bucket a pair within the budget is a proposal, of which a forest is taken first and verified on the whole sets: at first in a sixteenth of the inverted lists, which joins dense groups, then under all keys
   that are still open. Of buckets that are open then, all proposals between components are taken and verified.
5. A bucket of more than MANY nodes (hot) meets in pieces at first, which joins dense groups. Where it is still open, and up to MANY nodes stand outside of its
   largest component, these meet all pieces. Else the bucket is split by the next shingle (and by bands of size): what two alike sets share beyond the key begins there. Sets that share
   no more than the key are linked to the smallest set of the bucket, if that is enough. This goes on until no bucket is hot, so no piece limit loses a link.

Defined cases: null, empty or blank texts have one shingle, the empty one, and are alike (`blanks`; operator 12 leaves them unlinked); fewer words than a shingle make one shingle
of what is there; repeated rows are alike; a null doc_id gets a component, but never names one (component_id is null where
all ids are). Words, shingles, sets, and rows where doc_id repeats or is null, are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed
from .components import components
from .passages import OFTEN
from .simhash import links, majority
from .winnow import gram_hashes

SHINGLE = 5
#: The least similarity as a fraction, so that it is compared in whole numbers.
OVER, UNDER = 4, 5
#: Ids that are broadcast to fetch the texts of candidates; more are joined by a shuffle.
IDS = 1_000_000
#: Bits of a fingerprint; of sets with more than half as many shingles it says less, never anything wrong.
BITS = 1 << 14
#: Shingles with hashes below are looked at first.
BELOW = (1 << 64) // 3
#: The count of common shingles, which come last in the order.
COMMON = 1 << 30
#: Partners that a node gets in the second look; the third look has all.
WIDE = 64
#: Nodes of a bucket that one task compares; of so many one by one.
MANY, FEW = 2000, 12
#: One of so many keys is looked at first.
FIRST = 16
#: Partners of a list entry that are compared at the cost of dealing one more row (measured: 0.13 to 0.69 microseconds a pair, some 40 a dealt row).
SCANNED = 100
#: Nodes of a partition, with their shingles and fingerprints.
HELD = 1 << 11
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: bytes | None, width: int = SHINGLE, blanks: bool = True) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 bytes; only A-Z are folded, only ASCII blanks split."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(int(blanks), np.uint64)
    return np.unique(gram_hashes(np.fromiter(map(_hash, words), np.uint64, len(words)), min(width, len(words))))


def digest(found: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return _hash(found.tobytes()) - (1 << 63)


def parity(found: np.ndarray) -> np.ndarray:
    """The parity fingerprint of a set, in 64-bit words: a power of two of bits, two to four for each shingle, BITS at most. A larger one folds to a smaller one."""
    bits = min(BITS, max(64, 1 << (2 * len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def proposals(node: np.ndarray, size: np.ndarray, lone: np.ndarray, label: np.ndarray, prints: list[np.ndarray], wide: int = 0) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of nodes with differing labels within the budget: a forest of them, or all, up to `wide` for a node; and whether a node has more. prints are of the shared shingles; `lone` counts the others."""
    root = np.unique(label, return_inverse=True)[1].copy()
    out: list[tuple[int, int]] = []
    cut_off = False
    by_words: dict[int, np.ndarray] = {}
    words = np.array([len(p) for p in prints])
    for w in np.unique(words):
        by_words[int(w)] = np.flatnonzero(words == w)
    for w, own in by_words.items():
        low = np.stack([prints[i] for i in own])
        more = by_words.get(2 * w, np.zeros(0, np.int64))
        twice = np.stack([prints[i] for i in more]).reshape(-1, 2, w) if len(more) else np.zeros((0, 2, w), np.uint64)
        other, rows = np.r_[own, more], np.concatenate([low, twice[:, 0] ^ twice[:, 1]])
        for k, i in enumerate(own):
            rest = np.arange(k + 1, len(other))
            rest = rest[root[other[rest]] != root[i]]
            n, m = size[i], size[other[rest]]
            rest = rest[UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)]
            if not len(rest):
                continue
            apart = np.bitwise_count(rows[rest] ^ low[k]).sum(1, dtype=np.int64) + lone[i] + lone[other[rest]]
            rest = rest[(OVER + UNDER) * apart <= (UNDER - OVER) * (size[i] + size[other[rest]])]
            given = 0
            for j in other[rest]:
                if root[i] != root[j]:
                    out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                    given += 1
                    if not wide:
                        root[root == root[j]] = root[i]
                    elif given == wide:
                        cut_off = True
                        break
    return out, cut_off


def few_proposals(bucket: list[tuple], wide: int = 0) -> list[tuple[int, int]]:
    """The same for a few rows (node, size, lone, label, bits): all, or a forest."""
    out = []
    label = [r[3] for r in bucket]
    prints = [int.from_bytes(r[4], "little") for r in bucket]
    for i, (a, n, x, _, p) in enumerate(bucket):
        for j in range(i):
            b, m, y, _, q = bucket[j]
            if label[i] == label[j] or UNDER * min(n, m) < OVER * max(n, m) or (OVER + UNDER) * (x + y) > (UNDER - OVER) * (n + m):
                continue
            wi, wj = 8 * len(p), 8 * len(q)
            u, v = prints[i], prints[j]
            if wi > 2 * wj or wj > 2 * wi:
                continue
            if wi > wj:
                u = u >> wj ^ u & (1 << wj) - 1
            elif wj > wi:
                v = v >> wi ^ v & (1 << wi) - 1
            if (OVER + UNDER) * ((u ^ v).bit_count() + x + y) <= (UNDER - OVER) * (n + m):
                out.append((min(a, b), max(a, b)))
                if not wide:
                    old, new = label[j], label[i]
                    label = [new if k == old else k for k in label]
    return out


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, bool]:
    """doc_id where it names one row, else a digest of id and text; and which."""
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    single = ids.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or i is null").isEmpty()
    return (F.col(id_col).cast("long") if single else F.xxhash64(F.col(id_col), F.col(text_col))), single


def _tokens(source: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]], often: int) -> DataFrame:
    """(token, node, n) of the sets that read gives from a batch (name, head, shingles): a row for each shingle, n 0, or -1 if it is a common one; a row with n -2 tells a common shingle's task; and one row for each
    node, n its head. A set that a task meets again gives nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            sets = {}
            for name, head, found in read(b):
                if head and name not in met:
                    met.add(name)
                    sets[name] = head, found
            if not sets:
                continue
            heads, own = zip(*sets.values())
            node, head, n = np.array(list(sets), np.int64), np.array(heads, np.int32), np.array([len(s) for s in own], np.int64)
            token = np.concatenate(own)
            each, at, times = np.unique(token, return_inverse=True, return_counts=True)
            marks = each[times >= often]
            columns = [
                np.concatenate([token.view(np.int64), marks.view(np.int64), node]),
                np.concatenate([np.repeat(node, n), np.zeros(len(marks), np.int64), node]),
                np.concatenate([-(times >= often)[at].astype(np.int32), np.full(len(marks), -2, np.int32), head]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "node", "n"])

    return source.mapInArrow(run, "token long, node long, n int")


def _whole(width: int, blanks: bool, b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """The sets of texts (t); head: the set's size."""
    for t in b.column(0):
        found = shingles(t.as_py(), width, blanks)
        yield digest(found), len(found), found


def _below(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """The sets that rows (node, n, third) hold in part; head: one more than the number of these that must stand elsewhere too if anything is like the set."""
    for name, size, third in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
        found = third.values.to_numpy().view(np.uint64)
        yield name, max(len(found) - (size + OVER * size // -UNDER), 0) + 1, found


def _counted(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
    """(node, token, n) of rows sorted by token, n and node: sizes (token null), and shingles of several nodes with the number of these. Repeated rows count once; `many` rows are held."""

    def pack(node: np.ndarray, token: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()) if token is None else pa.array(token), pa.array(n.astype(np.int32))], names=["node", "token", "n"])

    held, given = np.zeros((3, 0), np.int64), None  # the open group, or its token if its rows are given out as common ones
    last = None
    for b in batches:
        rows = np.array([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
        if not rows.shape[1]:
            continue
        again = np.r_[last is not None and bool((rows[:, 0] == last).all()), (rows[:, 1:] == rows[:, :-1]).all(0)]
        last, rows = rows[:, -1], rows[:, ~again]
        sizes, known = rows[2] > 0, rows[2] == -1
        if sizes.any():
            yield pack(rows[1, sizes], None, rows[2, sizes])
        if known.any():
            yield pack(rows[1, known], rows[0, known], np.full(known.sum(), COMMON))
        rows = np.concatenate([held, rows[:, ~sizes & ~known]], axis=1)
        if not rows.shape[1]:
            continue
        edge = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        size = np.diff(np.r_[edge, rows.shape[1]])
        common = (rows[2, edge] == -2) | (size > many)
        if given is not None and rows[0, 0] == given:
            common[0] = True
        given, tail = (rows[0, -1], rows.shape[1]) if common[-1] else (None, edge[-1])
        held = rows[:, tail:]
        keep = np.repeat(common | (size > 1), size) & (rows[2] == 0)
        keep[tail:] = False
        if keep.any():
            yield pack(rows[1, keep], rows[0, keep], np.repeat(np.where(common, COMMON, size), size)[keep])
    if held.shape[1] > 1:
        yield pack(held[1], held[0], np.full(held.shape[1], held.shape[1]))


def _shared(source: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]], often: int, many: int) -> DataFrame:
    """(node, token, n) of _counted over all sets."""
    rows = _tokens(source, read, often)
    rows = rows.repartition(F.when(F.col("n") == -1, F.col("node")).otherwise(F.col("token"))).sortWithinPartitions("token", "n", "node")
    return rows.mapInArrow(lambda batches: _counted(batches, many), "node long, token long, n int")


def _among(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    return rows.join(F.broadcast(keys) if keys.count() <= IDS else keys, by, "left_semi")


def rows_of(docs: DataFrame, id_col: str, text_col: str, width: int, blanks: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, own, row, node, n, third) of every row: own the text's digest, node and n name and size of its shingle set (null and 0 without), third its shingles below BELOW; and (row, t), the texts. Words are hashed once
    for both: the first look at all sets takes the stored thirds."""
    row, _ = _row_key(docs, id_col, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("own"), row.alias("row"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), width, blanks) for t in b.column(3)]
            node = pa.array([digest(s) if len(s) else None for s in found], pa.int64())
            third = [s[: np.searchsorted(s, np.uint64(BELOW))] for s in found]
            offsets = np.cumsum([0, *(len(s) for s in third)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*third, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], node, pa.array([len(s) for s in found], pa.int64()), lists], names=["doc_id", "own", "row", "node", "n", "third"])

    return cut(texts.mapInArrow(run, "doc_id long, own long, row long, node long, n long, third array<long>")), texts.select("row", "t")


def nodes_of(rows: DataFrame, texts: DataFrame, width: int, blanks: bool, often: int, many: int) -> DataFrame:
    """(node, size, need, lone, shared, bits, fp) of the sets that may have one alike.

    need: shingles that any set alike shares; shared: the shingles that stand in several nodes, rare ones first; lone: the number of others; bits: the fingerprint of shared; fp: its SimHash fingerprint.
    """
    need = F.max(F.when(F.col("token").isNull(), F.col("n")))
    third = _shared(rows.where("n > 0").select("node", "n", "third"), _below, often, many).groupBy("node").agg(need.alias("need"), F.count("token").alias("found"))
    hopeful = cut(third.where("found + 1 >= need").select("node"))
    one = _among(rows.select("node", "row"), hopeful, "node").groupBy("node").agg(F.min("row").alias("row")).select("row")
    mine = F.when(F.col("token").isNotNull(), F.struct("n", "token"))
    per = _shared(_among(texts, cut(one), "row").select("t"), partial(_whole, width, blanks), often, many).groupBy("node").agg(F.max(F.when(F.col("token").isNull(), F.col("n"))).alias("size"), F.sort_array(F.collect_list(mine)).alias("s"))
    per = per.withColumn("need", F.expr(f"int(({OVER} * size + {UNDER - 1}) div {UNDER})")).where("size(s) >= need")
    per = per.select("node", "size", "need", (F.col("size") - F.size("s")).alias("lone"), F.col("s.token").alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [parity(x.values.to_numpy().view(np.uint64)).tobytes() for x in b.column(4)]
            fp = np.array([majority([x.values.to_numpy().view(np.uint64)]) for x in b.column(4)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits, pa.binary()), pa.array(fp)], names=[*b.schema.names, "bits", "fp"])

    return packed(cut(per.mapInArrow(run, "node long, size int, need int, lone int, shared array<long>, bits binary, fp long")), rows=HELD)


def walked(nodes: DataFrame) -> DataFrame:
    """(a, b): a forest of the nodes whose SimHash fingerprints differ in two bits at most, by the trie join of operator 1. Proposals only: they join most of a dense group at once, and the keys find what it misses."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    equal = nodes.select("fp", F.col("node").alias("b")).join(first.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")
    return packed(cut(equal.union(links(first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()))


def marked(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, size, need, lone, shared, label): the nodes, with their component so far."""
    return nodes.select("node", "size", "need", "lone", "shared").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def entries(nodes: DataFrame, many: int) -> DataFrame:
    """(size, scan): the list entries of marked nodes that are still to be scanned, those of lists with several components, each with its cost in dealt rows: its own one, and the entries of other components that it
    meets on average, as far as a bucket goes."""
    lists = list_keys(nodes).select("key", "size", "label")
    per = lists.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
    still = per.where("k > 1").select("key", (1 + F.least(F.col("n") - F.col("own") / F.col("n"), F.lit(many)) / SCANNED).alias("scan"))
    return lists.join(still, "key").select("size", "scan")


def list_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, label, at, depth, apart, size, passed): the inverted lists in which sets of `marked` meet; at: the place of the key's last shingle; apart: shingles before it, and lone ones, that are not in the key."""
    lists = nodes.select("node", "label", "size", "lone", F.posexplode(F.slice("shared", F.lit(1), F.size("shared") - F.col("need") + 1)).alias("at", "key"))
    return lists.select("key", "node", "label", (F.col("at") + 1).alias("at"), F.lit(1).alias("depth"), (F.col("at") + F.col("lone")).alias("apart"), "size", F.lit(None).cast("long").alias("passed"))


def _met(keys: DataFrame, many: int) -> DataFrame:
    """(key, node, at, depth, apart, size, n): the keys of several components, with the number n of nodes; of keys with the same nodes, `many` at most, one.

    Nodes of one component need not meet any more, so a key that has no others is not dealt: what is dealt follows the links that are still open, not the entries of dense groups. Alike sets need only meet under their first common shingles. What a node has before the key's last shingle and not in the key, no such partner has: nodes with too much of that, given the
    least of the bucket, go. Where all nodes passed over one shingle that they share, they meet under that one.
    """
    passed = F.coalesce((F.count("passed") == F.count(F.lit(1))) & (F.min("passed") == F.max("passed")), F.lit(False))
    ends = [F.min("label").alias("low"), F.max("label").alias("high")]
    each = keys.groupBy("key").agg(F.min("apart").alias("least"), passed.alias("late"), *ends).where("low < high and not late").select("key", "least")
    # (OVER + UNDER) * (apart + least) <= (UNDER - OVER) * (size + size / 0.8) for any partner of the key.
    close = packed(cut(keys.drop("passed").join(each, "key").where(4 * (F.col("apart") + F.col("least")) <= F.col("size")).drop("least")))
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(f"x{salt}") for salt in (1, 2)]
    groups = close.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *marks, *ends).where("low < high")
    same = F.when(F.col("n") > many, F.col("key"))
    kept = groups.groupBy("n", "x1", "x2", same).agg(F.min("key").alias("key")).select("key", "n")
    return packed(cut(close.drop("label").join(kept, "key")))


def _looked(hits: DataFrame, nodes: DataFrame, labels: DataFrame, wide: int) -> DataFrame:
    """(key, a, b): proposals of the buckets of hits (key, piece, node), piece by piece; (key, null, null) for a bucket of which not all were given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple] = []
        out: list[tuple] = []
        now = None

        def close() -> None:
            if len(bucket) <= FEW:
                out.extend((now and now[0], *pair) for pair in few_proposals(bucket, wide))
            else:
                node, size, lone, label = (np.array([r[i] for r in bucket], np.int64) for i in range(4))
                found, cut_off = proposals(node, size, lone, label, [np.frombuffer(r[4], np.uint64) for r in bucket], wide)
                out.extend((now[0], *pair) for pair in found)
                if cut_off:
                    out.append((now[0], None, None))

        def given() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(3)], names=["key", "a", "b"])
            out.clear()
            return found

        for b in batches:
            for key, piece, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (key, piece) != now:
                    close()
                    bucket, now = [], (key, piece)
                    if len(out) > 10_000:
                        yield given()
                bucket.append(tuple(row))
        close()
        yield given()

    rows = hits.select("key", "piece", "node").join(nodes.select("node", "size", "lone", "bits"), "node").join(labels, "node", "left")
    dealt = rows.select("key", "piece", "node", "size", "lone", F.coalesce("root", "node").alias("label"), "bits").repartition("key", "piece").sortWithinPartitions("key", "piece")
    return packed(cut(dealt.mapInArrow(run, "key long, a long, b long")))


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, alike) of pairs, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = (len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) for x, y in zip(b.column(3), b.column(4)))
            alike = [(OVER + UNDER) * n >= OVER * total for n, total in zip(both, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike, pa.bool_())], names=["a", "b", "alike"])

    few = F.broadcast(pairs) if pairs.count() <= IDS else pairs
    left = few.join(nodes.select(F.col("node").alias("a"), F.col("shared").alias("x"), F.col("size").alias("m")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("shared").alias("y"), F.col("size").alias("k")), "b")
    return packed(cut(both.select("a", "b", (F.col("m") + F.col("k")).alias("total"), "x", "y").mapInArrow(run, "a long, b long, alike boolean")))


def _direct(hot: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, alike): links of hot buckets that the key's shingles alone prove, to the bucket's smallest set."""
    sized = hot
    least = sized.groupBy("key").agg(F.min(F.struct("size", "node")).alias("least"))
    enough = F.expr(f"{OVER + UNDER} * depth >= {OVER} * (size + least.size) and node <> least.node")
    return packed(cut(sized.join(least, "key").where(enough).select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b"), F.lit(True).alias("alike"))))


def _split(hot: DataFrame, nodes: DataFrame, banded: bool) -> DataFrame:
    """Keys of one shingle more, of marked nodes: all that may follow in a node's order. The first time also by size: sets of a similarity of 0.8 lie in one band or in neighbours."""
    until = F.expr("size(shared) - need + depth + 1")
    rows = hot.drop("size").join(nodes.select("node", "label", "size", "need", "lone", "shared"), "node")
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(1.26)))
    rows = rows.withColumn("band", F.explode(F.array(band, band + 1))) if banded else rows.withColumn("band", F.lit(0))
    rest = F.slice("shared", F.col("at") + 1, F.greatest(until - F.col("at"), F.lit(0)))
    rows = rows.select("key", "node", "label", "at", "depth", "apart", "size", "band", rest.alias("rest"), F.posexplode(rest).alias("step", "token"))
    passed = F.when(F.col("step") > 0, F.get("rest", F.col("step") - 1))
    return rows.select(F.xxhash64("key", "band", "token").alias("key"), "node", "label", (F.col("at") + F.col("step") + 1).alias("at"), (F.col("depth") + 1).alias("depth"), (F.col("apart") + F.col("step")).alias("apart"), "size", passed.alias("passed"))


def _piece(number: Column) -> Column:
    return F.pmod(F.xxhash64("key", "node"), number).cast("int")


def _open(hits: DataFrame, roots: DataFrame) -> DataFrame:
    """The hits of buckets with more than one component."""
    tagged = hits.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    keys = tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return packed(cut(hits.join(keys, "key", "left_semi")))


def _outsiders(hot: DataFrame, roots: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """Of open hot buckets: those with at most `many` nodes outside of their largest component, in pieces that each hold all of these; and the hits of the others."""
    tagged = hot.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    each = tagged.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    per = packed(cut(each.groupBy("key").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("top"))))
    few = per.where(F.col("total") - F.col("top.c") <= many).select("key", F.col("top.label").alias("main"), F.ceil(F.col("top.c") / many).alias("k"))
    pieces = F.when(F.col("label") == F.col("main"), F.array(_piece(F.col("k")))).otherwise(F.sequence(F.lit(0), F.col("k").cast("int") - 1))
    dealt = tagged.join(few, "key").select("key", F.explode(pieces).alias("piece"), "node")
    return packed(cut(dealt)), packed(cut(hot.join(few, "key", "left_anti")))


def linked(nodes: DataFrame, many: int = MANY, keys_of: Callable[[DataFrame], DataFrame] = list_keys, first: DataFrame | None = None) -> DataFrame:
    """(node, root): components of the nodes that meet under keys and are alike. keys_of: the keys of marked nodes. first: pairs (a < b) that are verified before."""
    done = nodes.sparkSession.createDataFrame([], "a long, b long, alike boolean")
    roots = nodes.sparkSession.createDataFrame([], "node long, root long")
    banded = True

    def take(new: DataFrame) -> None:
        nonlocal done, roots
        if not new.isEmpty():
            done = packed(done.union(_verified(new, nodes)))
            roots = components(done.where("alike"))

    def look(hits: DataFrame, wide: int) -> tuple[DataFrame, DataFrame]:
        """Proposals of hits, verified. The keys with proposals that failed, and those of which not all were taken; all others need no other look."""
        found = _looked(hits, nodes, roots, wide)
        take(packed(cut(found.where("b is not null").select("a", "b").distinct().join(done, ["a", "b"], "left_anti"))))
        return found.join(done.where("not alike"), ["a", "b"], "left_semi").select("key").distinct(), found.where("b is null").select("key").distinct()

    def dealt(keys: DataFrame) -> DataFrame:
        return _met(keys, many).withColumn("piece", _piece(F.ceil(F.col("n") / many)))

    if first is not None:
        take(first)
    # Dense groups meet under many keys, of which a few join them.
    plain = marked(nodes, roots) if first is None else cut(marked(nodes, roots))
    few = dealt(list_keys(plain).where(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(FIRST)) == 0))
    if not few.isEmpty():
        look(few, 0)
    keys = keys_of(cut(marked(nodes, roots)))
    while True:
        hits = dealt(keys)
        if hits.isEmpty():
            return roots
        small = hits.where(F.col("n") <= many)
        if banded:
            failed, _ = look(hits, 0)
            small = small.join(failed, "key", "left_semi")
        small = _open(small, roots)
        if not small.isEmpty():
            _, more = look(small, WIDE)
            if not more.isEmpty():
                look(_open(small.join(more, "key", "left_semi"), roots), many)
        hot = _open(hits.where(F.col("n") > many).drop("piece"), roots)
        if hot.isEmpty():
            return roots
        few, hot = _outsiders(hot, roots, many)
        if not few.isEmpty():
            _, more = look(few, WIDE)
            if not more.isEmpty():
                look(few.join(more, "key", "left_semi"), many)
        if hot.isEmpty():
            return roots
        proved = _direct(hot, nodes)
        if not proved.isEmpty():
            done = packed(done.union(proved))
            roots = components(done.where("alike"))
        keys, banded = _split(hot, marked(nodes, roots), banded), False


def named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, own, n, component_id) of every row: component_id the smallest doc_id of its component, or doc_id where a row has no node."""
    root = rows.join(roots, "node", "left").select("doc_id", "own", "n", F.coalesce("root", "node").alias("root"))
    least = cut(root.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1"))
    component = F.when(F.col("k").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return root.join(least, "root", "left").select("doc_id", "own", "n", component.alias("component_id"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, often: int = OFTEN, many: int = MANY) -> DataFrame:
    """(doc_id, own, component_id) for every row: own is the text's digest; component_id the smallest doc_id reachable over pairs with a similarity of 0.8 at least."""
    rows, texts = rows_of(docs, id_col, text_col, width, True)
    nodes = nodes_of(rows, texts, width, True, often, many)
    return named(rows, linked(nodes, many, first=walked(nodes))).drop("n")
