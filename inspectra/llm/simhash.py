"""Near-duplicate documents by SimHash, linked through a binary-trie self-join.

A 64-bit fingerprint is cut into four 16-bit blocks. Two fingerprints that differ in at
most two bits agree exactly on at least two blocks, so each distinct fingerprint is dealt
to the six (block, block) keys; below a key's 32 agreed bits lies one sub-trie. A task
walks its sub-tries by *pairs* of nodes, one bit a level, adds up differing bits and drops a
pair as soon as the error budget is exceeded. Nodes are ranges of the sorted array, so no
trie objects exist. Links are folded into a forest inside the task: a task returns
at most one link per fingerprint and key, however dense a group is.

Defined cases: null, empty or blank texts have fingerprint zero and link like any other;
fewer words than a shingle make one shingle of what is there; repeated rows each get a row;
a null doc_id gets its fingerprint's component, but never names one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

BITS = 64
BLOCK = 16
PREFIX = 2 * BLOCK
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes of all parts."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 bytes; only A-Z are folded, only ASCII blanks split."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    return majority(np.fromiter(map(_hash, grams[at : at + (1 << 15)]), np.uint64) for at in range(0, len(grams), 1 << 15))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _dealt(nodes: DataFrame) -> DataFrame:
    """Each fingerprint under its six keys: v has the two agreed blocks first, then the other two."""
    block = [F.shiftrightunsigned("fp", BITS - BLOCK * (i + 1)).bitwiseAND(F.lit((1 << BLOCK) - 1)) for i in range(4)]

    def turned(pair: tuple[int, int]) -> F.Column:
        order = [*pair, *(i for i in range(4) if i not in pair)]
        v = F.lit(0).cast("long")
        for i in order:
            v = F.shiftleft(v, BLOCK).bitwiseOR(block[i])
        return v

    keyed = F.array(*(F.struct(F.lit(n).alias("turn"), turned(p).alias("v")) for n, p in enumerate(PAIRS)))
    return nodes.select("node", F.inline(keyed)).withColumn("prefix", F.shiftrightunsigned("v", BITS - PREFIX))


class _Forest:
    """Union-find over array positions, by repeated minimum."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def root(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.low[i]
            if (up == i).all():
                return i
            i = self.low[up]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            off = a != b
            a, b = a[off], b[off]
            np.minimum.at(self.low, np.maximum(a, b), np.minimum(a, b))


def trie_links(v: np.ndarray, budget: int = 2, prefix: int = PREFIX, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) positions of a forest over sorted distinct uint64 values that joins all pairs which agree on the first
    `prefix` bits and differ in at most `budget` of the rest. `most` bounds the node pairs held at once."""
    n = len(v)
    forest = _Forest(n)
    top = v >> np.uint64(BITS - prefix) if prefix else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if n else np.zeros(0, np.int64)
    hi = np.r_[lo[1:], n]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    todo = [(BITS - prefix, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while todo:
        left, al, ah, bl, bh, diff = todo.pop()
        if len(al) > most:
            half = len(al) // 2
            todo += [(left, *(x[part] for x in (al, ah, bl, bh, diff))) for part in (slice(half), slice(half, None))]
            continue
        same = al == bl
        # Two single leaves: count the remaining bits at once.
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            near = (np.bitwise_count(v[a] ^ v[b]) <= budget) & (a != b)
            forest.join(a[near], b[near])
        # All that is left fits the budget: the whole node pair is linked.
        full = ~single & (diff + left <= budget)
        for x, y in zip(al[full & same], ah[full & same]):
            forest.join(np.arange(x, y - 1), np.arange(x + 1, y))
        forest.join(al[full & ~same], bl[full & ~same])
        go = ~single & ~full
        if not go.any():
            continue
        al, ah, bl, bh, diff, same = (x[go] for x in (al, ah, bl, bh, diff, same))
        bit = np.uint64(left - 1)

        def middle(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            one = (v[start] >> bit | np.uint64(1)) << bit
            return np.clip(np.searchsorted(v, one), start, end)

        am, bm = middle(al, ah), middle(bl, bh)
        other = ~same
        pairs = [
            (al, am, bl, bm, diff),
            (am, ah, bm, bh, diff),
            (al, am, bm, bh, diff + 1),
            tuple(x[other] for x in (am, ah, bl, bm, diff + 1)),
        ]
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*pairs))
        live = (ah > al) & (bh > bl) & (diff <= budget) & ~((al == bl) & (ah - al == 1))
        todo.append((left - 1, *(x[live] for x in (al, ah, bl, bh, diff))))
    low = forest.root(np.arange(n))
    at = np.flatnonzero(low != np.arange(n))
    return at, low[at]


def links(nodes: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): a forest of links between the nodes (node long, fp long: distinct fp) within the budget of 2 bits at most."""
    if not 0 <= budget <= 2:
        raise ValueError("four blocks serve budgets of 0 to 2 bits")

    def walk(turn: np.ndarray, v: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t in np.unique(turn):
            own = turn == t
            i, j = trie_links(v[own], budget)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(node[own][i]), pa.array(node[own][j])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last, perhaps unfinished, group, batch by batch
        for b in batches:
            if not b.num_rows:
                continue
            turn, v, node = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            same = (turn == turn[-1]) & (v >> np.uint64(BITS - PREFIX) == v[-1] >> np.uint64(BITS - PREFIX))
            at = len(same) - int(same.sum())
            open_ = held and (held[0][0][0], held[0][1][0] >> np.uint64(BITS - PREFIX)) != (turn[-1], v[-1] >> np.uint64(BITS - PREFIX))
            if at or open_:
                yield from walk(*(np.concatenate(x) for x in zip(*held, (turn[:at], v[:at], node[:at]))))
                held = []
            held.append((turn[at:], v[at:], node[at:]))
        if held:
            yield from walk(*(np.concatenate(x) for x in zip(*held)))

    # Unsigned order: flip the sign bit for the sort.
    dealt = _dealt(nodes).repartition("turn", "prefix").sortWithinPartitions("turn", F.col("v").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.select("turn", "v", "node").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most `budget` bits."""
    own = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(links(nodes.where("node is not null"), budget)) if budget else None
    label = nodes
    if roots is not None:
        label = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return own.join(label, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
