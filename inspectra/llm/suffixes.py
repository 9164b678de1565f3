"""Repeated byte strings of a minimum length, on a Burrows-Wheeler transform.

For each byte block that winnowing and equal blocks leave undecided, the distinct candidate byte strings are
joined (each with an end mark of its own), sorted by suffix and transformed. Common prefixes of
neighbouring suffixes are then found by increasing value: intervals of suffixes with a common
prefix are extended backward by one byte, breadth first, and an interval's end that is first
reached at depth L has a common prefix of L. The search stops at the minimum length, so
what is still unset then is repeated. All of it in numpy, level by level. Strings of one key that
exceed `GROUP` bytes are not transformed together: their windows are dealt once more, each by its own digest.

Defined cases: null and short texts lose nothing; equal texts of at least the minimum length lose
everything, the first one too; rows that repeat a doc_id count as places of their own; a null
doc_id is kept whole and counts against nobody; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .passages import ALL, Place, Unit, copies, dealt_parts, distinct_texts, grouped, id_and_text, settled, without

WIDTH = 400
#: Neighbouring windows that are decided together if their bytes are alike.
BLOCK = 128
#: The same for anchors with very many places.
HOT_BLOCK = 16
#: Places of an anchor from which it is such a one: parts are large here.
MANY = 2_000
#: Bytes that are sorted at once, and of one key at most.
BATCH, GROUP = 1 << 17, 1 << 22

_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)


def byte_unit(width: int = WIDTH, k: int = 64, **hot: int) -> Unit:
    hot.setdefault("many", MANY)
    return Unit(split=lambda t: t, hashed=lambda t: _BYTE[np.frombuffer(t, np.uint8)], joined=b"".join, length=len, width=width, k=min(k, width), **hot)


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t (int64 symbols below 2**20) in the order of their first `depth` symbols at least, by doubling."""
    n = len(t)
    pad = np.concatenate([t, np.zeros(2, np.int64)])
    key = pad[:n] << 40 | pad[1 : n + 1] << 20 | pad[2:]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def number(sorted_keys: np.ndarray) -> int:
        step = np.r_[0, np.cumsum(sorted_keys[1:] != sorted_keys[:-1])]
        rank[order] = step + 1
        return int(step[-1]) + 1

    distinct, have = number(key[order]), 3
    while have < depth and distinct < n:
        key = rank * (n + 2)
        key[: n - have] += rank[have:]
        order = np.argsort(key, kind="stable")
        distinct = number(key[order])
        have *= 2
    return order


def long_prefixes(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, long): the suffixes in order, and whether each has `depth` symbols in common with the one before it."""
    n = len(t)
    order = suffix_array(t, depth)
    bwt = t[order - 1]
    back = np.empty(n, np.int64)  # where the suffix that begins one symbol earlier stands
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        size = high - low
        own = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(own)) + np.repeat(low - (np.cumsum(size) - size), size)
        # Extend each interval backward by each symbol in front of it.
        key, first, count = np.unique(own << 21 | bwt[at], return_index=True, return_counts=True)
        low = back[at[first]]
        high = low + count
        new = unset[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        unset[high] = False
    return order, unset[:n]


def repeated_starts(parts: list[bytes], depth: int) -> list[np.ndarray]:
    """For each byte string the positions at which `depth` bytes begin that begin elsewhere in the strings too."""
    if len(parts) + 257 > 1 << 20:
        raise ValueError("symbols have 20 bits")
    sizes = np.array([len(p) + 1 for p in parts])
    t = np.empty(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes) - 1
    body = np.ones(len(t), bool)
    body[ends] = False
    t[body] = np.frombuffer(b"".join(parts), np.uint8)
    t[body] += len(parts) + 1
    t[ends] = np.arange(1, len(parts) + 1)  # end marks, all different
    order, long = long_prefixes(t, depth)
    hit = np.zeros(len(t), bool)
    hit[order[long]] = True
    hit[order[np.flatnonzero(long) - 1]] = True
    return [np.flatnonzero(hit[e - s + 1 : e]) for s, e in zip(sizes, ends)]


def settle(places: list[Place]) -> tuple[list[Place], list[Place]]:
    """A block that stands in several places goes from all of them; one row without a document stands for them elsewhere."""
    return places, [(None, 0, 0, -1)]


def spans(at: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Ascending window starts as spans of items."""
    if len(at):
        gap = np.flatnonzero(np.diff(at) > 1)
        for a, b in zip(np.r_[at[0], at[gap + 1]], np.r_[at[gap], at[-1]]):
            yield int(a), int(b) + width


def compared(batches: Iterator[pa.RecordBatch], width: int, most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """(doc_id, own, a, b, digest) of PART rows: spans that go (digest null), and single windows of too large groups with their digest (doc_id null: it stands in several places)."""
    names = ["doc_id", "own", "a", "b", "digest"]
    done: list[list[pa.Array]] = []
    out: tuple[list, ...] = ([], [], [], [], [])
    held: list[tuple[bytes, Place | None]] = []
    size = 0

    def put(place: Place, a: int, b: int, digest: bytes | None = None) -> None:
        for column, x in zip(out, (place[0], place[1], place[2] + a, place[2] + b, digest)):
            column.append(x)

    def decide() -> None:
        for (_, place), at in zip(held, repeated_starts([p for p, _ in held], width)):
            if place is not None:
                for a, b in spans(at, width):
                    put(place, a, b)

    def read() -> Iterator[pa.RecordBatch]:
        for b in batches:
            done.append([*settled(b), None])
            yield b

    def pack() -> Iterator[pa.RecordBatch]:
        while done:
            columns = done.pop()[:4]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary())], names=names)
        kinds = (*[pa.int64()] * 4, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    for group, large in grouped(read(), most):
        single: list[tuple[bytes, Place | None]] = []
        for part, places in group:
            several = len(places) > 1 or places[0][0] is None
            if several:  # the whole block stands in several places
                for place in places:
                    if place[0] is not None:
                        put(place, 0, len(part))
            single.append((part, None if several else places[0]))
        if large:
            for part, place in single:
                for i in range(len(part) - width + 1):
                    put(place or (None, 0, 0, -1), i, i + width, xxhash.xxh3_128_digest(part[i : i + width]))
        elif len(single) > 1 and any(place is not None for _, place in single):
            held += single
            size += sum(len(part) for part, _ in single)
            if size > BATCH:
                decide()
                held, size = [], 0
        if len(out[0]) > 50_000:
            yield from pack()
            out = ([], [], [], [], [])
    if held:
        decide()
    yield from pack()


def repeated_bytes(texts: DataFrame, width: int = WIDTH, most: int = GROUP, **hot: int) -> DataFrame:
    """(doc_id, own, a, b): byte spans of texts (doc_id, text binary, own) whose strings of `width` bytes stand elsewhere too; they may overlap."""
    unit = byte_unit(width, **hot)
    block = min(BLOCK, max(1, width // 3))
    copied = copies(texts)
    dealt = dealt_parts(distinct_texts(texts, copied), unit, block, min(HOT_BLOCK, block), settle)
    found = cut(dealt.mapInArrow(lambda batches: compared(batches, width, most), "doc_id long, own long, a long, b long, digest binary"))
    again = found.where("digest is not null")
    found = found.where("digest is null").select("doc_id", "own", "a", "b")
    if not again.isEmpty():
        several = again.groupBy("digest").agg(F.sum(F.when(F.col("doc_id").isNull(), 2).otherwise(1)).alias("n")).where("n > 1").select("digest")
        found = found.union(again.where("doc_id is not null").join(several, "digest").select("doc_id", "own", "a", "b"))
    return found.union(copied.select("doc_id", "own", F.lit(0).cast("long"), F.lit(ALL).cast("long")))


def suffix_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, **limits: int) -> DataFrame:
    """(doc_id, n_items, n_removed, n_spans, kept_sha256, kept) for every row. limits: `most` bytes of a group, and `often` and `many`, from which an anchor is hot."""
    texts = id_and_text(docs, id_col, text_col)
    return without(texts, repeated_bytes(texts, width, **limits), byte_unit(width), keep_text)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", F.col("n_items").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


# Windows are taken from stretches of 2,000 bytes, so that none is cut out of a long text; the hexadecimal form has one letter for a half byte.
OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 4798) AS part FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 399, 0), 2000)) AS p FROM d)),
w AS (SELECT doc_id, p + i AS i, md5(substr(part, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, p, part, unnest(range(0, least(2000, len(part) // 2 - 399))) AS i FROM s)),
r AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS fresh FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM r) GROUP BY doc_id, island),
t AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM g GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(0, coalesce(n_spans, 0) + 1), lambda j: substr(h, 2 * coalesce(ends[j], 0) + 1, 2 * (coalesce(starts[j + 1], len(h) // 2) - coalesce(ends[j], 0)))), ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
