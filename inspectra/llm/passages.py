"""What substring and suffix-array dedup share: which passages can repeat, and taking passages out.

1. Each document gives its winnowed anchors; an anchor that stands in one place only (of equal
   texts only the smallest id gives anchors) cannot be part of a repeated window. Fixed-size rows.
2. Only windows with a repeated anchor are cut out of the texts, in parts: the windows of a run whose distances
   from the anchor lie in one block. What all of a block's windows share makes the key that parts are dealt by.
3. The found passages come back to their documents by id (and digest of the text, where ids repeat).

Hot groups. An anchor that a task meets often is known to repeat there: its rows are dealt by document, only a mark
goes to the anchor's task, which then knows as much. Such anchors, and those with more than `MANY` rows, are cut in small
blocks, whose keys hold nearly or all of a window, so that different surroundings part. Equal parts of a batch are settled
in the task that cuts them (`settle`), and one of them is dealt. So no anchor, line or passage meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .winnow import runs

ALL = 1 << 62
#: Items that are hashed at once: some 50 MB of arrays.
PIECE = 1 << 20
#: Rows of an anchor in one piece, and in all, from which it is hot.
OFTEN, MANY = 256, 20_000


_PACK = 10  # bits of a run's windows, and of its anchor's distance: widths below 1024


class Unit:
    """What a text consists of: `split` gives its items, `hashed` a uint64 for each of them, `joined` the bytes of a slice, `length` the items in such bytes."""

    def __init__(self, split: Callable, hashed: Callable, joined: Callable, length: Callable, width: int, k: int, often: int = OFTEN, many: int = MANY):
        if not 0 < width < 1 << _PACK:
            raise ValueError(f"windows of 1 to {(1 << _PACK) - 1} items")
        self.split, self.hashed, self.joined, self.length, self.width, self.k = split, hashed, joined, length, width, k
        self.often, self.many = often, many


def _pieces(unit: Unit, texts: list[bytes | None]) -> Iterator[tuple]:
    """Lists of texts as (number, begin, hashed items), PIECE items at most, long texts in overlapping parts that share no window."""
    held, size = [], 0
    for i, text in enumerate(texts):
        h = unit.hashed(unit.split(text)) if text else np.zeros(0, np.uint64)
        for begin in range(0, len(h) - unit.width + 1, PIECE):
            part = h[begin : begin + PIECE + unit.width - 1]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((i, begin, part))
            size += len(part)
    if held:
        yield held


def text_runs(unit: Unit, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, start, windows, anchor, hash) of the runs of the texts; positions within each text."""
    for held in _pieces(unit, texts):
        lengths = np.array([len(x[2]) for x in held])
        offsets = np.cumsum(lengths) - lengths
        number, begin = (np.array([x[i] for x in held]) for i in (0, 1))
        start, n, anchor, h, seg = runs(np.concatenate([x[2] for x in held]), offsets, lengths, unit.width, unit.k)
        shift = begin[seg] - offsets[seg]
        yield number[seg], start + shift, n, anchor + shift, h


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text binary, own: tells the texts of one doc_id apart; 0 where no doc_id repeats). A doc_id that is long already is taken as it is: an alias would keep two joins from reading one exchange."""
    plain = id_col == "doc_id" and docs.schema[id_col].dataType.simpleString() == "bigint"
    rows = docs.select(F.col(id_col) if plain else F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    single = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # Neither a literal, which the optimizer would take out of the joins' keys, nor nullable, as it would filter some of their inputs.
    return rows.withColumn("own", F.coalesce(F.col("doc_id").bitwiseAND(F.lit(0).cast("long")), F.lit(0).cast("long")) if single else F.xxhash64("text"))


def anchors(texts: DataFrame, unit: Unit) -> DataFrame:
    """(anchor, doc_id, own, run, known) of each run, run packed. Rows of an anchor that is frequent in its piece are known to repeat; a row with run -1 tells its anchor's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, mine = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for i, start, n, anchor, h in text_runs(unit, [t.as_py() for t in b.column(1)]):
                each, at, times = np.unique(h, return_inverse=True, return_counts=True)
                often = times >= unit.often
                marks = each[often]
                none = np.zeros(len(marks), np.int64)
                columns = [np.r_[h, marks].view(np.int64), np.r_[ids[i], none], np.r_[mine[i], none], np.r_[(start << _PACK | n) << _PACK | anchor - start, none - 1], np.r_[often[at], none > 0]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "doc_id", "own", "run", "known"])

    return texts.select("doc_id", "text", "own").mapInArrow(run, "anchor long, doc_id long, own long, run long, known boolean")


def repeated_anchors(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, own, run) of the known rows, and of rows sorted by anchor and run those whose anchor has several; run is doubled, odd for hot anchors. `most` rows are held."""
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["doc_id", "own", "run"])
    held, given = np.zeros((4, 0), np.int64), None  # the open group, or its anchor if its rows are given out as hot ones
    for b in batches:
        known = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
        rows = np.array([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        if known.any():
            yield pack([rows[1, known], rows[2, known], rows[3, known] * 2 + 1])
        rows = np.concatenate([held, rows[:, ~known]], axis=1)
        if not rows.shape[1]:
            continue
        edge = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        size = np.diff(np.r_[edge, rows.shape[1]])
        hot = (rows[3, edge] < 0) | (size > most)
        if given is not None and rows[0, 0] == given:
            hot[0] = True
        given, tail = (rows[0, -1], rows.shape[1]) if hot[-1] else (None, edge[-1])
        held = rows[:, tail:]
        keep = np.repeat(hot | (size > 1), size) & (rows[3] >= 0)
        keep[tail:] = False
        if keep.any():
            yield pack([rows[1, keep], rows[2, keep], rows[3, keep] * 2 + np.repeat(hot, size)[keep]])
    if held.shape[1] > 1:
        yield pack([held[1], held[2], held[3] * 2])


def copies(texts: DataFrame) -> DataFrame:
    """(doc_id, own, first): documents whose whole text others have too, and the smallest id of these."""
    own = texts.where("doc_id is not null and text is not null").select("doc_id", "own", F.unhex(F.sha2("text", 256)).alias("d"))
    # Cut, so that the join deals both sides anew and adaptive execution can split the rows of a large group.
    first = cut(own.groupBy("d").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return own.join(first, "d").select("doc_id", "own", "first")


def distinct_texts(texts: DataFrame, copied: DataFrame) -> DataFrame:
    """Texts with an id, of copies those of the smallest one. One exchange of the texts serves all later joins by id."""
    return texts.where("doc_id is not null").join(copied.where("doc_id <> first").select("doc_id", "own"), ["doc_id", "own"], "left_anti")


def candidates(texts: DataFrame, unit: Unit) -> DataFrame:
    """(doc_id, own, runs): the packed runs of each document whose anchor stands in more than one place."""
    dealt = anchors(texts, unit).repartition(F.when(F.col("known"), F.xxhash64("doc_id", "run")).otherwise(F.col("anchor")))
    found = dealt.sortWithinPartitions("anchor", "run").mapInArrow(lambda batches: repeated_anchors(batches, unit.many), "doc_id long, own long, run long")
    return found.groupBy("doc_id", "own").agg(F.collect_list("run").alias("runs"))


PART = "key long, part binary, doc_id long, own long, start long, until long"
Place = tuple[int | None, int, int, int]  # doc_id, own, start, and the anchor's distance, or of hot anchors the items of the place, negative


def dealt_parts(texts: DataFrame, unit: Unit, block: int, hot_block: int, settle: Callable[[list[Place]], tuple[list[Place], list[Place]]]) -> DataFrame:
    """PART rows of texts, dealt and sorted by key and part. settle gets the places of equal parts and returns those that go (rows without a part, until: their end)
    and those that are dealt (until: the anchor's distance, or of hot anchors the items of the place, negative)."""
    found = texts.join(candidates(texts, unit), ["doc_id", "own"]).select("doc_id", "own", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: dict[tuple[int, bytes], list[Place]] = {}
            weight = 0
            for doc, own, text, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                items = unit.split(text.as_py())
                for r in packed:
                    hot = r & 1
                    start, windows, at = unpacked(r >> 1)
                    for key, a, end in blocks(unit, items, start, windows, at, hot_block if hot else block):
                        part = unit.joined([items[a:end]])
                        weight += len(part)
                        parts.setdefault((key, part), []).append((doc, own, a, a - end if hot else start + at - a))
                if weight > PIECE << 3:
                    yield _rows(unit, parts, settle)
                    parts, weight = {}, 0
            yield _rows(unit, parts, settle)

    return found.mapInArrow(run, PART).repartition("key").sortWithinPartitions("key", "part")


def blocks(unit: Unit, items, start: int, windows: int, at: int, block: int) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of the parts of a run: windows whose distance from the anchor has one quotient by `block`; the items that all of these share make the key."""
    anchor = start + at
    for q in range((at - windows + 1) // block, at // block + 1):
        near, far = q * block, (q + 1) * block - 1
        core = unit.joined([items[anchor - near : anchor - far + unit.width]])
        a, b = max(start, anchor - far), min(start + windows - 1, anchor - near)
        key = xxhash.xxh3_64_intdigest(core, seed=q)
        yield key - (1 << 64) if key >> 63 else key, a, b + unit.width


def _rows(unit: Unit, parts: dict, settle: Callable) -> pa.RecordBatch:
    rows: tuple[list, ...] = ([], [], [], [], [], [])
    decided: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (key, part), places in parts.items():
        gone, dealt = settle(places) if len(places) > 1 else ((), places)
        n = unit.length(part) if gone else 0
        for doc, own, a, _ in gone:
            decided.setdefault((doc, own), []).append((a, a + n))
        for doc, own, a, at in dealt:
            for column, x in zip(rows, (key, part, doc, own, a, at)):
                column.append(x)
    for (doc, own), found in decided.items():
        for a, b in merged(found, ALL):
            for column, x in zip(rows, (doc, None, doc, own, a, b)):
                column.append(x)
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names=["key", "part", "doc_id", "own", "start", "until"])


def unpacked(run: int) -> tuple[int, int, int]:
    """(start, windows, distance of the anchor from start)"""
    low = (1 << _PACK) - 1
    return run >> 2 * _PACK, run >> _PACK & low, run & low


def merged(spans: list[tuple[int, int]], n: int) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return out


def without(texts: DataFrame, spans: DataFrame, unit: Unit, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_items, n_removed, n_spans, kept_sha256, kept) for every row of texts (kept null unless keep_text); spans: (doc_id, own, a, b) item positions, b exclusive or ALL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column(1), b.column(2)):
                items = unit.split(text.as_py() or b"")
                n = len(items)
                gone = merged([(x["a"], x["b"]) for x in spans.as_py() or []], n) if n >= unit.width else []
                at = [0, *(x for s in gone for x in s), n]
                kept = unit.joined([items[x:y] for x, y in zip(at[::2], at[1::2])])
                for column, x in zip(out, (n, sum(y - x for x, y in gone), len(gone), sha256(kept).hexdigest(), kept if keep_text else None)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, kinds))], names=["doc_id", "n_items", "n_removed", "n_spans", "kept_sha256", "kept"])

    by_doc = spans.groupBy("doc_id", "own").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    # Known ids as in the inner join that cut the candidates out: both then read one exchange of the texts.
    joined = texts.where("doc_id is not null").join(by_doc, ["doc_id", "own"], "left").select("doc_id", "text", "spans")
    nameless = texts.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(by_doc.schema["spans"].dataType).alias("spans"))
    return joined.union(nameless).mapInArrow(run, "doc_id long, n_items long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def grouped(batches: Iterator[pa.RecordBatch], most: int = 1 << 62) -> Iterator[tuple[list[tuple[bytes, list[Place]]], bool]]:
    """The groups of PART rows with a part, sorted by key and part: the distinct parts with their places, and whether it is a piece of a group of over `most` bytes."""
    now, group, size, large = None, [], 0, False
    for b in batches:
        b = b.filter(pc.is_valid(b.column(1)))
        for k, v, *place in zip(*(b.column(i).to_pylist() for i in range(6))):
            new = not group or group[-1][0] != v
            if k != now or (new and size > most):
                if group:
                    large = large or (k == now and size > most)
                    yield group, large
                large = large and k == now
                now, group, size, new = k, [], 0, True
            if new:
                group.append((v, []))
                size += len(v)
            group[-1][1].append(tuple(place))
    if group:
        yield group, large


def settled(b: pa.RecordBatch) -> list[pa.Array]:
    """doc_id, own, start and end of the rows that are decided already."""
    b = b.filter(pc.is_null(b.column(1)))
    return [b.column(i) for i in (2, 3, 4, 5)]
