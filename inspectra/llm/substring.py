"""Substring dedup over words, by suffix automata of reference passages and matching statistics.

A window of 13 words goes if its words also start in a document with a smaller id. Since the
reference is the whole corpus, its automata have no size bound and are not broadcast: the
corpus is sharded by winnowed anchors, each shard's automata are built in the task that
gets the shard, and the candidate passages of all documents stream through the automata of
their shard. Each state knows the smallest document that its strings end in; at every
word the matching statistics give the state of the last 13 words, and with it their first
document. Passages that are all alike need no automaton. A shard has MANY rows at most; hot anchors
are cut window by window (see passages).

Defined cases: null and short texts lose nothing; of equal texts all but the smallest id lose
everything (from 13 words on); rows that repeat a doc_id get a row each and do not count against
one another; a null doc_id is kept whole and counts against nobody; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .passages import ALL, Place, Unit, copies, dealt_parts, distinct_texts, grouped, id_and_text, merged, settled, without
from .winnow import mix

WIDTH = 13


def word_unit(width: int = WIDTH, k: int = 4, **hot: int) -> Unit:
    return Unit(
        split=lambda t: t.split(),
        hashed=lambda w: mix(np.fromiter(map(crc32, w), np.uint64, len(w))),  # equal hashes only make candidates
        joined=lambda parts: b" ".join(parts[0] if len(parts) == 1 else [w for p in parts for w in p]),
        length=lambda part: part.count(b" ") + 1,
        width=width,
        k=min(k, width),
        **hot,
    )


class Automaton:
    """A suffix automaton of several word sequences; `first` of a state is the smallest document its strings occur in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [ALL]

    def _state(self, length: int, link: int, first: int, step: dict) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The part of q that is reached over p, as a state of its own."""
        twin = self._state(self.length[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0, ALL, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, words: list[bytes], doc: int) -> None:
        state = 0
        for c in words:
            state = self._extend(state, c)
            up = state
            while up > 0 and self.first[up] > doc:
                self.first[up] = doc
                up = self.link[up]

    def settle(self) -> None:
        """States split off late take over the first documents of longer ones."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0 and self.first[s] < self.first[up]:
                self.first[up] = self.first[s]

    def first_of_windows(self, words: list[bytes], width: int) -> list[int]:
        """For each window of `width` words the smallest document that has it; ALL if none does."""
        out, state, size = [], 0, 0
        for i, c in enumerate(words):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            if i >= width - 1:
                at = state
                if size >= width:
                    while self.length[self.link[at]] >= width:
                        at = self.link[at]
                out.append(self.first[at] if size >= width else ALL)
        return out


def settle(places: list[Place]) -> tuple[list[Place], list[Place]]:
    """Of the places of one passage those after the first document go; those of the first are still to be compared. Where a text repeats
    one window over and over, its places are one."""
    low = min(places)[0]
    first = [p for p in places if p[0] == low]
    if len(first) > 1 and first[0][3] < 0:
        first = [(low, own, a, a - b) for own in {p[1] for p in first} for a, b in merged([(p[2], p[2] - p[3]) for p in first if p[1] == own], ALL)]
    return [p for p in places if p[0] > low], first


def removals(group: list[tuple[bytes, list[Place]]], width: int = WIDTH, k: int = 4) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, own, a, b) word spans to remove among distinct passages with one key and their places."""
    if len(group) == 1:
        text, places = group[0]
        n = text.count(b" ") + 1
        low = min(places)[0]
        yield from ((doc, mine, start, start + (n if at >= 0 else -at)) for doc, mine, start, at in places if doc > low)
        return
    # A common window holds the anchor and, on its left or right, half of its other words at least.
    half = -(-(width - k) // 2)
    split, sides = [], Counter()
    for text, places in group:
        words, at = text.split(b" "), places[0][3]
        left = (0, *words[at - half : at]) if at >= half else None
        right = (1, *words[at + k : at + k + half]) if len(words) >= at + k + half else None
        split.append((words, places, left, right))
        sides.update((left, right))
    split = [x for x in split if len(x[1]) > 1 or x[1][0][3] < 0 or (x[2] and sides[x[2]] > 1) or (x[3] and sides[x[3]] > 1)]
    auto = Automaton()
    for words, places, *_ in sorted(split, key=lambda x: min(x[1])):
        auto.add(words, min(places)[0])
    auto.settle()
    for words, places, *_ in split:
        first = np.array(auto.first_of_windows(words, width))
        for doc, mine, start, until in places:
            at = np.flatnonzero(first < doc)
            if until < 0 and len(at):  # a single window
                yield doc, mine, start, start - until
                continue
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1)
                for a, b in zip(np.r_[at[0], at[cut + 1]], np.r_[at[cut], at[-1]]):
                    yield doc, mine, start + int(a), start + int(b) + width


def repeated_words(texts: DataFrame, width: int = WIDTH, **hot: int) -> DataFrame:
    """(doc_id, own, a, b): word spans of texts (doc_id, text binary, own) that a smaller doc_id has too; they may overlap."""
    unit = word_unit(width, **hot)
    copied = copies(texts)
    dealt = dealt_parts(distinct_texts(texts, copied), unit, width - unit.k + 1, 1, settle)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "own", "a", "b"]
        done: list[list[pa.Array]] = []
        out: tuple[list, ...] = ([], [], [], [])

        def read() -> Iterator[pa.RecordBatch]:
            for b in batches:
                done.append(settled(b))
                yield b

        for group, _ in grouped(read()):
            for row in removals(group, width, unit.k):
                for column, x in zip(out, row):
                    column.append(x)
            while done:
                yield pa.RecordBatch.from_arrays(done.pop(), names=names)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)
                out = ([], [], [], [])
        for columns in [*done, [pa.array(x, pa.int64()) for x in out]]:
            yield pa.RecordBatch.from_arrays(columns, names=names)

    spans = dealt.mapInArrow(compare, "doc_id long, own long, a long, b long")
    return spans.union(copied.where("doc_id <> first").select("doc_id", "own", F.lit(0).cast("long"), F.lit(ALL).cast("long")))


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, **hot: int) -> DataFrame:
    """(doc_id, n_items, n_removed, n_spans, kept_sha256, kept) for every row. hot: `often` and `many`, from which an anchor is hot."""
    texts = id_and_text(docs, id_col, text_col)
    return without(texts, repeated_words(texts, width, **hot), word_unit(width), keep_text)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", F.col("n_items").alias("n_words"), "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, w[i : i + 12] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE doc_id > first),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM r),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x
      WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = x.doc_id AND p.p = x.i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
