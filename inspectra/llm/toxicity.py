"""Toxicity from a weighted lexicon, matched by one Aho-Corasick automaton on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits used as letters to
plain ones, and turns everything but letters into blanks. The lexicon is learned: words and
word beginnings with the log-odds of toxic against clean labelled documents (at cautious ends of both counts), counted by Spark
over a bounded sample of labelled rows (`max_rows`, smallest hash of doc_id first). A feature
also needs many different left neighbours, so a passage that was merely copied does not enter.
Matches inside an exception phrase do not count. The weight of all matches over log2 of the
length goes through a logistic curve fitted on the same sample.

Defined cases: null, empty and letterless texts have no match and the score of one without;
rows that repeat a doc_id each get a row; labels that are null or disagree within a doc_id
count as toxic if any row says so; no usable labels: score 0 and predicted 0 for all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

# Letters of other scripts that look like Latin ones, and characters used as letters.
LOOK_ALIKE = dict(zip("авсеһіјкмнорѕтухԁԛԝɡɩαβεικνορτυχ", "abcehijkmhopstuxdqwgiabeikvoptux"))
AS_LETTER = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "circus clown", "clown fish", "pathetic fallacy", "scum line", "sore loser")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = LOOK_ALIKE.get(c, AS_LETTER.get(c, c))
        self[code] = out = c if c.isalpha() else " "
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, one blank at least before and after each."""
    return f" {(text or '').translate(_FOLD)} "


def _features(text: str, prefixes: tuple[int, ...]) -> dict[str, int]:
    """Each feature of a text, with one bit for each of its left neighbours (hashed to 62)."""
    own: dict[str, int] = {}
    before = ""
    for w in text.split():
        if len(w) >= 4:
            bit = 1 << zlib.crc32(before.encode()) % 62
            for f in (f" {w} ", *(f" {w[:n]}" for n in prefixes if len(w) > n)):
                own[f] = own.get(f, 0) | bit
        before = w
    return own


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed, max_rows: int, label: str) -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled documents that `allowed` admits; the id list is broadcast, its bound is max_rows."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    few = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def learn_lexicon(sample: DataFrame, prefixes: tuple[int, ...] = (4, 5, 6, 7), least_docs: int = 4, relative: float = 0.2, neighbours: float = 0.5) -> dict[str, float]:
    """Feature -> weight. Counted in each task first, then summed by Spark; only the chosen features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f, bits in _features(fold(text), prefixes).items():
                    at = toxic.setdefault(f, [0, 0, 0])
                    at[y] += 1
                    at[2] |= bits
        yield pa.RecordBatch.from_arrays([pa.array(list(toxic), pa.string()), *(pa.array([x[i] for x in toxic.values()], pa.int64()) for i in range(3))], names=["f", "clean", "toxic", "bits"])

    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    counts = sample.select("text", "y").mapInArrow(run, "f string, clean long, toxic long, bits long")
    counts = cut(counts.groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("bits").alias("bits")).where(F.col("clean") + F.col("toxic") >= least_docs))
    # Chance finds: the log likelihood of a feature's toxic share against the common one must outweigh the number of features tried.
    base = n[1] / (n[0] + n[1])
    share = F.col("toxic") / (F.col("clean") + F.col("toxic"))
    gain = F.col("toxic") * F.log(share / base) + F.when(share < 1, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    # Log-odds at cautious ends of both counts, so that a rare feature weighs little.
    least = F.col("toxic") - 1.64 * F.sqrt("toxic") + 0.5
    most = F.col("clean") + 1.64 * F.sqrt(F.col("clean") + 1) + 0.5
    weight = F.log(least / (n[1] + 1.0)) - F.log(most / (n[0] + 1.0))
    # Words of a copied passage keep their left neighbours; t independent ones would fill 62 bits so far.
    spread = 62 * (1 - F.exp(-F.col("toxic") / 62))
    found = counts.where((F.col("toxic") >= least_docs) & (F.bit_count("bits") >= spread * neighbours)).withColumn("w", weight)
    found = cut(found.where((F.col("w") > 0) & (gain >= math.log(max(1, counts.count())) + 2)))
    found = found.where(F.col("w") >= relative * (found.agg(F.max("w")).first()[0] or 0.0))
    lexicon: dict[str, float] = {}
    for f, w in sorted(((r.f, r.w) for r in found.select("f", "w").collect()), key=lambda x: (len(x[0].rstrip()), x[0])):
        # A word that a shorter chosen beginning covers would count twice.
        if not any(lexicon.get(f[:n], -math.inf) >= 0.8 * w for n in range(2, len(f.rstrip()) + 1) if f[:n] != f):
            lexicon[f] = w
    return lexicon


def matcher(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton | None:
    if not lexicon:
        return None
    auto = ahocorasick.Automaton()
    for f, w in lexicon.items():
        auto.add_word(f, (len(f), w))
    for p in exceptions:
        auto.add_word(p := f" {p} ", (len(p), None))
    auto.make_automaton()
    return auto


def match_weight(auto: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int]:
    """(weight of the matches over log2 of the words, matches)."""
    if auto is None or not text:
        return 0.0, 0
    t = fold(text)
    found = [(end - size + 1, end, w) for end, (size, w) in auto.iter(t)]
    if not found:
        return 0.0, 0
    free = [(a, b) for a, b, w in found if w is None]
    hits = [w for a, b, w in found if w is not None and not any(x <= a and b <= y for x, y in free)]
    return math.fsum(hits) / math.log2(2 + len(t.split())), len(hits)


def raw_scores(docs: DataFrame, lexicon: dict[str, float], keep: list[str], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """The columns `keep`, x (normalised weight) and n_matches, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = matcher(lexicon, exceptions)
        for b in batches:
            got = [match_weight(auto, t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=[*keep, "x", "n_matches"])

    rows = docs.select(*keep, F.col("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{kinds}, x double, n_matches long")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) of a ridge logistic curve, by Newton's method."""
    if not len(x) or y.min() == y.max():
        return 0.0, -50.0
    z = np.c_[x, np.ones(len(x))]
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        g = z.T @ (y - p) - ridge * beta
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, allowed, max_rows: int = 20_000) -> tuple[dict[str, float], float, float]:
    """Lexicon and curve, learned only from labelled rows that `allowed` admits, max_rows at most."""
    sample = cut(labelled_sample(docs, labels, allowed, max_rows, "toxic"))
    lexicon = learn_lexicon(sample)
    points = raw_scores(sample, lexicon, ["y"]).select("x", "y").toPandas()  # max_rows rows at most
    return (lexicon, *fit_logistic(points.x.to_numpy(), points.y.to_numpy(np.float64)))


def toxicity(docs: DataFrame, model: tuple[dict[str, float], float, float], keep: list[str] | None = None) -> DataFrame:
    """(doc_id, or the columns `keep`, score, predicted, n_matches) for every row."""
    keep = keep or ["doc_id"]
    lexicon, slope, intercept = model
    score = 1 / (1 + F.exp(-(F.col("x") * slope + intercept)))
    return raw_scores(docs, lexicon, keep).select(*keep, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "n_matches")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_matches")
