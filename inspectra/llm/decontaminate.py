"""Benchmark decontamination: a broadcast table of test n-grams probed by every training window.

Only DataFrame functions. A document's words are hashed window by window inside its row; the
windows are exploded straight into a broadcast hash join with the benchmark's windows, and a
match of hashes counts only if the words themselves are equal. Nothing but hits and one
mark per document is shuffled.

A benchmark of up to `block` windows is broadcast whole (some tens of MB). Of a larger one only the
64-bit hashes are, up to `hashes` of them (a proven bound, some 200 MB), and hits are verified by a join that is dealt
by hash; beyond that, documents are probed once for each `hashes` of them.

Defined cases: null and wordless texts have no words and are not contaminated; an item of fewer
words than a window is one window; an item without words, or null, matches nothing; rows that
repeat a doc_id and its text are one document, with another text one of their own; a null doc_id is an id like others;
items that repeat an item_id count once; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z only. Where a text is all ASCII the built-in lower() does the same, faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _gram_hash(hashes: Column, start: Column | int, n: int) -> Column:
    """Of n word hashes from `start` (0-based); each is read in place, so a window costs no copy of its document."""
    return F.xxhash64(*(F.get(hashes, start + j if isinstance(start, Column) else F.lit(start + j)) for j in range(n)))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _hashes(n: int) -> Column:
    starts = F.sequence(F.lit(0), F.size("wh") - n)
    return F.when(F.size("wh") >= n, F.transform(starts, lambda i: _gram_hash(F.col("wh"), i, n))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, gram, items): each distinct window with the items that hold it, as sorted strings."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where("size(words) > 0 and item is not null")
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    grams = items.select("item", F.explode_outer(F.expr("transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))")).alias("gram"))
    grams = grams.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("wh", _word_hashes(F.col("gram")))
    h = F.coalesce(*(F.when(F.size("gram") == n, _gram_hash(F.col("wh"), 0, n)) for n in range(1, window + 1)))
    return grams.select(h.alias("h"), "gram", "items")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block: int = 200_000, hashes: int = 4_000_000) -> DataFrame:
    """(doc_id, own, n_words, spans, items) for every document; own: the text's digest; spans: array of (start, end) word positions, end exclusive."""
    grams = cut(benchmark_windows(benchmark, window))
    sizes = [r.n for r in grams.select(F.size("gram").alias("n")).distinct().orderBy("n").collect()] or [window]  # `window` values at most
    count = grams.count()
    blocks = max(1, -(-count // hashes))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("own"), words(F.col(text_col)).alias("words")).withColumn("wh", _word_hashes(F.col("words")))
    # Outer, or else the optimizer adds a filter on the array's size, which works the whole row out again.
    # Element 0 marks the document, so that one pass gives its row even without a hit.
    rows = rows.withColumn("hashes", F.concat(F.array(F.lit(0).cast("long")), *(_hashes(n) for n in sizes)))
    each = rows.select("doc_id", "own", "words", F.posexplode_outer("hashes").alias("pos", "hash"))
    # Where each window length begins in the row of hashes.
    at, begin = F.lit(1), {}
    for n in sizes:
        begin[n] = at
        at = at + F.greatest(F.size("words") - (n - 1), F.lit(0))
    start = F.coalesce(*(F.when(F.size("gram") == n, F.col("pos") - begin[n]) for n in sizes))

    by_place = F.coalesce(*(F.when(F.col("pos") >= begin[n], F.col("pos") - begin[n]) for n in reversed(sizes)))

    def probe(k: int) -> DataFrame:
        mark = F.lit(k == 0) & (F.col("pos") == 0)
        if count <= block:
            same = (F.col("hash") == F.col("h")) & (F.col("pos") > 0) & (F.slice(F.col("words"), F.when(F.col("pos") > 0, start + 1).otherwise(1), F.size("gram")) == F.col("gram"))
            found = each.join(F.broadcast(grams), same, "left").where(mark | F.col("h").isNotNull())
            at, n_words = start, F.size("words")
        else:
            known = grams.where(F.pmod("h", F.lit(blocks)) == k).select(F.col("h").alias("known")).distinct()
            found = each.join(F.broadcast(known), (F.col("hash") == F.col("known")) & (F.col("pos") > 0), "left").where(mark | F.col("known").isNotNull())
            # Marks have no hash to meet by: they are dealt by document, and match nothing.
            own = F.when(F.col("pos") > 0, F.slice("words", by_place + 1, window))
            found = found.select("doc_id", "own", "pos", "known", F.size("words").alias("n"), by_place.alias("at"), own.alias("own_words"), F.coalesce("known", F.xxhash64("doc_id", "own")).alias("probe"))
            same = (F.col("probe") == F.col("h")) & F.col("known").isNotNull() & (F.slice("own_words", F.lit(1), F.size("gram")) == F.col("gram"))
            found = found.join(grams, same, "left").where(mark | F.col("h").isNotNull())
            at, n_words = F.col("at"), F.col("n")
        hit = F.col("h").isNotNull()
        return found.select(
            "doc_id",
            "own",
            F.when(mark, n_words).alias("n_words"),
            F.when(hit, F.struct(at.alias("start"), (at + F.size("gram")).alias("end"))).alias("span"),
            "items",
        )

    found = reduce(DataFrame.unionByName, map(probe, range(blocks)))
    return found.groupBy("doc_id", "own").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **columns) -> DataFrame:
    """(doc_id, own, n_words, n_hit, n_items, items, spans, contaminated) for every document."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    found = hits(docs, benchmark, window, **columns)
    return found.select("doc_id", "own", "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without a hit, all columns as they were, whatever their names. Rows that share an id are judged by their texts; null ids and texts are ids and texts like others; an empty table stays empty."""
    i, t = fresh(docs.columns, "bad_id", "bad_text")
    bad = decontaminate(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias(i), F.col("own").alias(t))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t))
    return docs.join(bad, same, "left_anti").select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, w[i : i + least(10, len(w)) - 1] AS gram, least(10, len(w)) AS n
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, w[i : i + n - 1] AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN bw ON dw.gram = bw.gram),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
