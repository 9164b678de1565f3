"""N-gram Jaccard join: size-aware heavy-light self-join of shingle sets at a similarity of 0.8.

Two alike sets of n and m shingles share, for every c, c of the first n - ceil(0.8 n) + c and m - ceil(0.8 m) + c of a common order. So

* light sets (up to the boundary) enumerate all subsets of c = 2 shingles of these first ones and meet under whole subsets, which are far more selective than single shingles, but
  whose number grows with the square of the size;
* heavy sets scan inverted lists: they stand in the list of each of their first n - ceil(0.8 n) + 1 shingles. Light sets within a similarity of
  0.8 of the boundary stand there too, so light and heavy sets meet.

The boundary is the size at which the whole costs least: subsets dealt by light sets, list entries scanned by heavy ones, counted for all sets by classes of size (`boundary`). It is taken once a sixteenth of the lists
has joined the dense groups, over the lists that are still open: entries of one component are scanned no more, and counted with the square of a group's size they would make nearly all sets light, with up to w * (w - 1) / 2 subsets each.
Counting, buckets, verification on whole sets and the splitting of hot buckets are those of `near`; documents of equal sets are one node from the start, so copies never meet one by one.

Defined cases: null, empty and blank texts have an empty set, n_shingles 0, and are linked with nothing; fewer words than a shingle make one shingle; repeated rows have equal sets and are
linked; a null doc_id gets its component, but never names one; an empty table gives no rows; other columns are ignored. Very long texts are taken whole, one at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .near import MANY, OVER, SHINGLE, UNDER, entries, linked, list_keys, named, nodes_of, rows_of
from .passages import OFTEN


def subset_keys(nodes: DataFrame) -> DataFrame:
    """The subsets of two shingles under which sets meet, as `list_keys`."""
    first = F.slice("shared", F.lit(1), F.size("shared") - F.col("need") + 2)
    one = nodes.select("node", "label", "size", "lone", first.alias("first"), F.posexplode(first).alias("i", "x"))
    two = one.select("node", "label", "size", "lone", "i", "x", F.posexplode(F.slice("first", F.col("i") + 2, F.size("first"))).alias("j", "y"))
    at = F.col("i") + F.col("j") + 2
    return two.select(F.xxhash64(F.lit(2), "x", "y").alias("key"), "node", "label", at.alias("at"), F.lit(2).alias("depth"), (at - 2 + F.col("lone")).alias("apart"), "size", F.lit(None).cast("long").alias("passed"))


def boundary(nodes: DataFrame, lists: DataFrame | None = None) -> int:
    """The size up to which sets are light. lists: the entries to be scanned (size, scan); without, the nodes tell theirs (scan)."""
    width = F.expr("size(shared) - need + 2")
    classes = nodes.groupBy(F.floor(F.log2("size") * 8).alias("class"))  # eight classes for each power of two
    rows = classes.agg(F.max("size").alias("most"), F.sum(width * (width - 1) / 2).alias("subsets")).orderBy("class").collect()
    scans = (nodes if lists is None else lists).groupBy(F.floor(F.log2("size") * 8).alias("class")).agg(F.sum("scan").alias("scan"))
    scan = {r["class"]: r.scan for r in scans.collect()}

    def cost(b: int) -> float:
        return sum(r.subsets if r.most <= b else 0 for r in rows) + sum(scan.get(r["class"], 0) if UNDER * r.most >= OVER * (b + 1) else 0 for r in rows)

    return min([0, *(r.most for r in rows)], key=cost)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, often: int = OFTEN, many: int = MANY, light: int | None = None) -> DataFrame:
    """(doc_id, own, n, component_id) of every row: n distinct shingles; component_id the smallest doc_id reachable over links. light: a boundary to take instead of the cheapest."""
    rows, texts = rows_of(docs, id_col, text_col, width, False)
    nodes = nodes_of(rows, texts, width, False, often, many)

    def keys_of(marked: DataFrame) -> DataFrame:
        most = boundary(marked, entries(marked, many)) if light is None else light
        return subset_keys(marked.where(F.col("size") <= most)).union(list_keys(marked.where(UNDER * F.col("size") >= OVER * (most + 1))))

    return named(rows, linked(nodes, many, keys_of))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


OP12_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM reach JOIN both_ ON a = doc_id WHERE c < b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
