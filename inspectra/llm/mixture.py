"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate, target share x output size / its rows. A document's
count is the inverse of the Poisson distribution with that mean at a uniform number hashed
from its id and a seed, so a rerun, another partitioning or a lost executor gives the same
copies. Rates above `part` are split into equal smaller rates with a hash each (sums of
Poisson counts are Poisson), so no rate is capped. Copies are dealt to partitions by a hash
of id and copy number, and sorted by another one inside: a global shuffle in one exchange.

Only DataFrame functions. Row counts per source are pre-aggregated; the rate table has a row
for each source and is broadcast only if its rows, counted first, are few.

Defined cases: a null source is a source of its own; a source without a weight in `weights`
has rate 0; null ids and repeated rows draw by id, so repeated rows get the same count; an
empty table gives no rows; a column called `copy` is replaced; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

PRECISION = 1e-15


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts (one form in every SQL engine)."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, size: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, n, rate): mean repetitions of a source's rows. Without weights the target shares are rows ** alpha, normalised. `size`: rows out for each row in."""
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        found = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.lit(None).cast("map<string,double>")
        n = n.withColumn("w", F.coalesce(F.try_element_at(found, F.col("source")).cast("double"), F.lit(0.0)))
    total = n.agg(F.sum("n").alias("rows"), F.sum("w").alias("all"))
    return n.crossJoin(F.broadcast(total)).select("source", "n", F.coalesce(F.try_divide(F.col("w") * F.col("rows") * size, F.col("all") * F.col("n")), F.lit(0.0)).alias("rate"))


def poisson_copies(docs: DataFrame, rates: DataFrame, seed: int = 17, part: float = 8.0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of docs and `copy` (0, 1, ...): each row as often as its count says, in globally random order."""
    own = [c for c in docs.columns if c.lower() != "copy"]
    source, rate, parts, lam, cdf, n, deal = fresh([*docs.columns, "copy"], "source_", "rate_", "parts_", "lam_", "cdf_", "n_", "deal_")
    number = F.greatest(F.ceil(F.col("rate") / part), F.lit(1))
    # The distribution function up to where it is 1 in doubles: some 40 numbers for a rate of 8, made once a source.
    steps = F.sequence(F.lit(1), (F.lit(part) * 3 + 40).cast("int"))
    rates = rates.select(F.col("source").alias(source), F.col("rate").alias(rate), number.cast("int").alias(parts), (F.col("rate") / number).alias(lam))
    start = F.struct(F.exp(-F.col(lam)).alias("p"), F.array(F.exp(-F.col(lam))).alias("cdf"))
    grown = F.aggregate(
        steps,
        start,
        lambda a, k: F.struct((a["p"] * F.col(lam) / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col(lam) / k)).alias("cdf")),
        lambda a: F.filter(a["cdf"], lambda c: c < 1 - PRECISION),
    )
    rates = rates.withColumn(cdf, F.when(F.col(rate) > 0, grown)).drop(lam)
    joined = docs.select(*map(_quoted, own)).join(rates, F.col(_quoted(source_col)).eqNullSafe(F.col(source)))
    one = lambda i: F.size(F.filter(cdf, lambda c: c <= uniform(str(seed), F.col(id_col), i)))
    count = F.when(F.col(rate) > 0, F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda a, i: a + one(i))).otherwise(0)
    counted = joined.withColumn(n, count).where(F.col(n) > 0)
    copies = counted.select(*map(_quoted, own), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("copy"))
    # Rows without an id are told apart by all they hold.
    rest = F.when(F.col(id_col).isNull(), F.xxhash64(*(F.col(_quoted(c)) for c, kind in docs.dtypes if c in own and "map<" not in kind)))
    key = lambda salt: F.xxhash64(F.lit(seed + salt), F.col(id_col), rest, F.col("copy"))
    return copies.withColumn(deal, key(1)).repartition(deal).sortWithinPartitions(key(2)).drop(deal)


def _quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, size: float = 1.0, seed: int = 17, most_sources: int = 50_000) -> DataFrame:
    """Replicate docs to the target weights. Rates are broadcast if there are at most most_sources of them (some 20 MB); else joined by shuffle."""
    rates = cut(source_rates(docs, weights, alpha, size))
    return poisson_copies(docs, F.broadcast(rates) if rates.count() <= most_sources else rates, seed)


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * (SELECT sum(n) FROM n) / ((SELECT sum(w) FROM n) * n) AS rate FROM n),
p AS (SELECT source, greatest(ceil(rate / 8.0), 1)::INT AS parts, rate / greatest(ceil(rate / 8.0), 1) AS lam FROM r),
c AS (SELECT source, parts, [list_sum(list_transform(range(0, k + 1), lambda j: exp(-lam + j * ln(lam) - lgamma(j + 1)))) FOR k IN range(0, 65)] AS cdf FROM p),
d AS (SELECT documents.*, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf, lambda x: x < 1 - 1e-15 AND
        x <= ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT / 4503599627370496.0))))::INT AS m
      FROM documents JOIN c ON documents.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, m))::INT AS copy FROM d WHERE m > 0
"""
