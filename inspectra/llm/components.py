"""Connected components of a link table, by alternating star contractions.

Both halves of a round are a minimum per node (pre-aggregated before the shuffle) joined
back to the links, so a node with a third of all links is a skewed *join* side, which
adaptive execution splits; no node's links are ever gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACK, cut, packed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return down.join(low, "u").select(F.inline(moved)).where("u <> v").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60, pack: int = PACK) -> DataFrame:
    """(node, root): for every node with a link, the smallest node it can reach.

    Null ends and self-links are ignored; repeated links count once; no links, no rows. A round that
    changes nothing ends it: the links' number and two sums of 64-bit hashes are as before. A round
    takes a partition for every `pack` links, so one of few links shuffles nothing.
    """
    state = cut(links.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u is not null and v is not null and u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        sums = (F.sum(F.xxhash64(F.lit(salt), "u", "v").cast("decimal(20,0)")) for salt in (1, 2))
        return tuple(df.agg(F.count(F.lit(1)), *sums).first())

    before = mark(state)
    for _ in range(max_rounds):
        state = cut(_small_star(_large_star(packed(state, before[0], pack))))
        now = mark(state)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    roots = packed(state, before[0], pack).select(F.col("u").alias("node"), F.col("v").alias("root"))
    return packed(cut(roots.union(roots.select(F.col("root").alias("node"), "root").distinct())), 2 * before[0], pack)
