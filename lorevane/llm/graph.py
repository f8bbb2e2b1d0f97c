"""Connected components of a graph given as a table of edges, in rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b): root is the smallest node that the node is linked with.

    Each round hangs every node's neighbours on the smallest of them, first the larger ones, then the smaller ones.
    The minimum of a node's neighbours is a partial aggregate and a join, so no task gathers a node's neighbours. The
    number of rounds grows with the logarithm of the longest chain. Rounds are written to the shared folder; the last one is
    what the result reads, and can be discarded with it.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _sum(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        discard(now), discard(large)
        total = _sum(after)
        now = after
        if total == seen:
            break
        seen = total
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._lorevane_path = now._lorevane_path
    return out


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
