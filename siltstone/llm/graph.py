"""Connected components of large edge tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import drop_table, table


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, head for every node of `edges` (a long, b long), where head is the least node reachable; loops do not matter.

    Each round hangs all larger neighbours of a node, then the node and its smaller ones, on the least of them; rounds are
    about the logarithm of the longest path. Nothing is collected but a count and a checksum. Each round's edges are
    written to the shared folder, so a lost executor costs one round at most, and those of the round before deleted. Null ends are dropped.
    """
    a, b = F.col("a"), F.col("b")
    stars = table(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{name}0")
    mark, number = None, 0
    while True:
        now = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == mark or not now[0]:
            break
        mark, number = now, number + 1
        both = stars.unionByName(stars.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        wide = both.where(b > a).join(least.select("a", F.least("a", "m").alias("m")), "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        hung = wide.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        last, stars = stars, table(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}{number}")
        drop_table(last)
    heads = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("head")).unionByName(heads.select("node", F.col("node").alias("head")))
