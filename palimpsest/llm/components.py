"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges(a, b)``; component is the least node reachable.

    Each round replaces edges by stars, whose rows never exceed the edges plus
    the nodes; rounds grow with the logarithm of the longest chain and go on
    until one changes nothing, however many that takes. Every round is a
    reliable checkpoint, so a lost executor costs that round alone, and nothing
    is collected but one count. An empty table gives no rows; repeated edges and
    loops change nothing.
    """
    prepare(edges.sparkSession)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()

    def signature(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    last = signature(now)
    if not last[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # Large star: each node's larger neighbours link to the least of its neighbours and itself.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node's smaller neighbours and itself link to the least of them.
        lower = large.filter("u > v")
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        this = signature(now)
        if this == last:
            break
        last = this
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
