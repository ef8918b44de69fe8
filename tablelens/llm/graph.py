"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import materialise


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(v, c) for every vertex of ``edges`` (a, b) that has a neighbour: c is the smallest vertex that links reach from v.

    Alternates the large-star and small-star steps until the edges no longer change; after each, every vertex points to
    a smaller one of its component, and paths shorten by half or more, so the rounds grow with the logarithm of the
    longest path. Each round is a written table. Loops and edges with a null are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).where("u <> w").distinct()
    given = e = materialise(e, tag)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("w").alias("u"), F.col("u").alias("w")))
        # Written first, so that the join deals its rows anew and can split a vertex that most edges share.
        least = materialise(both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m")), tag)
        # Large star: larger neighbours of u point to the least of u and its neighbours.
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        # Small star: u and its smaller neighbours point to the least of them.
        large = materialise(large, tag)
        low = materialise(large.groupBy("u").agg(F.min("w").alias("m")), tag)
        joined = large.join(low, "u")
        small = joined.select(F.col("w").alias("u"), F.col("m").alias("w")).unionByName(joined.select("u", F.col("m").alias("w")))
        e = materialise(small.where("u <> w").distinct(), tag)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # From the written edges, so that what made them runs once.
    all_v = given.select(F.col("u").alias("v")).unionByName(given.select(F.col("w").alias("v"))).distinct()
    return all_v.join(e.select(F.col("u").alias("v"), F.col("w").alias("c")), "v", "left").select("v", F.coalesce("c", "v").alias("c"))
