"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise


def components(edges: DataFrame, tag: str = "stars", rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes in `edges` (columns a, b; any orderable type).

    Each step only takes minima of neighbours and joins them back, so no neighbourhood is gathered; every round is written to the
    shared folder and replaces the one before. Nulls and loops are ignored; without edges the result is empty."""
    star = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    before = None
    for _ in range(rounds):
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points to something smaller
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        last, star = star, materialise(small, tag)
        discard(last)
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
