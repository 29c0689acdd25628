"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.tables import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of the edges (a, b); comp is the smallest id.

    Each round hangs nodes on the smallest neighbour, first the larger neighbours,
    then the smaller ones; rounds grow with the logarithm of the longest chain. Hot
    nodes only take part in minima, which combine before the shuffle, and in joins."""
    state = keep(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(near, "a").where("b > a").select(
            F.col("m").alias("a"), "b").where("a <> b")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("a"), "b").unionByName(
            joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b")
        old, state = state, keep(small.distinct())
        drop(old)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = state.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct()
    return state.select(F.col("b").alias("id"), F.col("a").alias("comp")).unionByName(roots)
