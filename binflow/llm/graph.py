"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of `edges` (a, b) reaches.

    Alternates two steps until nothing changes: every node's larger neighbours, then its
    smaller ones and itself, are tied to the least node around it. Each step is a partial
    aggregate and a join on the node, so no neighbourhood is gathered anywhere, and the
    rounds grow with the logarithm of the longest chain.
    """
    now = stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if not now.limit(1).count():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Now each edge points from the larger node to a smaller one.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.u", "e.v").where("u != v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
