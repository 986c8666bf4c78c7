"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges: a, b (long). Returns node, component: the least node reachable, for every node on an edge to another.

    Each round joins every edge with the least neighbour of one of its ends, so that paths shorten by half or more; edges
    are written to the shared folder after each round. Least neighbours are written before they are joined, so that both sides of the join
    are plain shuffles and Spark can split the side of a node with very many edges. Loops and null ends are ignored, repeated edges count once.
    An error if the edges still change after max_rounds.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        least = materialize(least, "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        nearest = materialize(nearest, "nearest")
        small = large.join(nearest, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        )
        small = small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        now = materialize(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"connected_components has not converged after {max_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
