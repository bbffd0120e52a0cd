"""Connected components by alternating large and small stars: edges move to the smallest node, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shared


def components(edges: DataFrame, limit: int = 60) -> tuple[DataFrame, list[str]]:
    """edges: a, b (long). Returns (node, root) for every node with an edge, root the smallest node reachable, and the folders written.

    Each round is a few aggregations with map-side combination; a node with many neighbours is joined by a skewed join that
    Spark can split. The number of rounds grows with the logarithm of the largest component's diameter.
    """
    spark, paths = edges.sparkSession, []
    now, path = shared.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    paths.append(path)
    before = None
    for _ in range(limit):
        sums = now.agg(F.count("*"), F.sum("u"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if not sums[0] or tuple(sums) == before:
            break
        before = tuple(sums)
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        now, path = shared.stored(small, "edges")
        paths.append(path)
        shared.remove(spark, paths.pop(-2))
    else:
        raise RuntimeError(f"components not settled after {limit} rounds")
    roots = now.groupBy("v").agg(F.min("u").alias("root"))
    return roots.select(F.col("v").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), paths
