"""Connected components of a graph in tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import delete, join_counted, stored


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``links`` (columns ``a`` and ``b``); the component is its smallest node.

    Large star: each node points its larger neighbours to its smallest neighbour.
    Small star: each node points its smaller neighbours, and itself, to the
    smallest.  The rounds grow with the logarithm of the size.  Each round is a
    table, so a lost executor costs one round at most; nothing is collected.
    """
    spark = links.sparkSession
    edges, path = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_path = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n")), "components-low")
        large = join_counted(both, low, "a", "n").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).distinct()
        # The node itself always keeps a link to the smallest: the case b == low gives it.
        before, (edges, path) = path, stored(small, "components")
        delete(spark, before)
        delete(spark, low_path)
        several = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if several.select("a").unionByName(inner).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
