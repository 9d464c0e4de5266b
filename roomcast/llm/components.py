"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomcast.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min(F.least("a", "b")).alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    joined = edges.join(least, F.col("b") == F.col("u"))
    return (
        joined.select(F.col("m").alias("a"), "b")
        .unionByName(joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node but the roots, from edges (a, b) with a < b; a root is its component's least id.

    Every round is written to the shared checkpoint folder.  Stars are stable once
    each node has one edge, to its root; rounds grow with the logarithm of the
    longest path.  Large stars are split by AQE, sums are partial aggregates.
    """
    now = materialize(edges.select("a", "b").distinct())
    while True:
        now = materialize(_small_star(_large_star(now)))
        roots = now.select(F.col("a").alias("b")).distinct()
        twice = now.groupBy("b").count().filter("count > 1").select("b")
        if twice.unionByName(roots.join(now.select("b"), "b", "left_semi")).isEmpty():
            return now.select(F.col("b").alias("id"), F.col("a").alias("root"))
