"""Connected components of links by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; a root is the smallest node of its component.

    ``links`` has integer columns a and b. A large star hangs the larger
    neighbours of a node under the smallest one, a small star the others; both
    are a minimum by node (combined before the shuffle) and a join back, so a
    node with many links needs no task of its own. Rounds grow with the
    logarithm of the longest chain. Each round is written.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    edges = durable(edges.distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("x")).first()
        if state["n"] == 0 or tuple(state) == before:
            return edges
        before = tuple(state)
        edges = durable(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(
        edges.select(F.col("root").alias("u"), F.col("node").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Here node > root in every row.
    least = edges.groupBy("node").agg(F.min("root").alias("m"))
    others = edges.join(least, "node").where("root != m").select(F.col("root").alias("node"), F.col("m").alias("root"))
    return others.unionAll(least.select("node", F.col("m").alias("root"))).distinct()
