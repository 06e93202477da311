"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (a, b long); root is the smallest
    node that can be reached.

    Each round is two aggregations and joins on the node, with partial minima
    before the shuffle, and is written to the shared folder; rounds grow with
    the logarithm of the longest chain.  Edges with a null end are ignored, a
    loop makes its node a component, an empty table gives an empty table."""
    edges = edges.where("a is not null and b is not null").select("a", "b")
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    now, before = materialise(_small_star(edges), "star"), None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == before or not state[0]:
            break
        before, now = state, materialise(_small_star(_large_star(now)), "star")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).union(loops)
    return found.groupBy("node").agg(F.min("root").alias("root"))
