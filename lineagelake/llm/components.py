"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagelake.llm.common import forget, written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """Tells edge tables apart: their size and two sums over hashes of their rows."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (id, component): the smallest id reachable, for each id that has an edge.

    Each round is two shuffles of the edges with map-side minima; rounds grow with the logarithm of the longest path.
    The edges never leave the executors; each round is a table in the shared folder.
    """
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS if state[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours of u go to the least of u's neighbourhood
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        old, now = now, written(small)
        forget(old)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not converge")
    star = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("id"), "component").distinct())
