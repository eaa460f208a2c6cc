"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, materialize, scratch, small


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b): hang neighbours from the smallest node of a neighbourhood.

    The large star uses all neighbours and moves the larger ones; the small star uses
    the neighbours below a node, and moves them and the node itself.
    """
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = small(materialize(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-least"))
    moved = near.join(least, "a")
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the smallest node reachable.

    The edges stay distributed; each round is written to the shared folder. Rounds
    grow with the logarithm of the longest path.
    """
    now = materialize(edges.where("a <> b").select("a", "b").distinct(), "cc")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        for large in (True, False):
            with scratch():
                moved = materialize(_star(now, large).where("a <> b").distinct(), "cc", stays=True)
            discard(now)
            now = moved
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
