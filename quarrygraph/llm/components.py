"""Connected components by alternating star steps, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours onto the smallest node around each node.

    Large step: every larger neighbour; small step: every smaller one and the node itself.  The
    minimum is a partial aggregate, and the join of it is one that can be split where a node has
    very many neighbours.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, both.a == least.u).select("a", "b", "m")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def connected(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``node``, ``root``: the smallest node reachable over edges ``a``, ``b``, for nodes with edges.

    The rounds end when a whole round leaves every edge as it was; their number grows with the
    logarithm of the longest path.  Each round's edges are a table in the shared folder.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = shared.materialise(now, "edges"), None
    for _ in range(most_rounds):
        following = shared.materialise(_star(_star(now, True), False), "edges")
        mark = following.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        shared.drop_table(now)
        now = following
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    children = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return children.union(roots)
