"""Connected components of an edge list by alternating star contractions, with DataFrame operations only.

Large star links every larger neighbour of a node to the smallest node around it,
small star every smaller one; they alternate until every edge ends in the smallest
node of its component.  Rounds grow with the logarithm of the longest chain.  Each
round's edges are written to the shared folder, so lineage stays short and a lost
executor costs one round at most.  Joins carry a node's minimum to its neighbours,
so a hub's neighbours are never gathered in one row and a skewed join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common


def _edges(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, from one scan."""
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return edges.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.a", "e.b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = F.explode(F.array("a", "b")).alias("a")
    return edges.join(least, "a").select(linked, F.col("m").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (a > b, none twice) are stars: each ``a`` has one edge and is no other edge's ``b``."""
    seen = _both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.sum((F.col("a") > F.col("b")).cast("int")).alias("ups"), F.count("*").alias("n"))
    return not seen.where("ups > 1 or (ups = 1 and n > 1)").limit(1).count()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b), longs -> (node, label): the smallest node of the component; nodes without an edge are left out.

    Stops once all edges are stars.  Loops and repeated edges are allowed; an empty list
    gives an empty result.  The halves of a round are written apart: each stage and each
    scan that is started costs the driver some MB for a moment, and a plan of both halves
    starts a dozen scans at once.
    """
    now = common.written(_edges(edges), "cc-edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        now = common.written(_edges(_large_star(now)), "cc-large")
        now = common.written(_edges(_small_star(now)), "cc-round")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
