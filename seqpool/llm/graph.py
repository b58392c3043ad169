"""Connected components of a large undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpool.llm.common import written

MAX_ROUNDS = 60  # the steps needed grow with the logarithm of the longest path


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (itself included)."""
    both = _both_ways(edges)
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "edges-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them.  Edges: u > v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
    rest = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: every u has one v, and no v is a u.  Then v is the smallest node of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return ends.where("up > 1 OR (up > 0 AND down > 0)").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of its component, for every node of an edge (u, v) but the roots.

    (node, root) of an earlier call may stand among the edges: stars cost no round.

    Each round is written to the shared folder, which cuts the lineage; only a count reaches the driver.  The least
    neighbours are written before they are joined: a join of two plain sides can split the rows of a node with very many edges."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = written(_small_star(written(_large_star(now), "edges-star")), "edges")
    raise RuntimeError("components did not settle")
