"""Connected components of an edge table by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hangs the larger (else: smaller, and the node itself) neighbours of every node on its smallest neighbour.

    The minimum is a partial aggregate and comes back by a join that Spark may split, so a hub with many neighbours
    meets in no single task.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if larger:
        return pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return pairs.where("v < u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node at most, and that one on none."""
    end = lambda node, up: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = edges.select(F.inline(F.array(end("u", 1), end("v", 0))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up = 1 and down > 0)").isEmpty()


def connected(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (node, label): the smallest node of its component, for every node of an edge that isn't a loop.

    Each round is stored in the shared folder; the rounds end when the edges are stars.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    while not _settled(edges):
        rounds -= 1
        if rounds < 0:
            raise RuntimeError("components did not settle")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = _star(both, larger=True).where("u <> v").distinct()
        shrunk = _star(grown.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger=False)
        edges = stored(shrunk.where("u <> v").distinct(), "star")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
