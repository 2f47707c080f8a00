"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard
from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each larger neighbour of a node to the least of its neighbours and itself.
    Small star: the same for the smaller neighbours and the node itself."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    # Written out, so that the join below is of two plain shuffles, whose hot keys Spark can split.
    least = materialise(least.select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    joined = near.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _stars(pairs: DataFrame) -> bool:
    """Whether no larger end of a pair is an end of another pair."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("larger")), F.struct(F.col("v").alias("node"), F.lit(0).alias("larger")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("larger").alias("n"), F.min("larger").alias("all")).where("n > 1 OR n = 1 AND all = 0").isEmpty()


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """``node`` and ``component`` (its least node) of all nodes of ``edges`` (``u``, ``v``).

    Alternates large-star and small-star until the edges are stars: then each node but the least of a
    component is linked to the least, and to no other. Each round is written to the shared folder; no
    node's neighbours are ever gathered in one place.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialise(pairs, what)
    while not _stars(pairs):
        before, pairs = pairs, materialise(_star(_star(pairs, True), False), what)
        discard(before)
    stars = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
