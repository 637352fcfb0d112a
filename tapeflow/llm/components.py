"""Connected components of an edge table, by alternating star contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import Scratch


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node points to one smaller node at most, and no node that points is pointed at."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    bad = (
        ends.groupBy("x")
        .agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        .where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))
    )
    return bad.agg(F.count(F.lit(1))).first()[0] == 0


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs, in any direction -> (id, root) for each id in an edge; root: the smallest id reachable.

    A round is a large-star step (neighbours above a node move to its smallest neighbour) and a small-star step
    (neighbours below it do). Each is one aggregation with map-side combine and one equi-join, so a star with a third
    of all nodes is spread by partial aggregation and AQE's skew split. Rounds grow with the logarithm of the longest
    path. Self-loops and repeated edges are ignored; an empty table gives an empty result.
    """
    held = scratch.cut(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while not _is_forest_of_stars(held):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = (
            both.join(low, both["u"] == low["w"])
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(low, large["u"] == low["w"])
        small = (
            joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = scratch.cut(small)
        scratch.drop(held)
        held = nxt
    return held.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        held.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
