"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import is_small, stash


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the least of its neighbourhood.
    With `few` edges, counted before, the table of least neighbours is sent to all executors."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        both = both.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("n"), F.least("n", "m").alias("m"))
    linked = both.join(F.broadcast(least) if few else least, both.x == least.n)
    if large:
        out = linked.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("y").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node that itself has none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); a component is named by its least node.
    Self loops and repeated edges change nothing."""
    edges = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_done(edges):
        few = is_small(edges)
        edges = stash(_star(_star(edges, True, few), False, few), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
