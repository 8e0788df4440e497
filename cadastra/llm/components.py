"""Connected components of a table of links, on joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadastra.session import collect_garbage, stage


def _nearest_root(edges: DataFrame) -> DataFrame:
    """For each node, the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (u, v): the smallest node that links lead to.

    Two kinds of steps alternate until the links are stars. The first hangs a node's
    larger neighbours under its smallest one, the second its smaller neighbours;
    both keep what is connected, and the depth of the trees shrinks to one in a
    number of steps that grows with its logarithm. A node with very many
    neighbours is a skewed key of a join, which Spark splits; it is never
    gathered.
    """
    # Every step reads a written table: its plan doesn't repeat those of the steps before it.
    edges = stage(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = both.join(_nearest_root(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = stage(larger.where(F.col("u") != F.col("v")).distinct())
        ends = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))
        smaller = hung.join(_nearest_root(hung), "u").select(ends.alias("end")).select(F.col("end.v").alias("u"), F.col("end.m").alias("v"))
        edges = stage(smaller.where(F.col("u") != F.col("v")).distinct())
        collect_garbage(links.sparkSession)
        # Done when each node hangs under one other, and none of those under another.
        state = edges.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        state = state.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if state.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty():
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return stage(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))
