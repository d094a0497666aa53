"""Connected components by randomised contraction.

In each round every node joins the neighbour (or itself) with the smallest hash under the round's seed; edges are carried over to
the chosen nodes and vanish within them. A constant share of the nodes goes in each round, however long the paths are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """edges: (a, b) longs without nulls. Gives (node, component) for each node of an edge between two nodes; the
    component is named by its smallest node."""
    edges = scratch.save(edges.select("a", "b").filter("a <> b").distinct(), f"{label}-edges0")
    rounds = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rounds)), F.col(c).alias("node"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        chosen = best.select(F.col("a").alias("node"), F.least(F.col("best"), rank("a"))["node"].alias("into"))
        chosen = scratch.save(chosen, f"{label}-into{rounds}")
        left, right = chosen.select(F.col("node").alias("a"), F.col("into").alias("to_a")), chosen.select(F.col("node").alias("b"), F.col("into").alias("to_b"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        rounds += 1
        edges = scratch.save(moved.filter("a <> b").distinct(), f"{label}-edges{rounds}")
    like = edges.sparkSession.createDataFrame([], "node long, into long")
    names = scratch.read(f"{label}-into0", like) if rounds else like
    for r in range(1, rounds):
        step = scratch.read(f"{label}-into{r}", like).select(F.col("node").alias("into"), F.col("into").alias("next"))
        names = names.join(step, "into", "left").select("node", F.coalesce("next", "into").alias("into"))
    names = scratch.save(names, f"{label}-names")
    least = names.groupBy("into").agg(F.min("node").alias("component"))
    out = scratch.save(names.join(least, "into").select("node", "component"), f"{label}-components")
    scratch.drop(*(f"{label}-{x}{r}" for r in range(rounds + 1) for x in ("edges", "into")), f"{label}-names")
    return out
