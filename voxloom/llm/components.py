"""Connected components of a link table, by contraction with a new random order in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxloom.session import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`id, component` for every id that occurs in a link; `component` is the least id that links lead to.

    Each round sends every node to the least of itself and its neighbours in an order drawn anew, rewrites the links between those
    representatives and drops loops and repeats, so the number of nodes falls by a constant factor whatever the shape: paths and
    stars take few rounds. All of it is joins and map-side combined aggregates on stored tables; no neighbour list is built.
    Links with a null end are ignored.
    """
    edges = durable(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                    .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    found = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("v"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        parent = durable(least.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("to")))
        if found is None:
            found = parent.select(F.col("node").alias("id"), F.col("to").alias("rep"))
        else:
            found = durable(found.join(parent, F.col("rep") == F.col("node"), "left").select(
                "id", F.coalesce("to", "rep").alias("rep")))
        start = parent.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        stop = parent.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        edges = durable(edges.join(start, "a").join(stop, "b").where("pa != pb")
                        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        turn += 1
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = found.groupBy("rep").agg(F.min("id").alias("component"))
    return durable(found.join(least, "rep").select("id", "component"))
