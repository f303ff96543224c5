"""Minimum spanning forests of many runs at once, and the merge trees that Boruvka's rounds leave behind."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxloom.session import durable

#: Edges (or clusters) of a run that one task finishes.
HELD = 200_000


def merge_tree(edges: DataFrame, keys: tuple[str, ...], held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(`(keys, node, path)`, `(keys, a, b, w)`: the minimum spanning forest, a row fewer than nodes for each connected part).

    In Boruvka's rounds every component takes its least edge (ties by the edge's ends) and joins what that leads to. `path` has an
    entry for each round of a node: the component it is in then, and the largest weight its components have taken so far. Two nodes are
    connected by edges of up to w exactly if they come to the same entry when each climbs as far as its weights stay within w, so the paths,
    as many entries as there are rounds, hold the components at every distance.

    Runs with more than `held` edges left go through rounds of joins; what is left of a run then is finished in one task. Edges run
    between nodes a and b of a run, w is not null.
    """
    ids = list(keys)
    graph = durable(edges.select(*keys, "a", "b", "w", F.col("a").alias("ea"), F.col("b").alias("eb")))
    none = F.array().cast("array<struct<comp:bigint,w:double>>")
    nodes = graph.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct().select(*keys, "node", F.col("node").alias("comp"), none.alias("path"))
    chosen = []
    while True:
        counts = graph.groupBy(*keys).agg(F.count("*").alias("_edges"))
        large = counts.where(F.col("_edges") > held).select(*keys)
        mine = durable(graph.join(large, ids, "left_semi"))
        if mine.isEmpty():
            break
        step = _hooked(mine, keys)
        chosen.append(step.select(*keys, F.col("ea").alias("a"), F.col("eb").alias("b"), "w"))
        so_far = F.coalesce(F.element_at("path", -1)["w"], F.lit(0.0)) if chosen[1:] else F.lit(0.0)
        nodes = durable(nodes.join(step.select(*keys, F.col("v").alias("comp"), "root", F.col("w").alias("_w")), [*ids, "comp"], "left").select(
            *keys, "node", F.coalesce("root", "comp").alias("comp"), F.when(F.col("root").isNull(), F.col("path")).otherwise(F.concat(
                "path", F.array(F.struct(F.col("root").alias("comp"), F.greatest("_w", so_far).alias("w"))))).alias("path")))
        ends = graph.join(large, ids, "left_anti").unionByName(_contracted(mine, step, keys))
        graph = durable(ends)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema if f.name in keys)
    done = durable(graph.groupBy(*keys).applyInArrow(
        lambda table: _finished(table, ids), f"{kinds}, comp long, steps array<struct<comp:bigint,w:double>>, a long, b long, w double"))
    last = F.coalesce(F.element_at("path", -1)["w"], F.lit(0.0)) if chosen else F.lit(0.0)
    later = F.transform(F.coalesce("steps", none), lambda x: F.struct(x["comp"].alias("comp"), F.greatest(x["w"], last).alias("w")))
    tree = nodes.join(done.where("steps IS NOT NULL").select(*keys, "comp", "steps"), [*ids, "comp"], "left").select(
        *keys, "node", F.concat("path", later).alias("path"))
    forest = done.where("steps IS NULL").select(*keys, "a", "b", "w")
    for part in chosen:
        forest = forest.unionByName(part)
    return tree, forest.distinct() if chosen else forest


def _hooked(graph: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """`(keys, v, root, w, ea, eb)`: each component's least edge, and the component that all it leads to are joined in."""
    ids = list(keys)
    edge = lambda to: F.struct("w", "ea", "eb", F.col(to).alias("to"))
    ends = graph.select(*keys, F.explode(F.array(
        F.struct(F.col("a").alias("v"), edge("b").alias("e")), F.struct(F.col("b").alias("v"), edge("a").alias("e")))).alias("x"))
    least = durable(ends.groupBy(*keys, F.col("x.v").alias("v")).agg(F.min("x.e").alias("e")))
    ahead = least.select(*keys, F.col("v").alias("to"), F.col("e.to").alias("back"))
    # an edge that is least for both of its ends closes the only kind of circle there is; the smaller end becomes the root
    step = durable(least.withColumn("to", F.col("e.to")).join(ahead, [*ids, "to"]).select(
        *keys, "v", F.when((F.col("back") == F.col("v")) & (F.col("v") < F.col("to")), F.col("v")).otherwise(F.col("to")).alias("root"),
        "e.w", "e.ea", "e.eb"))
    while True:
        further = step.select(*keys, F.col("v").alias("root"), F.col("root").alias("_next"))
        moved = durable(step.join(further, [*ids, "root"]).select(*keys, "v", F.col("_next").alias("root"), "w", "ea", "eb", (F.col("_next") != F.col("root")).alias("_moved")))
        step = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return step


def _contracted(graph: DataFrame, step: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Edges between the new components, the least one for each pair."""
    ids = list(keys)
    for side in ("a", "b"):
        graph = graph.join(step.select(*keys, F.col("v").alias(side), "root"), [*ids, side]).drop(side).withColumnRenamed("root", side)
    pairs = graph.where("a != b").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min(F.struct("w", "ea", "eb")).alias("e"))
    return pairs.select(*keys, "a", "b", "e.w", "e.ea", "e.eb")


def _finished(table: pa.Table, keys: list[str]) -> pa.Table:
    """All rounds of one run: a row with its steps for each component, and a row for each edge of the forest."""
    a, b, w, ea, eb = (np.asarray(table.column(c).combine_chunks()) for c in ("a", "b", "w", "ea", "eb"))
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    steps, weights, taken = _rounds(len(names), ends[:len(a)], ends[len(a):], w, np.lexsort((eb, ea, w)))
    height, n, m = len(steps), len(names), len(taken)
    inner = pa.StructArray.from_arrays(
        [pa.array(names[np.array(steps, np.int64).reshape(height, n).T.ravel()]), pa.array(np.array(weights, np.float64).reshape(height, n).T.ravel())], ["comp", "w"])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * height), inner)
    ids = [pa.array([table.column(c)[0].as_py()] * (n + m), table.schema.field(c).type) for c in keys]
    gone = lambda size, kind: pa.nulls(size, kind)
    return pa.table(
        [*ids, pa.concat_arrays([pa.array(names.astype(np.int64)), gone(m, pa.int64())]), pa.concat_arrays([lists, gone(m, lists.type)]),
         *(pa.concat_arrays([gone(n, kind), pa.array(v[taken], kind)]) for v, kind in ((ea, pa.int64()), (eb, pa.int64()), (w, pa.float64())))],
        names=[*keys, "comp", "steps", "a", "b", "w"])


def _rounds(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, order: np.ndarray) -> tuple[list, list, np.ndarray]:
    """For each round the component of every node and the largest weight on its way; and the edges of the forest. `order` sorts the edges."""
    root, most = np.arange(n), np.zeros(n)
    steps, weights, taken = [], [], []
    left = order  # from the least edge on
    while True:
        left = left[root[a[left]] != root[b[left]]]
        if not len(left):
            return steps, weights, np.unique(np.concatenate([*taken, np.zeros(0, np.int64)])).astype(np.int64)
        x, y = root[a[left]], root[b[left]]
        first = np.full(n, len(left))
        np.minimum.at(first, np.concatenate([x, y]), np.concatenate([np.arange(len(left))] * 2))
        has = np.flatnonzero(first < len(left))
        edge = first[has]
        up = np.arange(n)
        up[has] = np.where(x[edge] == has, y[edge], x[edge])
        both = (up[up] == np.arange(n)) & (np.arange(n) < up)
        up[both] = np.flatnonzero(both)
        while (up != up[up]).any():
            up = up[up]
        cost = np.zeros(n)
        cost[has] = w[left[edge]]
        most = np.maximum(most, cost[root])
        root = up[root]
        steps.append(root)
        weights.append(most)
        taken.append(left[edge])
