"""Density clusters of variable density as joins and aggregations over all runs at once.

After Campello, Moulavi and Sander (2013), with the hierarchy cut at fixed, log-spaced levels:
nearest neighbours, mutual reachability, minimum spanning forest and its merge tree, condensed tree,
and selection by excess of mass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.functions import ranking
from voxloom.operators.forest import HELD, merge_tree
from voxloom.session import durable

NOISE = -1
_TINY = 1e-12
#: Rows of a block, pivots of a run, and slack of the bounds for rounding.
BLOCK_ROWS, PIVOTS, _SLACK = 1024, 16, 1e-8


def _nearest(queries: np.ndarray, others: np.ndarray, ids_q: np.ndarray, ids_o: np.ndarray, k: int):
    """Row, id and distance of the k nearest others of every query; ties by id."""
    square = np.zeros((len(queries), len(others)))
    for i in range(queries.shape[1]):  # summed one coordinate at a time, so a distance is the same from both ends and in any block
        square += (queries[:, i, None] - others[None, :, i]) ** 2
    distance = np.sqrt(square).round(9)
    distance[ids_q[:, None] == ids_o[None, :]] = np.inf
    order = np.lexsort((np.broadcast_to(ids_o, distance.shape), distance), axis=1)[:, :k]
    return order, np.take_along_axis(distance, order, axis=1)


def neighbours(points: DataFrame, keys: tuple[str, ...], node: str, vec: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact nearest neighbours `(keys, a, b, d, rank)` inside each run.

    A run is cut into blocks of bounded size; what `searches` finds may hold a neighbour is compared, and every such pair of blocks is one
    task, which gives the k best per row only.
    """
    rows, asked = searches(points, keys, node, vec, k, block_rows)
    found = _compared(rows, asked, keys, k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "a").orderBy("d", "b")))
    return ranked.where(F.col("rank") <= k)


def searches(points: DataFrame, keys: tuple[str, ...], node: str, vec: str, k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, `(keys, node, vec, mine, other)`: which row is to be compared with which block).

    Rows of a run lie in blocks by their nearest pivot and their distance to it. The k-th best distance inside a row's own block bounds
    its search; by the triangle inequality a block is out of reach where its distances to some pivot all differ from the row's by more. Blocks are
    ruled out for whole blocks first, then for single rows. A run of one block is compared as it is.
    """
    ids = list(keys)
    plain = points.select(*keys, F.col(node).cast("long").alias("node"), F.col(vec).cast("array<double>").alias("vec"))
    sizes = plain.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = plain.join(sizes.withColumnsRenamed({c: f"_{c}" for c in keys}), [F.col(c) == F.col(f"_{c}") for c in keys]).select(*plain.columns, "_n")
    whole = sized.where(F.col("_n") <= block_rows).select(*plain.columns, F.lit(0).cast("long").alias("block"))
    large = durable(sized.where(F.col("_n") > block_rows).drop("_n"))
    own = lambda rows: rows.select(*plain.columns, F.col("block").alias("mine"), F.col("block").alias("other"))
    if large.isEmpty():
        whole = durable(whole)
        return whole, own(whole)
    pivots = ranking.top_n(large, keys, [F.xxhash64("node"), F.col("node")], PIVOTS, "_pivot").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pivot", "vec"))), lambda p: p["vec"]).alias("_pivots"))
    far = F.transform("_pivots", lambda p: F.sqrt(F.aggregate(F.zip_with(p, F.col("vec"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))
    led = large.join(pivots, ids).withColumn("far", far).drop("_pivots").withColumn("_near", F.array_min("far"))
    placed = ranking.position(led, keys, [F.array_position("far", F.col("_near")), F.col("_near"), F.col("node")])
    placed = durable(placed.select(*plain.columns, "far", F.floor((F.col("pos") - 1) / block_rows).alias("block")))
    bounds = durable(placed.groupBy(*keys, "block").agg(
        F.array(*[F.min(F.get("far", F.lit(i))) for i in range(PIVOTS)]).alias("near"),
        F.array(*[F.max(F.get("far", F.lit(i))) for i in range(PIVOTS)]).alias("far")))
    first = _compared(placed, own(placed), keys, k)
    reach = first.groupBy(*keys, F.col("a").alias("node")).agg(F.when(F.count("*") >= k, F.max("d")).alias("reach"))
    reached = durable(placed.join(reach, [*ids, "node"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))))
    mine = bounds.join(reached.groupBy(*keys, "block").agg(F.max("reach").alias("reach")), [*ids, "block"])
    other = bounds.select(*keys, F.col("block").alias("other"), F.col("near").alias("o_near"), F.col("far").alias("o_far"))
    # some pivot keeps them apart if the gap between the spans of distances to it is wider than the search
    gap = lambda lo, hi, low, high: F.array_max(F.zip_with(
        F.zip_with(lo, high, lambda x, y: x - y), F.zip_with(low, hi, lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    plan = mine.join(other, ids).where(
        (F.col("block") != F.col("other")) & (gap(F.col("near"), F.col("far"), F.col("o_near"), F.col("o_far")) <= F.col("reach") + _SLACK))
    single = reached.join(plan.select(*keys, "block", "other", "o_near", "o_far"), [*ids, "block"]).where(
        gap(F.col("far"), F.col("far"), F.col("o_near"), F.col("o_far")) <= F.col("reach") + _SLACK)
    asked = single.select(*plain.columns, F.col("block").alias("mine"), "other")
    rows = durable(whole.unionByName(placed.drop("far")))
    return rows, own(rows).unionByName(asked)


def _compared(rows: DataFrame, asked: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """`(keys, a, b, d)`: for each row of `asked` the k nearest in its other block, a task for each pair of blocks."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    cells = asked.select(*keys, "mine", "other").distinct()
    offered = rows.select(*keys, F.col("block").alias("other"), "node", "vec").join(cells, [*keys, "other"])

    def best(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asking, there = rows[rows["asks"]], rows[~rows["asks"]]
        if asking.empty or there.empty:
            return pd.DataFrame()
        ids_q, ids_o = asking["node"].to_numpy(), there["node"].to_numpy()
        order, distance = _nearest(np.stack(asking["vec"].to_numpy()).astype(float), np.stack(there["vec"].to_numpy()).astype(float), ids_q, ids_o, k)
        out = pd.DataFrame({"a": np.repeat(ids_q, order.shape[1]), "b": ids_o[order].ravel(), "d": distance.ravel()})
        out = out[np.isfinite(out["d"])]
        if out.empty:
            return pd.DataFrame()
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "a", "b", "d"]]

    both = asked.withColumn("asks", F.lit(True)).unionByName(offered.withColumn("asks", F.lit(False)))
    return both.groupBy(*keys, "mine", "other").applyInPandas(best, f"{kinds}, a long, b long, d double")


def reachability(near: DataFrame, keys: tuple[str, ...], min_cluster_size: int) -> DataFrame:
    """Undirected edges `(keys, a, b, w)` with a < b, weighted by mutual reachability."""
    per_node = near.groupBy(*keys, "a").agg(
        F.max(F.when(F.col("rank") <= min_cluster_size, F.col("d"))).alias("core"))
    core = per_node.select(*keys, F.col("a").alias("node"), "core")
    pairs = near.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min("d").alias("d"))
    for side in ("a", "b"):
        pairs = pairs.join(
            core.withColumnsRenamed({"node": side, "core": f"core_{side}"}), [*keys, side])
    return pairs.select(*keys, "a", "b", F.greatest("core_a", "core_b", "d").alias("w"))


def scale_of(edges: DataFrame, keys: tuple[str, ...], levels: int) -> DataFrame:
    """`eps` per run: the levels' distances, log-spaced from loose to tight."""
    share = [i / (levels - 1) for i in range(levels)]
    bounds = edges.groupBy(*keys).agg(F.max("w").alias("hi"), F.min("w").alias("lo"))
    low = F.greatest(F.col("lo"), F.col("hi") / 1000, F.lit(_TINY))
    return bounds.select(*keys, F.array(*[
        F.col("hi") if s == 0 else F.when(
            F.col("hi") > _TINY, F.col("hi") * F.pow(low / F.col("hi"), F.lit(s))).otherwise(F.col("hi"))
        for s in share]).alias("eps"))


def _pieces(tree: DataFrame, scale: DataFrame, keys: tuple[str, ...], levels: int) -> DataFrame:
    """`(keys, node, comp, lo, hi, up)`: the levels at which a node's component bears which name, and the name that comes next.

    A node climbs its path in the merge tree as far as the level's distance allows, so a name holds for a span of levels, and a node has
    as many spans as its path has steps that differ, however many levels there are.
    """
    step = tree.join(scale, list(keys)).select(
        *keys, "node", F.concat(
            F.array(F.struct(F.struct(F.lit(0).alias("turn"), F.col("node").alias("id")).alias("comp"), F.lit(levels - 1).alias("hi"))),
            F.transform("path", lambda x, i: F.struct(
                F.struct((i + 1).alias("turn"), x["comp"].alias("id")).alias("comp"),
                (F.size(F.filter("eps", lambda e: e >= x["w"])) - 1).alias("hi")))).alias("steps"))
    spans = F.transform("steps", lambda x, i: F.struct(
        x["comp"].alias("comp"), F.when(i + 1 < F.size("steps"), F.get(F.col("steps"), i + 1)["hi"] + 1).otherwise(F.lit(0)).alias("lo"), x["hi"].alias("hi")))
    real = step.select(*keys, "node", F.filter(spans, lambda x: x["lo"] <= x["hi"]).alias("spans"))
    each = real.select(*keys, "node", F.posexplode("spans").alias("at", "span"), "spans")
    return each.select(*keys, "node", "span.comp", "span.lo", "span.hi", F.get("spans", F.col("at") + 1)["comp"].alias("up"))


def _condense(pieces: DataFrame, scale: DataFrame, sizes: DataFrame, keys: tuple[str, ...], levels: int,
              min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """(path: which cluster a node belongs to from which level on, tree: one row per cluster).

    All members leave a component at one level and join it at their own, so a histogram of these levels tells down to which level it
    has enough members; a cluster starts at a root and wherever a component parts into two or more that are large enough.
    """
    ids = list(keys)
    joined = pieces.groupBy(*keys, "comp", "hi").agg(F.count("*").alias("n"), F.max("lo").alias("lo"), F.max("up").alias("up"))
    so_far = F.sum("n").over(Window.partitionBy(*keys, "comp").orderBy(F.desc("hi")))
    large = joined.withColumn("size", so_far).where(F.col("size") >= min_cluster_size).groupBy(*keys, "comp").agg(
        F.max("hi").alias("tight"), F.max("lo").alias("lo"), F.max("up").alias("up"))
    large = durable(large)
    born = large.where("up IS NOT NULL").groupBy(*keys, F.col("up").alias("comp"), F.col("lo").alias("level")).agg(F.count("*").alias("children"))
    parted = born.join(large.select(*keys, "comp", "tight"), [*ids, "comp"]).withColumn("stays", F.col("tight") >= F.col("level")).where(
        F.col("children") + F.col("stays").cast("int") >= 2)
    parted = durable(parted.select(*keys, "comp", "level", "stays"))
    child = large.join(parted.select(*keys, F.col("comp").alias("up"), F.col("level").alias("lo")), [*ids, "up", "lo"], "left_semi")
    starts = large.where("up IS NULL").select(*keys, "comp", F.col("lo").alias("level")).unionByName(
        child.select(*keys, "comp", F.col("lo").alias("level"))).unionByName(parted.where("stays").select(*keys, "comp", "level"))
    listed = starts.groupBy(*keys, "comp").agg(F.collect_set("level").alias("levels"))  # at most one for each level
    known = large.select(*keys, "comp", "tight").join(listed, [*ids, "comp"], "left")
    mine = pieces.select(*keys, "node", "comp", "lo", "hi").join(known, [*ids, "comp"]).where("lo <= tight").withColumn(
        "hi", F.least("hi", "tight"))
    begins = F.transform(F.filter("levels", lambda x: (x >= F.col("lo")) & (x <= F.col("hi"))), lambda x: F.struct(
        x.alias("birth"), F.col("comp").alias("name")))
    walked = mine.groupBy(*keys, "node").agg(
        F.max("hi").alias("last"), F.array_sort(F.flatten(F.collect_list(F.coalesce(begins, F.array())))).alias("begins"))
    each = walked.select(*keys, "node", "last", "begins", F.posexplode("begins").alias("at", "b"))
    path = durable(each.select(
        *keys, "node", "b.birth", "b.name", F.coalesce(F.get("begins", F.col("at") + 1)["birth"] - 1, F.col("last")).alias("leave"),
        F.get("begins", F.col("at") - 1).alias("up")))
    rate = lambda level: 1.0 / F.greatest(F.get("eps", level), F.lit(_TINY))
    gain = rate(F.least(F.col("leave") + 1, F.lit(levels - 1))) - rate(F.col("birth"))
    tree = path.join(scale, ids).withColumn("gain", gain).groupBy(*keys, "birth", "name").agg(
        F.sum("gain").alias("stability"), F.count("*").alias("size"), F.max("up").alias("up"))
    tree = tree.join(sizes, ids).select(
        *keys, "birth", "name", "up.birth", "up.name", "stability", (F.col("size") < F.col("_n")).alias("allowed")
    ).toDF(*keys, "birth", "name", "up_birth", "up_name", "stability", "allowed")
    return path, durable(tree)


def _winners(tree: DataFrame, keys: tuple[str, ...], levels: int, held: int) -> DataFrame:
    """`(keys, birth, name)` of clusters that beat what their children reach together.

    From the leaves up, one step for each level that clusters of a large tree start at; the trees of the other runs, up to `held` clusters
    each, are walked in one task per run.
    """
    ids = list(keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tree.schema if f.name in keys)
    counts = tree.groupBy(*keys).agg(F.count("*").alias("_clusters"))
    large = durable(counts.where(F.col("_clusters") > held))

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        below: dict[tuple, float] = {}
        won = []
        columns = (rows[c].tolist() for c in ("birth", "turn", "id", "up_birth", "up_turn", "up_id", "stability", "allowed"))
        for birth, turn, node, *up, stability, allowed in sorted(zip(*columns, strict=True), key=lambda r: -r[0]):
            reached = below.get((birth, turn, node), 0.0)
            won.append(allowed and stability >= reached)
            if up[0] == up[0]:  # not NaN: it has a parent
                over = tuple(int(v) for v in up)
                below[over] = below.get(over, 0.0) + max(stability if allowed else 0.0, reached)
            won[-1] = (*key, birth, turn, node) if won[-1] else None
        return pd.DataFrame([w for w in won if w], columns=[*keys, "birth", "turn", "id"])

    small = tree.join(large.select(*keys), ids, "left_anti").select(
        *keys, "birth", "name.turn", "name.id", "up_birth", F.col("up_name.turn").alias("up_turn"), F.col("up_name.id").alias("up_id"), "stability", "allowed")
    won = small.groupBy(*keys).applyInPandas(walk, f"{kinds}, birth int, turn int, id long").select(
        *keys, "birth", F.struct("turn", "id").alias("name"))
    if large.isEmpty():
        return won
    own = F.when(F.col("allowed"), F.col("stability")).otherwise(F.lit(0.0))
    best = durable(tree.join(large.select(*keys), ids).withColumns({"best": own, "below": F.lit(0.0)}))
    for birth in sorted((r[0] for r in best.select("birth").distinct().collect()), reverse=True):  # one of the levels each
        if birth == 0:
            break
        below = best.where(F.col("birth") == birth).where("up_birth IS NOT NULL").groupBy(*keys, "up_birth", "up_name").agg(
            F.sum("best").alias("_below")).toDF(*keys, "birth", "name", "_below")
        reached = F.col("below") + F.coalesce("_below", F.lit(0.0))
        best = durable(best.join(below, [*ids, "birth", "name"], "left").withColumns({
            "below": reached, "best": F.greatest(own, reached)}).drop("_below"))
    return won.unionByName(best.where(F.col("allowed") & (F.col("stability") >= F.col("below"))).select(*keys, "birth", "name"))


def density_cluster(points: DataFrame, keys: tuple[str, ...], vec: str = "reduced", pos: str = "pos",
                    min_cluster_size: int = 5, levels: int = 40, block_rows: int = BLOCK_ROWS, held: int = HELD) -> DataFrame:
    """Add `label` (-1 is noise, else 0, 1, .. by the position of the first member).

    `pos` must be unique inside a run; the order of the input has no effect. `block_rows` and `held` bound what a task holds and do not
    change the result.
    """
    ids = list(keys)
    points = durable(points)
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    near = durable(neighbours(points, keys, pos, vec, max(15, min_cluster_size), block_rows))
    edges = durable(reachability(near, keys, min_cluster_size))
    scale = durable(scale_of(edges, keys, levels))
    tree, _ = merge_tree(edges, keys, held)
    pieces = durable(_pieces(tree, scale, keys, levels))
    path, clusters = _condense(pieces, scale, sizes, keys, levels, min_cluster_size)
    winners = _winners(clusters, keys, levels, held)
    chosen = durable(path.join(winners, [*ids, "birth", "name"]).groupBy(*keys, "node").agg(F.min(F.struct("birth", "name")).alias("cluster")))
    first = chosen.groupBy(*keys, "cluster").agg(F.min("node").alias("_first"))
    numbered = first.withColumn(
        "label", (F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).cast("int"))
    labels = chosen.join(numbered, [*ids, "cluster"]).select(*keys, F.col("node").alias(pos), "label")
    return points.join(labels.withColumn(pos, F.col(pos).cast(points.schema[pos].dataType)), [*ids, pos], "left"
                       ).withColumn("label", F.coalesce("label", F.lit(NOISE))).select(*points.columns, "label")
