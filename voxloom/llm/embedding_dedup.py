"""Embedding near-dedup: tiles along the principal axes, partial products first, the rest only where the cosine can still reach the threshold.

Equal vectors of a label are one class with a count. Unit vectors are turned onto principal axes (fitted on a bounded sample; any
rotation keeps products, so the fit only decides how early products stop). Classes of a label are ordered by their first coordinate and
cut into tiles of bounded size, however large the label. Two unit vectors whose cosine reaches t are at most sqrt(2 - 2t) apart in
every subset of coordinates, which rules out pairs of tiles by the bounds of their leading coordinates. A task takes one pair of tiles: it
adds up leading coordinates a few at a time, bounds what is left by the product of the suffix norms, and drops pairs that cannot
reach t; the survivors are decided by the plain cosine in double precision. A task hands on counts per class and a spanning forest, never
pairs, so a dense group of any size sends a number of rows in proportion to its classes.

Defined results: a vector that is null, empty, zero, or has null or non-finite parts links with nothing, and so does one whose label is null;
vectors of different lengths do not link; a null id has no links, a null component and is kept; rows that share an id are one node and
count as vectors each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxloom.functions.ranking import position, top_n
from voxloom.llm.components import components
from voxloom.session import durable

#: Vectors per length on which the axes are fitted; classes of a tile; leading coordinates that bound a tile and that are added at a time.
SAMPLE, TILE, LEAD = 4096, 2048, 8
#: Slack of the bounds for rounding; the decision itself has none.
EPSILON = 1e-9


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """`vec_id, n_links, component_id, kept` per row of `vectors`."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    sound = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.exists("v", lambda x: x != 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = rows.where(sound)
    classes = durable(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("d", F.size("v")))
    axes = _axes(classes)
    led = classes.mapInArrow(lambda batches: (_lead(b, axes) for b in batches), f"{_type(classes, 'label')}, d int, id long, n long, v array<double>, lead array<double>")
    placed = position(led, ("d", "label"), [F.col("lead")[0], F.col("id")]).withColumn("tile", F.floor((F.col("pos") - 1) / TILE))
    tiles = placed.groupBy("d", "label", "tile").agg(*[
        f(F.coalesce(F.col("lead")[i], F.lit(0.0))).alias(f"{k}{i}") for i in range(LEAD) for k, f in (("lo", F.min), ("hi", F.max))])
    tiles = durable(tiles)
    other = tiles.select("d", "label", *[F.col(c).alias(f"o_{c}") for c in tiles.columns[2:]])
    apart = sum((F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"o_hi{i}"), F.col(f"o_lo{i}") - F.col(f"hi{i}")) ** 2
                 for i in range(LEAD)), F.lit(0.0))
    plan = durable(tiles.join(other, ["d", "label"]).where(
        (F.col("tile") <= F.col("o_tile")) & (apart <= 2 - 2 * threshold + EPSILON)).select("d", "label", "tile", "o_tile"))
    members = placed.select("d", "label", "tile", "id", "n", "v")
    left = plan.join(members, ["d", "label", "tile"]).withColumn("right", F.lit(False))
    right = plan.join(members.withColumnRenamed("tile", "o_tile"), ["d", "label", "o_tile"]).where("tile < o_tile").withColumn("right", F.lit(True))
    cells = left.unionByName(right).withColumn("d", F.col("d").cast("int"))
    found = durable(cells.groupBy("d", "label", "tile", "o_tile").applyInArrow(
        lambda table: _compare(table, axes, threshold), "id long, n_links long, other long"))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    classed = good.join(classes.select("label", "v", F.col("id").alias("first"), "n"), ["label", "v"]).select("id", "first", "n", "label", "v")
    links = found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(
        classed.select(F.col("first").alias("a"), F.col("id").alias("b")))
    grouped = components(links)
    valued = classed.join(counts.withColumnRenamed("id", "first"), "first", "left").select(
        "id", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    every = valued.unionByName(rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links")))
    return every.join(grouped, "id", "left").select(
        F.col("id").alias("vec_id"), "n_links", F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))


def _type(df: DataFrame, column: str) -> str:
    return f"{column} {df.schema[column].dataType.simpleString()}"


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length, most variance first."""
    some = top_n(classes.select("d", "v", "id"), ("d",), [F.xxhash64("id"), F.col("id")], SAMPLE).select("d", "v").toArrow()
    out = {}
    for d in set(some.column("d").to_pylist()):
        mine = some.filter(pa.compute.equal(some.column("d"), d)).column("v").combine_chunks()
        unit = _unit(mine, d)
        _, vectors = np.linalg.eigh(unit.T @ unit)
        out[d] = np.ascontiguousarray(vectors[:, ::-1])
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = _matrix(column, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps very large and very small vectors from over- and underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lead(batch: pa.RecordBatch, axes: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Add the leading coordinates on the principal axes."""
    sizes = np.array(batch.column("d"))
    order = np.argsort(sizes, kind="stable")
    batch = batch.take(pa.array(order))
    lead = []
    for d in np.unique(sizes).tolist():
        mine = batch.filter(pa.compute.equal(batch.column("d"), d))
        turned = _unit(mine.column("v"), d) @ axes[d][:, :LEAD]
        lead.append(np.pad(turned, ((0, 0), (0, LEAD - turned.shape[1]))))
    flat = np.concatenate([*lead, np.zeros((0, LEAD))])
    column = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, LEAD, dtype=np.int32), flat.ravel())
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "d", "id", "n", "v")), column],
                                      names=["label", "d", "id", "n", "v", "lead"])


def _compare(table: pa.Table, axes: dict[int, np.ndarray], threshold: float) -> pa.Table:
    """Counts and a spanning forest of the links between two tiles, or inside one."""
    d = table.column("d")[0].as_py()
    side = np.array(table.column("right"))
    ids, weight = np.array(table.column("id")), np.array(table.column("n"))
    unit = _unit(table.column("v").combine_chunks(), d)
    one = np.flatnonzero(~side)
    same = not side.any()
    two = one if same else np.flatnonzero(side)
    turned = unit @ axes[d]
    rest = np.sqrt(np.maximum(np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    rest = np.concatenate([rest, np.zeros((len(rest), 1))], axis=1)
    x, y = _candidates(turned[one], turned[two], rest[one], rest[two], threshold)
    x, y = one[x], two[y]
    if same:
        x, y = x[x < y], y[x < y]
    hit = np.zeros(len(x), bool)
    for lo in range(0, len(x), 1 << 16):
        hit[lo:lo + (1 << 16)] = np.einsum("ij,ij->i", unit[x[lo:lo + (1 << 16)]], unit[y[lo:lo + (1 << 16)]]) >= threshold
    x, y = x[hit], y[hit]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, x, weight[y])
    np.add.at(links, y, weight[x])
    a, b = _forest(x, y, len(ids))
    some = np.flatnonzero(links)
    return pa.table({
        "id": pa.array(np.concatenate([ids[some], ids[a]])),
        "n_links": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])),
        "other": pa.array([*[None] * len(some), *ids[b].tolist()], pa.int64())})


def _candidates(one: np.ndarray, two: np.ndarray, one_rest: np.ndarray, two_rest: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose product can reach the threshold: leading coordinates are added until none can, or few are left."""
    product = np.zeros((len(one), len(two)))
    d = one.shape[1]
    for lo in range(0, d, LEAD):
        hi = min(lo + LEAD, d)
        product += one[:, lo:hi] @ two[:, lo:hi].T
        alive = product + one_rest[:, hi][:, None] * two_rest[:, hi][None, :] >= threshold - EPSILON
        n = int(alive.sum())
        if n * 16 <= alive.size or hi == d:
            return np.nonzero(alive)
    return np.nonzero(product >= threshold - EPSILON)


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links connect."""
    root = np.arange(n)
    chosen = []
    left = np.arange(len(x))
    while len(left):
        a, b = root[x[left]], root[y[left]]
        left = left[a != b]
        if not len(left):
            break
        hi, lo = np.maximum(root[x[left]], root[y[left]]), np.minimum(root[x[left]], root[y[left]])
        seen, pick = np.unique(hi, return_index=True)  # one link for every root that is not the least of its link
        chosen.append(left[pick])
        root[seen] = lo[pick]
        while (root != root[root]).any():
            root = root[root]
    chosen = np.concatenate([*chosen, np.zeros(0, np.int64)]).astype(np.int64)
    return x[chosen], y[chosen]
