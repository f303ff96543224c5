"""Fewer dimensions per run: principal components from QR factors of blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Stacks of factors a run is gathered in before its last one, and rows that one product projects.
_PARTS, BLOCK_ROWS = 64, 8192


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The unit vectors of a list column, a row each."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten().cast(pa.float64()), np.float64).reshape(len(flat), -1)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0.0, 1.0, norms)


def _factor(rows: np.ndarray) -> np.ndarray:
    """An upper triangle that stands for rows (1, x): same products, never more rows than columns."""
    return rows if len(rows) <= rows.shape[1] else np.linalg.qr(rows, mode="r")


def _axes(stacked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the `k` directions of largest variance, with a fixed sign; directions without variance are zero.

    The column of ones comes first, so the triangle's first row holds the mean and what is below it belongs to the centred rows.
    """
    r = np.linalg.qr(stacked, mode="r")
    center = r[0, 1:] / r[0, 0]
    top = np.zeros((k, len(center)))
    if len(r) > 1:
        _, spread, found = np.linalg.svd(r[1:, 1:], full_matrices=False)
        found = found[:k][spread[:k] > 1e-12 * max(1.0, spread[0])]
        top[:len(found)] = found * np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])[:, None]
    return center, top


def _runs(batch: pa.RecordBatch | pa.Table, names: list[str]) -> Iterator[tuple[dict, pa.Table]]:
    """Rows of each run in a batch."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    table = table.append_column("_row", pa.array(np.arange(table.num_rows)))
    for run in table.group_by(names).aggregate([("_row", "list")]).to_pylist():
        yield {n: run[n] for n in names}, table.take(pa.array(run["_row_list"]))


def _named(keys: list[dict], schema: pa.Schema, names: list[str]) -> list[pa.Array]:
    return [pa.array([k[n] for k in keys], schema.field(n).type) for n in names]


def reduce_dims(points: DataFrame, keys: tuple[str, ...], vec: str = "embedding", k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `reduced`: the first `k` principal components of the unit vectors of each run.

    A map task hands on a triangle for each run it meets (or the rows themselves where they are fewer), so what is exchanged of a run is
    bounded by tasks times dimensions; triangles are stacked in up to 64 parts, then once per run. Rows are projected in blocks of bounded
    size, one matrix product each, so no task ever holds a large run.
    """
    names, columns = list(keys), points.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in keys)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % _PARTS
        for batch in batches:
            found, stacked = [], []
            for key, rows in _runs(batch, names):
                x = _matrix(rows.column(vec))
                found.append(key)
                stacked.append((len(x), _factor(np.hstack([np.ones((len(x), 1)), x]))))
            yield pa.RecordBatch.from_arrays([
                *_named(found, batch.schema, names), pa.array([part] * len(found), pa.int32()), pa.array([n for n, _ in stacked], pa.int64()),
                pa.array([r.shape[1] for _, r in stacked], pa.int32()), pa.array([r.tobytes() for _, r in stacked], pa.binary())],
                names=[*names, "part", "n", "width", "r"])

    def stack(table: pa.Table) -> tuple[int, np.ndarray]:
        width = table.column("width")[0].as_py()
        return pc.sum(table.column("n")).as_py(), np.concatenate([np.frombuffer(r, np.float64).reshape(-1, width) for r in table.column("r").to_pylist()])

    def again(table: pa.Table) -> pa.Table:
        n, r = stack(table)
        first = table.slice(0, 1).select([*names, "part"])
        r = _factor(r)
        return first.append_column("n", pa.array([n])).append_column("width", pa.array([r.shape[1]], pa.int32())).append_column(
            "r", pa.array([r.tobytes()], pa.binary()))

    def fit(table: pa.Table) -> pa.Table:
        n, r = stack(table)
        center, axes = _axes(r, k)
        return table.slice(0, 1).select(names).append_column("n", pa.array([n])).append_column(
            "center", pa.array([center.tobytes()], pa.binary())).append_column("axes", pa.array([axes.tobytes()], pa.binary()))

    def project(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        rows = rows.select(columns)
        if not rows.num_rows:
            return rows.append_column("reduced", pa.array([], pa.list_(pa.float64())))
        center = np.frombuffer(fitted.column("center")[0].as_py(), np.float64)
        axes = np.frombuffer(fitted.column("axes")[0].as_py(), np.float64).reshape(k, -1)
        out = (_matrix(rows.column(vec)) - center) @ axes.T
        return rows.append_column("reduced", pa.ListArray.from_arrays(np.arange(0, out.size + 1, k, dtype=np.int32), out.ravel()))

    triangles = f"{kinds}, part int, n long, width int, r binary"
    parts = points.select(*keys, vec).mapInArrow(factors, triangles).groupBy(*keys, "part").applyInArrow(again, triangles)
    fitted = parts.groupBy(*keys).applyInArrow(fit, f"{kinds}, n long, center binary, axes binary")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    sizes = fitted.select(*[F.col(c).alias(f"_{c}") for c in keys], blocks.alias("_blocks"))
    row = F.xxhash64(*[f.name for f in points.schema if "map<" not in f.dataType.simpleString()])
    same = [F.col(c) == F.col(f"_{c}") for c in keys]
    placed = points.join(sizes, same).withColumn("_block", F.pmod(row, F.col("_blocks")).cast("int")).select(*columns, "_block")
    dealt = fitted.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return placed.groupBy(*keys, "_block").cogroup(dealt.groupBy(*keys, "_block")).applyInArrow(project, f"{schema}, reduced array<double>")
