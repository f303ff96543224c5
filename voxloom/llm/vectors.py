"""Vectors of exact integers: scaled floors, squared distances without rounding, blocks of rows as binary, owners of RDD keys."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.session import shared_dir

#: The largest long; a distance or a sum beyond it counts as this.
MOST = (1 << 63) - 1
#: Rows of a block, and blocks that a task of an RDD should hold.
ROWS, HELD = 4096, 512


def sound(v: Column, dimensions: int | None = None) -> Column:
    """Whether a vector is there and all its components are finite numbers, and whether it has that many of them."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    right = F.size(v) == dimensions if dimensions else F.lit(True)
    return F.coalesce(v.isNotNull() & right & whole, F.lit(False))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact also where that is beyond an integer's range (Python integers then)."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not x.size or np.abs(y).max() < 1 << 53:
        return y.astype(np.int64)
    near = np.abs(x) < 1 << 52  # a double beyond that is an integer itself; `scale` times others may need more digits than it has
    low = np.floor(np.where(near, x, 0) * scale)
    return np.array([int(a) if n else int(b) * scale for a, b, n in zip(low.ravel(), x.ravel(), near.ravel(), strict=True)], object).reshape(x.shape)


def reach(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    most = reach(x)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        if most <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype(object)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of rows to centres, in the smallest arithmetic that cannot round or overflow."""
    bound = x.shape[1] * (reach(x) + reach(centres)) ** 2
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < MOST else object
    x, centres = x.astype(kind), centres.astype(kind)
    found = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    return narrow(found if kind is object else found.astype(np.int64))


def added(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact sum of two arrays of integers."""
    kind = object if reach(one) + reach(two) > MOST else np.int64
    return narrow(one.astype(kind) + two.astype(kind))


def sums(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact componentwise sum of the rows of each label."""
    n = np.bincount(label, minlength=k)
    if reach(x) * max(1, len(x)) < 1 << 53:
        member = np.zeros((k, len(x)))
        member[label, np.arange(len(x))] = 1
        return n, (member @ x.astype(np.float64)).astype(np.int64)
    total = np.zeros((k, x.shape[1]), object)
    for i, c in enumerate(label):
        total[c] += x[i].astype(object)
    return n, total


def longs(x: np.ndarray) -> np.ndarray:
    """As longs; what is larger counts as the largest long."""
    return np.array([min(int(v), MOST) for v in x], np.int64) if x.dtype == object else x.astype(np.int64)


def long_sum(column: str) -> Column:
    """Sum of non-negative longs, 0 if there are none; the largest long where it is larger."""
    total = F.coalesce(F.sum(F.col(column).cast("decimal(19,0)")), F.lit(0).cast("decimal(19,0)"))
    return F.least(total, F.lit(MOST).cast("decimal(19,0)")).cast("long")


def packed(rows: DataFrame, scale: int, keep: tuple[str, ...]) -> DataFrame:
    """Blocks of up to ROWS rows of `rows` (vector column `v`): `block long, n int, data binary`, and a list of each column of `keep`.

    Blocks follow the scan, so nothing is shuffled and a frequent value spreads over all blocks. Store the result before it is used
    twice: blocks of a scan that is done again could hold other rows.
    """
    kept = [rows.schema[c] for c in keep]
    fields = "".join(f", {f.name} array<{f.dataType.simpleString()}>" for f in kept)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                v = some.column("v")
                x = np.asarray(v.flatten().cast(pa.float64()), np.float64).reshape(some.num_rows, -1)
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), pa.concat_arrays([some.column(c)])) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.array([some.num_rows], pa.int32()), pa.array([pickle.dumps(narrow(scaled(x, scale)))], pa.binary()), *lists],
                    names=["block", "n", "data", *keep])
                at += 1

    return rows.select("v", *keep).mapInArrow(pack, f"block long, n int, data binary{fields}")


def first_vectors(rows: DataFrame, order: list[Column], k: int, scale: int) -> np.ndarray:
    """The first `k` vectors in an order, as integers; `k` is a parameter, so they are few."""
    some = rows.orderBy(*order, "v").limit(k).select("v").toArrow().column("v").to_pylist()
    return narrow(scaled(np.array(some, np.float64).reshape(len(some), -1), scale)) if some else np.zeros((0, 1), np.int64)


def owner(key: tuple[int, ...]) -> int:
    """A number for an RDD's key of integers that spreads neighbouring keys."""
    h = 0
    for part in key:
        h = (h ^ part) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def owners(spark: SparkSession, records: int) -> int:
    """Partitions of an RDD of so many blocks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records // HELD))


class Kept:
    """An RDD whose lineage ends in the shared folder, until `drop`."""

    def __init__(self, spark: SparkSession, rdd: RDD):
        shared_dir(spark)
        self.spark, self.rdd = spark, rdd.persist(StorageLevel.DISK_ONLY)
        self.rdd.checkpoint()

    def drop(self) -> None:
        path = self.rdd.getCheckpointFile()
        self.rdd.unpersist()
        if path:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
