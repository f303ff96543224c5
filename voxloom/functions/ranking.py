"""Positions and running totals inside a key, also when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.session import durable


def top_n(df: DataFrame, keys: tuple[str, ...], order: list[Column], n: int, name: str = "pos") -> DataFrame:
    """The first `n` rows per key with their position.

    Spark keeps at most `n` rows per key in every task before it shuffles (WindowGroupLimit),
    so a hot key does not reach one task whole.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= n)


def position(df: DataFrame, keys: tuple[str, ...], order: list[Column], name: str = "pos") -> DataFrame:
    """Exact 1-based position of every row inside its key.

    A window over the key would sort a hot key in one task. Here rows are range-partitioned by
    key and order, so a hot key spans many tasks; positions inside a slice are shifted by the
    sizes of the earlier slices. The slices are checkpointed since both steps must see the same.
    """
    return _shifted(df, keys, order, {name: (F.lit(1), 0)})


def total_before(df: DataFrame, keys: tuple[str, ...], order: list[Column], value: Column,
                 name: str = "total_before") -> DataFrame:
    """Exact sum of `value` over the earlier rows of the same key, with the same slicing."""
    return _shifted(df, keys, order, {name: (value, -1)})


def _shifted(df: DataFrame, keys: tuple[str, ...], order: list[Column],
             sums: dict[str, tuple[Column, int]]) -> DataFrame:
    valued = df.withColumns({f"_v_{n}": v.cast("long") for n, (v, _) in sums.items()})
    ranged = valued.repartitionByRange(*[F.col(k) for k in keys], *order)
    sliced = durable(ranged.withColumn("_slice", F.spark_partition_id()))
    sizes = sliced.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k_slice"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    local = sliced.withColumns({
        f"_l_{n}": F.coalesce(
            F.sum(f"_v_{n}").over(inside.rowsBetween(Window.unboundedPreceding, upto)), F.lit(0))
        for n, (_, upto) in sums.items()})
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(shifts, same)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])
