"""The registered queries: one per operator, with its equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return register


def when_text(when: Column | str) -> Column:
    """A time as text, equal in both engines."""
    return F.date_format(when, "yyyy-MM-dd HH:mm:ss")


def when_sql(when: str) -> str:
    return f"strftime({when}, '%Y-%m-%d %H:%M:%S')"


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


RUN_SQL = "product, CAST(iso_year AS BIGINT) AS iso_year, CAST(iso_week AS BIGINT) AS iso_week"


def run_columns() -> list[Column]:
    return [F.col("product"), F.col("iso_year").cast("long").alias("iso_year"),
            F.col("iso_week").cast("long").alias("iso_week")]
