"""Documents as `id, sub, text`: what joins back to a text, also where ids are null or repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Stands for a null id: such documents come after all others.
NO_ID = 2**63 - 1
#: Bits of a text's fingerprint in `sub`, which tells apart different texts under one id.
SUB_BITS = 20


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """All operators that join positions back to texts use this one projection, so one exchange of the texts serves all joins."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(whole).bitwiseAND(2**SUB_BITS - 1).cast("int").alias("sub"), whole.alias("text"), *more)


def named(id: str = "id") -> Column:
    return F.when(F.col(id) != NO_ID, F.col(id))


def lists(column: pa.Array, lo: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and row numbers (from 0) of the lists in rows `lo` to `lo + n`; a null list is empty."""
    column = column.slice(lo, n)
    sizes = np.array(column.value_lengths().fill_null(0))
    return np.array(column.flatten()), np.repeat(np.arange(n), sizes)
