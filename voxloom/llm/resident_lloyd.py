"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds over resident members.

Every vector becomes exact integers and is cut into equal consecutive parts. A part lives with the entry it is assigned to: its key is
(position, entry, salt), the salt being its block of the scan, so an entry that holds most parts is as many records as any scan has
blocks. The task that owns a key keeps its members: in a round it sums them (one sum for each entry leaves the task), gets the new
codebooks (positions x entries x width integers, the only thing the driver holds), and finds the nearest entry of each member. Members that
stay do so without a shuffle; only parts that change entry migrate, to the owners of their new key, and join what is resident there (a
union of equally partitioned RDDs). After every round the members are kept in the shared folder, which ends their lineage, and those of
the round before are deleted.

Defined results: rows whose vector is null or holds null or non-finite components are left out; vectors of another length than `dimensions`
have no parts: they are returned with null code and error; a vector with a null id is no starting entry; rows that share an id or are equal
count each; equal ids start in the order of their vectors; with fewer than `entries` vectors the codebooks have as many entries; an
empty table gives no rows. Integers are exact; an error or sum beyond a long is returned as the largest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F

from voxloom.llm.vectors import Kept, added, distances, first_vectors, long_sum, longs, narrow, owner, owners, packed, sound
from voxloom.session import durable

Books = dict[int, np.ndarray]


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, dimensions: int = 64, scale: int = 4096,
             id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """`vec_id, label, code, error, label_error, codebooks_sha256` per row with a sound vector; up to 256 entries, two hex digits a part."""
    if not 0 < entries <= 256 or dimensions % parts:
        raise ValueError("up to 256 entries, and parts of equal width")
    spark = vectors.sparkSession
    every = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(sound(F.col("v")))
    rows = every.where(F.size("v") == dimensions)
    width = dimensions // parts
    first = first_vectors(rows.where("id IS NOT NULL"), [F.col("id")], entries, scale)
    if not len(first):
        first = first_vectors(rows, [], entries, scale)  # no vector has an id, or there is none
    blocks = durable(packed(rows, scale, ("id", "label")))
    books = {p: first[:, p * width:(p + 1) * width] for p in range(parts)} if len(first) else {}
    codes, books = _fit(blocks, books, width, rounds)
    joined = blocks.select("block", "n", "id", "label").groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(
        lambda left, right: _coded(left, right, parts), f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")
    other = every.where(F.size("v") != dimensions).select(F.col("id").alias("vec_id"), "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    each = durable(joined.unionByName(other))
    totals = each.groupBy(F.col("label").alias("of")).agg(long_sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(str(int(v)) for p in range(parts) for v in (books[p].ravel() if books else ())).encode()).hexdigest()
    return each.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _fit(blocks: DataFrame, books: Books, width: int, rounds: int) -> tuple[DataFrame, Books]:
    """`block, position, entry, row, error` (one record for each resident piece of a block) and the final codebooks."""
    spark = blocks.sparkSession
    tasks = owners(spark, blocks.count() * sum(len(b) for b in books.values()))
    members = None
    for turn in range(rounds + 1):
        if members is None:  # nothing is resident yet: the scan deals all parts out
            every = blocks.select("block", "data").rdd.flatMap(lambda r, books=books: _dealt(r, books, width)).partitionBy(tasks, owner)
        else:
            stay = members.rdd.mapPartitions(lambda held, books=books: _moved(held, books, False), preservesPartitioning=True)
            go = members.rdd.mapPartitions(lambda held, books=books: _moved(held, books, True)).partitionBy(tasks, owner)
            every = stay.union(go).mapPartitions(_joined, preservesPartitioning=True)
        now = Kept(spark, every)
        if turn < rounds:
            books = _updated(now.rdd, books, tasks)
            if members is not None:
                members.drop()
        members, before = now, members
    found = members.rdd.map(lambda r, books=books: _priced(r, books))
    codes = durable(spark.createDataFrame(found, "block long, position int, entry int, row binary, error binary"))
    for old in (before, members):
        if old is not None:
            old.drop()
    return codes, books


def _pieces(position: int, block: int, row: np.ndarray, x: np.ndarray, book: np.ndarray, but: int | None = None) -> Iterator:
    """Records of the members that are nearest to each entry; without those of entry `but`."""
    nearest = np.argmin(distances(x, book), axis=1)  # ties: the lower index
    for entry in np.unique(nearest).tolist():
        if entry != but:
            mine = nearest == entry
            yield (position, entry, block), (row[mine], narrow(x[mine]))


def _dealt(record, books: Books, width: int) -> Iterator:
    x = pickle.loads(record.data)
    row = narrow(np.arange(len(x)))
    for position, book in books.items():
        yield from _pieces(position, record.block, row, x[:, position * width:(position + 1) * width], book)


def _moved(held: Iterator, books: Books, away: bool) -> Iterator:
    """Of the resident members those that go to another entry, or those that stay."""
    for (position, entry, block), (row, x) in held:
        if away:
            yield from _pieces(position, block, row, x, books[position], but=entry)
        else:
            mine = np.argmin(distances(x, books[position]), axis=1) == entry
            if mine.any():
                yield (position, entry, block), (row[mine], x[mine])


def _joined(held: Iterator) -> Iterator:
    """One record for each key: what was there and what has come. A task owns a bounded number of keys, and a key a part of one block."""
    found: dict[tuple[int, int, int], list] = {}
    for key, piece in held:
        found.setdefault(key, []).append(piece)
    for key, pieces in found.items():
        rows, x = zip(*pieces, strict=True)
        yield key, (np.concatenate(rows), np.concatenate(x)) if len(pieces) > 1 else pieces[0]


def _updated(members: RDD, books: Books, tasks: int) -> Books:
    """Each entry becomes the floor of the mean of its members; an entry without members stays."""
    def summed(held: Iterator) -> Iterator:
        totals: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for (position, entry, _), (row, x) in held:
            wide = x.astype(object if x.dtype == object else np.int64)
            n, total = totals.get((position, entry), (0, np.zeros(1, np.int64)))
            # a block has few rows, so its sum fits where its members are 32-bit integers
            mine = wide.sum(axis=0) if x.dtype in (np.int8, np.int16, np.int32) else x.astype(object).sum(axis=0)
            totals[position, entry] = n + len(row), added(total, mine)
        yield from totals.items()

    means = members.mapPartitions(summed).reduceByKey(lambda a, b: (a[0] + b[0], added(a[1], b[1])), min(tasks, max(1, sum(map(len, books.values())))), owner)
    replaced = {p: b.astype(object) for p, b in books.items()}
    for (position, entry), (n, total) in means.collect():
        replaced[position][entry] = total.astype(object) // n
    return {p: narrow(b) for p, b in replaced.items()}


def _priced(record, books: Books) -> tuple[int, int, int, bytes, bytes]:
    (position, entry, block), (row, x) = record
    error = distances(x, books[position][entry:entry + 1])[:, 0]
    return block, position, entry, pickle.dumps(row), pickle.dumps(error)


def _coded(left: pa.Table, right: pa.Table, parts: int) -> pa.Table:
    """The codes of a block's vectors, from the pieces of all positions."""
    n = sum(left.column("n").to_pylist())
    code = np.zeros((n, parts), np.uint8)
    error = np.zeros(n, object)
    for position, entry, row, cost in zip(*(right.column(c).to_pylist() for c in ("position", "entry", "row", "error")), strict=True):
        at = pickle.loads(row).astype(np.int64)
        code[at, position] = entry
        error[at] += pickle.loads(cost).astype(object)
    text = code.tobytes().hex()
    size = 2 * parts
    return pa.table({
        "vec_id": left.column("id").combine_chunks().flatten(), "label": left.column("label").combine_chunks().flatten(),
        "code": pa.array([text[i * size:(i + 1) * size] for i in range(n)], pa.string()), "error": pa.array(longs(error))})


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6, dimensions: int = 64, scale: int = 4096) -> str:
    """The same codes in DuckDB: components as rows, one pair of steps for each round."""
    width = dimensions // parts
    steps = ["""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)""",
             f"""x AS MATERIALIZED (SELECT r, i // {width} AS p, i % {width} AS i, CAST(floor({scale} * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x
        FROM kept, range({dimensions}) t(i) WHERE len(v) = {dimensions})""",
             f"""first AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS c FROM kept WHERE vec_id IS NOT NULL AND len(v) = {dimensions} QUALIFY c < {entries})""",
             "c0 AS MATERIALIZED (SELECT p, c, i, x FROM x JOIN first USING (r))"]
    for t in range(rounds + 1):
        steps.append(f"""d{t} AS MATERIALIZED (SELECT r, p, min_by(c, (d, c)) AS c, min(d) AS d FROM (
            SELECT x.r, x.p, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{t} c USING (p, i) GROUP BY ALL) GROUP BY r, p)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.p, c.c, c.i, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (
                SELECT x.p, d.c, x.i, CAST((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
                FROM x JOIN d{t} d USING (r, p) GROUP BY ALL) m USING (p, c, i))""")
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT r, string_agg(printf('%02x', CAST(c AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{rounds} GROUP BY r),
        books AS (SELECT sha256(coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, c, i), '')) AS h FROM c{rounds})
        SELECT vec_id, code, error, CAST(coalesce(sum(error) OVER (PARTITION BY label), 0) AS BIGINT) AS label_error, h AS codebooks_sha256
        FROM kept LEFT JOIN coded USING (r) CROSS JOIN books"""
