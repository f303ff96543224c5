"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream: its documents in a shuffled order, repeated, cut into blocks of equally many words. Slot i of the mix belongs to the
source in whose part of the cumulative target shares the point frac(i * golden ratio) lies, so every stretch of the mix has the
target shares to within a few slots. Slots are ranked per source, and the k-th slot of a source reads its k-th block. A source
reads exactly its target: slots beyond it are dropped, and what the schedule leaves short (a few blocks) follows at the end.

Running word counts inside a source (also one with a third of all documents) and ranks of slots come from slices that are summed on their
own and then shifted; only the table of sources, one row each, is handled as a whole on the driver.

Defined results: null and blank texts have size 0 and are never taken; a null source is a source, the last; rows that share an id are
documents of their own; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.functions.ranking import total_before
from voxloom.llm import kernels as K
from voxloom.session import durable

GOLDEN = (5 ** 0.5 - 1) / 2
#: Slots that one row of the schedule stands for until it is spelled out.
CHUNK = 1 << 14


def fill(sizes: list[int], weights: list[float], most: int) -> list[float]:
    """Targets that share the sum of all sizes by weight, none above `most` times its size; the excess goes to the others by weight."""
    total = sum(sizes)
    order = sorted(range(len(sizes)), key=lambda s: most * sizes[s] / weights[s])
    left, weight, level = total, sum(weights), 0.0
    for s in order:
        level = left / weight
        if most * sizes[s] / weights[s] >= level:
            break
        left -= most * sizes[s]
        weight -= weights[s]
    return [min(float(most * n), w * level) for n, w in zip(sizes, weights, strict=True)]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block: int = 512, seed: str = "mix",
        id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents with what the mix takes of each, and the pieces of the mix in order.

    First: `doc_id, source, size, source_size, target, taken` per row of `docs`. Second: `slot, source, rank, doc_id, start, stop`:
    words `start` to `stop` of a document, in the order of slot and place.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    sized = durable(slim.mapInArrow(_sizes, "doc_id long, source string, size long").withColumn("row", F.monotonically_increasing_id()))
    sources = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in sources]
    targets = fill(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], most) if sum(sizes) else [0.0] * len(sizes)
    reads = [min(int(np.floor(t + 0.5)), most * n) for t, n in zip(targets, sizes, strict=True)]
    plan = spark.createDataFrame(
        [(r["source"], i, r["size"], t, n) for i, (r, t, n) in enumerate(zip(sources, targets, reads, strict=True))],
        "owner string, number int, source_size long, target double, reads long")
    shuffled = total_before(
        sized.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))),
        ("source",), [F.col("draw"), F.col("doc_id"), F.col("size"), F.col("row")], F.col("size"), "begin")
    placed = durable(shuffled.join(plan, F.col("source").eqNullSafe(F.col("owner"))).select(
        "row", "doc_id", "source", "size", "begin", "number", "source_size", "target", "reads"))
    pieces = _pieces(placed, block)
    slots = _schedule(spark, [-(-n // block) for n in reads])
    mixed = pieces.join(slots, ["number", "rank"])
    taken = mixed.groupBy("row").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    each = placed.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return each, mixed.select("slot", "source", "rank", "doc_id", "start", "stop", "place")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.diff(K.words(part)[2]) for part in K.slices(batch.column(2))]
        size = np.concatenate([*counts, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64())], names=["doc_id", "source", "size"])


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """Each pass of its source over a document, cut at the blocks of the stream: words `start` to `stop` in block `rank`."""
    passes = F.ceil((F.col("reads") - F.col("begin")) / F.col("source_size"))
    passed = placed.where((F.col("size") > 0) & (F.col("begin") < F.col("reads"))).select(
        "*", F.explode(F.sequence(F.lit(0), passes - 1)).alias("turn"))
    at = passed.withColumn("place", F.col("begin") + F.col("turn") * F.col("source_size"))
    end = F.least(F.col("place") + F.col("size"), "reads")
    cut = at.withColumn("end", end).where("end > place").select("*", F.explode(F.sequence(
        F.floor(F.col("place") / block), F.floor((F.col("end") - 1) / block))).alias("rank"))
    return cut.select(
        "row", "doc_id", "source", "number", "rank", "place", (F.greatest("place", F.col("rank") * block) - F.col("place")).alias("start"),
        (F.least("end", (F.col("rank") + 1) * block) - F.col("place")).alias("stop"))


def _schedule(spark, quotas: list[int]) -> DataFrame:
    """`slot, number, rank` for as many slots of every source as its quota."""
    total = sum(quotas)
    edges = np.cumsum(quotas) / max(total, 1)

    def owners(chunk: int) -> np.ndarray:
        points = (np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, total)) * GOLDEN) % 1
        return np.searchsorted(edges, points, "right").clip(max=len(quotas) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                number, n = np.unique(owners(chunk), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), chunk)), pa.array(number.astype(np.int32)), pa.array(n)], names=["chunk", "number", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = owners(chunk)
                rank = np.empty(len(own), np.int64)
                for pair in before:
                    mine = np.flatnonzero(own == pair["number"])
                    rank[mine] = pair["before"] + np.arange(len(mine))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk * CHUNK + np.arange(len(own))), pa.array(own.astype(np.int32)), pa.array(rank)],
                    names=["slot", "number", "rank"])

    counts = durable(spark.range(-(-total // CHUNK)).mapInArrow(count, "chunk long, number int, n long"))
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))
    spelled = before.groupBy("chunk").agg(F.collect_list(F.struct("number", "before")).alias("before")).mapInArrow(
        spell, "slot long, number int, rank long")
    quota = spark.createDataFrame(list(enumerate(quotas)), "number int, quota long")
    within = spelled.join(quota, "number").where("rank < quota").drop("quota")
    had = counts.groupBy("number").agg(F.sum("n").alias("had"))
    short = quota.join(had, "number", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).where("had < quota").select(
        "number", "had", F.explode(F.sequence(F.col("had"), F.col("quota") - 1)).alias("rank"))
    # appended slots of a source are spread over the tail by their rank, then by source
    tail = short.select((F.lit(total) + (F.col("rank") - F.col("had")) * len(quotas) + F.col("number")).alias("slot"), "number", "rank")
    return within.unionByName(tail)


def oracle_sql(weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> str:
    """The first result of `mix` as SQL: a source's reads go through its shuffled documents from the front."""
    weight = "CASE " + " ".join(f"WHEN (n - 1) % {len(weights)} = {i} THEN {w}" for i, w in enumerate(weights)) + " END"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST({weight} AS DOUBLE) AS w FROM s),
r AS (SELECT *, {most} * source_size / w AS full_at, sum(source_size) OVER () AS total FROM w),
c AS (SELECT *, (total - coalesce(sum({most} * source_size) OVER (ORDER BY full_at, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY full_at, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT arg_min(level, (full_at, n)) AS level FROM c WHERE full_at >= level),
t AS (SELECT source, source_size, least(CAST({most} * source_size AS DOUBLE), w * l.level) AS target FROM c, l),
p AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), {most} * source_size) AS reads FROM t),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.reads, coalesce(CAST(sum(size) OVER (PARTITION BY d.source
  ORDER BY md5(concat('{seed}-', coalesce(CAST(doc_id AS VARCHAR), ''))), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begin
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE CAST(size * (reads // source_size)
  + greatest(0, least(size, reads % source_size - begin)) AS BIGINT) END AS taken FROM o"""
