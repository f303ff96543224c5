"""Centroid clustering: Lloyd rounds over column blocks.

Vectors become exact integers and are cut into column shards; a shard's rows lie in blocks, dealt once to the tasks that keep working on
them (key: block and shard). In each round a task adds up the squared distances of its columns to its slice of the centroids;
`reduceByKey` adds the shards of a block and takes the nearest centroid. The labels (one small integer a vector) go back to the tasks of the
shards, where each shard sums its own columns by label and replaces its own slice. The shards themselves are shuffled once; a round sends
partial distances and labels. The driver holds the centroids, `k` times `dimensions` integers, and nothing that grows with the rows: what a
round hands to the next are those numbers, so there is no lineage to cut. A centroid that holds most rows is as spread as any other, since
tasks go by blocks of the scan and sums are combined in them.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; vectors with a null id
take part but are no starting centroid; rows that share an id or are equal count as vectors each, equal hashes start in the order
of their vectors; with fewer than `k` vectors there are as many centroids as vectors; an empty table gives no rows. Integers of any size are
exact; a distance or sum beyond a long is returned as the largest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F

from voxloom.llm.vectors import added, distances, first_vectors, long_sum, longs, narrow, owner, owners, packed, sound, sums
from voxloom.session import durable

#: Column blocks that the components are cut into.
SHARDS = 4


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, salt: str = "1",
            id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid` per vector of the right length."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(sound(F.col("v"), dimensions))
    starts = rows.where("id IS NOT NULL")
    centres = first_vectors(starts, [F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)], k, scale)
    if not len(centres) and not rows.isEmpty():
        centres = first_vectors(rows, [], k, scale)  # no vector has an id
    if not len(centres):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<decimal(38,0)>")
    blocks = durable(packed(rows, scale, ("id",)))
    cuts = np.array_split(np.arange(dimensions), min(SHARDS, dimensions))
    tasks = owners(spark, blocks.count() * len(cuts))
    shards = blocks.select("block", "n", "data").rdd.flatMap(lambda r: _cut(r, cuts)).partitionBy(tasks, owner)
    for _ in range(rounds):
        nearest = _nearest(shards, centres, cuts, tasks).mapValues(lambda found: found[0])
        centres = _updated(shards, nearest, centres, cuts, tasks)
    found = _nearest(shards, centres, cuts, tasks).map(lambda r: (r[0][0], pickle.dumps(r[1][0]), pickle.dumps(r[1][1])))
    labelled = blocks.select("block", "id").join(spark.createDataFrame(found, "block long, label binary, distance binary"), "block")
    each = durable(labelled.mapInArrow(_rows, "vec_id long, cluster int, distance long"))
    text = [",".join(str(int(v)) for v in c) for c in centres]
    named = spark.createDataFrame([(i, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in enumerate(text)], "cluster int, centroid_sha256 string, centroid string")
    totals = each.groupBy("cluster").agg(long_sum("distance").alias("cluster_inertia"))
    whole = totals.select(long_sum("cluster_inertia").alias("inertia"))
    # one row for each of the k centroids, and one row
    small = named.join(totals, "cluster").crossJoin(F.broadcast(whole))
    return each.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
        F.split("centroid", ",").cast("array<decimal(38,0)>").alias("centroid"))


def _cut(row, cuts: list[np.ndarray]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    x = pickle.loads(row.data)
    for shard, columns in enumerate(cuts):
        yield (row.block, shard), narrow(np.ascontiguousarray(x[:, columns]))


def _nearest(shards: RDD, centres: np.ndarray, cuts: list[np.ndarray], tasks: int) -> RDD:
    """(block,) and the number and distance of the nearest centroid of each row; ties go to the smaller number."""
    slices = [centres[:, columns] for columns in cuts]

    def least(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = np.argmin(total, axis=1)
        return narrow(label), total[np.arange(len(total)), label]

    partial = shards.map(lambda r: ((r[0][0],), distances(r[1], slices[r[0][1]])))
    return partial.reduceByKey(added, tasks, owner).mapValues(least)


def _updated(shards: RDD, nearest: RDD, centres: np.ndarray, cuts: list[np.ndarray], tasks: int) -> np.ndarray:
    """The centroids after each shard has replaced its slice by the floors of its means."""
    k, n_cuts = len(centres), len(cuts)
    sent = nearest.flatMap(lambda r: [((r[0][0], shard), r[1]) for shard in range(n_cuts)]).partitionBy(tasks, owner)

    def summed(records: Iterator) -> Iterator[tuple[tuple[int, int], tuple[int, np.ndarray]]]:
        """A task's labels come first, then the shards that have been there all along; nothing but one sum for each centroid leaves it."""
        labels: dict[tuple[int, int], np.ndarray] = {}
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for key, x in records:
            if x.ndim == 1:
                labels[key] = x
                continue
            n, total = sums(x, labels.pop(key).astype(np.int64), k)
            if key[1] in totals:
                n, total = n + totals[key[1]][0], added(total, totals[key[1]][1])
            totals[key[1]] = n, total
        for shard, (n, total) in totals.items():
            for c in np.flatnonzero(n):
                yield (shard, int(c)), (int(n[c]), narrow(total[c]))

    means = sent.union(shards).mapPartitions(summed).reduceByKey(lambda a, b: (a[0] + b[0], added(a[1], b[1])), min(tasks, k * n_cuts), owner)
    replaced = centres.astype(object)
    for (shard, c), (n, total) in means.collect():
        replaced[c, cuts[shard]] = total.astype(object) // n
    return narrow(replaced)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            label, distance = (pickle.loads(batch.column(c)[i].as_py()) for c in ("label", "distance"))
            yield pa.RecordBatch.from_arrays([
                batch.column("id")[i].values, pa.array(label.astype(np.int32)), pa.array(longs(distance))], names=["vec_id", "cluster", "distance"])


def oracle_sql(k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, salt: str = "1") -> str:
    """The same clusters in DuckDB: components as rows, one pair of steps for each round."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS v FROM embeddings
        WHERE len(embedding) = {dimensions} AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)""",
             f"""x AS MATERIALIZED (SELECT r, i, CAST(floor({scale} * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dimensions + 1}) t(i))""",
             f"""first AS (SELECT r, row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})""",
             "c0 AS MATERIALIZED (SELECT c, i, x FROM x JOIN first USING (r))"]
    for t in range(rounds + 1):
        steps.append(f"""d{t} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (
            SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{t} c USING (i) GROUP BY ALL) GROUP BY r)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.c, c.i, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (
                SELECT d.c, x.i, CAST((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
                FROM x JOIN d{t} d USING (r) GROUP BY ALL) m USING (c, i))""")
    last = f"d{rounds}"
    return f"""WITH {", ".join(steps)},
        named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM kept JOIN {last} USING (r) JOIN named USING (c)"""
