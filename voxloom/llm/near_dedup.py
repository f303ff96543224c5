"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, grouping by links.

1. One pass over the texts: shingle set, its fingerprint, signature, one key per band. Equal sets are one class from here on, so exact
   copies cost one aggregate and a join, however many there are.
2. Classes that share a band key are candidates. A bucket of up to ``small`` classes gives all its pairs (a bounded number per class);
   a larger one gives the pairs of its least class with every other. Signatures and set sizes rule most pairs out.
3. The pairs left are verified on the full sets, computed anew from the two texts.
4. Classes of larger buckets that are not yet in the component of their least class are compared with the whole bucket cluster: the
   cluster is cut into tiles by set size, and a task multiplies the incidence matrices of two tiles. Only a spanning forest of the
   links found in a pair of tiles leaves the task, so no link between different components is lost and no group emits its pairs.
5. Components of all links; every class hands its component to its copies.

Defined results: null, empty and blank texts have the empty set and link with nothing; a null id links with nothing, its component
is null and it is kept; rows that share an id are one node, linked whatever their texts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.llm import kernels as K
from voxloom.llm.components import components
from voxloom.llm.shingles import band_keys, shingle_sets, superminhash
from voxloom.session import durable

#: Documents whose signatures are computed together, and classes of one tile.
GROUP, TILE = 128, 256
#: Signature slots by which an estimate may fall short of the threshold, in standard deviations of plain MinHash.
SLACK = 6.0


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80, slots: int = 125, bands: int = 25,
                    small: int = 24, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` per row of `docs`: links are pairs with 100 * intersection >= percent * union."""
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = durable(source.mapInArrow(
        lambda batches: _signatures(batches, words_each, slots, bands),
        "id long, n long, fingerprint long, sketch binary, keys array<long>"))
    classes = durable(rows.where("n > 0 AND id IS NOT NULL").groupBy("fingerprint", "n").agg(
        F.min("id").alias("id"), F.min_by("sketch", "id").alias("sketch"), F.min_by("keys", "id").alias("keys")))
    listed = classes.select("id", "n", F.posexplode("keys").alias("band", "key"))
    buckets = listed.groupBy("band", "key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("head")).where("size > 1")
    members = durable(listed.join(buckets, ["band", "key"]).select(
        "band", "key", "id", "n", "size", F.col("head.id").alias("head"), F.col("head.n").alias("head_n")))
    one = members.where(F.col("size") <= small)
    other = one.select("band", "key", F.col("id").alias("b"), F.col("n").alias("b_n"))
    few = one.join(other, ["band", "key"]).where("id < b").select(F.col("id").alias("a"), "b", F.col("n").alias("a_n"), "b_n")
    many = members.where((F.col("size") > small) & (F.col("id") != F.col("head")))
    stars = many.select(F.col("head").alias("a"), F.col("id").alias("b"), F.col("head_n").alias("a_n"), F.col("n").alias("b_n"))
    alike = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    pairs = few.unionByName(stars).where(alike).select("a", "b").distinct()
    texts = source.join(classes.select("id"), "id", "left_semi")
    linked = durable(_verified(_promising(pairs, classes, percent, slots), texts, words_each, percent))
    clusters = components(many.select(F.col("head").alias("a"), F.col("id").alias("b")))
    inner = _tiled(clusters, components(linked), classes, texts, words_each, percent)
    copies = rows.where("n > 0 AND id IS NOT NULL").join(
        classes.select("fingerprint", "n", F.col("id").alias("first")), ["fingerprint", "n"]).select(
        F.col("first").alias("a"), F.col("id").alias("b"))
    found = components(linked.unionByName(inner).unionByName(copies))
    return rows.join(found, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))


def _signatures(batches: Iterator[pa.RecordBatch], words_each: int, slots: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for part in K.slices(batch.column(1), 1 << 18):
            sets = list(shingle_sets(part, words_each))
            signatures = np.concatenate([superminhash(sets[i:i + GROUP], slots) for i in range(0, len(sets), GROUP)])
            keys = band_keys(signatures, bands).view(np.int64)
            sketch = (K.mix64(signatures) & np.uint64(255)).astype(np.uint8)
            fingerprint = np.array([K.mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                ids.slice(part.lo, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fingerprint),
                pa.array([row.tobytes() for row in sketch], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel())],
                names=["id", "n", "fingerprint", "sketch", "keys"])


def _promising(pairs: DataFrame, classes: DataFrame, percent: int, slots: int) -> DataFrame:
    """Pairs whose one-byte signatures agree in as many slots as a link must, less a slack of several deviations."""
    share = percent / 100
    least = int(np.floor(slots * share - SLACK * np.sqrt(slots * share * (1 - share))))
    one = classes.select(F.col("id").alias("a"), F.col("sketch").alias("a_sketch"))
    two = classes.select(F.col("id").alias("b"), F.col("sketch").alias("b_sketch"))
    both = pairs.join(one, "a").join(two, "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, slots)
                           for c in ("a_sketch", "b_sketch"))
            chosen = pa.array((left == right).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(chosen)

    return both.select("a", "b", "a_sketch", "b_sketch").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words_each: int, percent: int) -> DataFrame:
    """The pairs that are links, by the full sets of both texts."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                some = batch.slice(lo, GROUP)
                one, two = (list(_sets(some.column(c), words_each)) for c in ("a_text", "b_text"))
                good = [_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y), percent)
                        for x, y in zip(one, two, strict=True)]
                yield some.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return joined.mapInArrow(keep, "a long, b long")


def _sets(column: pa.Array, words_each: int) -> Iterator[np.ndarray]:
    for part in K.slices(column, 1 << 18):
        yield from shingle_sets(part, words_each)


def _linked(shared, total, percent: int):
    return 100 * shared >= percent * (total - shared)


def _tiled(clusters: DataFrame, known: DataFrame, classes: DataFrame, texts: DataFrame, words_each: int, percent: int) -> DataFrame:
    """Links that join different known components inside a cluster, as a spanning forest per pair of tiles."""
    at = clusters.join(classes.select("id", "n"), "id").join(known.withColumnRenamed("component", "part"), "id", "left").select(
        F.col("component").alias("cluster"), "id", "n", F.coalesce("part", "id").alias("part"))
    heads = known.select(F.col("id").alias("cluster"), F.col("component").alias("main"))
    split = durable(at.join(heads, "cluster", "left").withColumn("rest", F.col("part") != F.coalesce("main", "cluster")))
    # Tiles are runs of set sizes: log-spaced levels, each dealt into as many tiles as it has classes for.
    level = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("int")
    levelled = split.withColumn("level", level)
    sizes = levelled.groupBy("cluster", "level", "rest").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = levelled.join(sizes, ["cluster", "level", "rest"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    ask = sizes.where("rest").select("cluster", F.col("level").alias("q_level"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("q_tile"))
    give = sizes.select("cluster", "level", "rest", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    plan = ask.join(give, "cluster").where(
        (F.abs(F.col("level") - F.col("q_level")) <= 1)
        & (~F.col("rest") | (F.struct("level", "tile") >= F.struct("q_level", "q_tile"))))
    sent = dealt.join(plan, ["cluster", "level", "rest", "tile"]).select(
        "cluster", "q_level", "q_tile", "level", "rest", "tile", "id", "part", F.lit(False).alias("asks"))
    asking = dealt.where("rest").select("cluster", F.col("level").alias("q_level"), F.col("tile").alias("q_tile"), "id", "part")
    asked = plan.join(asking, ["cluster", "q_level", "q_tile"]).select(
        "cluster", "q_level", "q_tile", "level", "rest", "tile", "id", "part", F.lit(True).alias("asks"))
    full = sent.unionByName(asked).join(texts, "id")

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.array(table.column("id"))
        part = np.array(table.column("part"))
        asks = np.array(table.column("asks"))
        sets = list(_sets(table.column("text").combine_chunks(), words_each))
        found = _forest(ids, part, asks, sets, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return full.groupBy("cluster", "q_level", "q_tile", "level", "rest", "tile").applyInArrow(solve, "a long, b long")


def _forest(ids: np.ndarray, part: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between asking and other rows that connect parts not connected before."""
    sizes = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.zeros((int(asks.sum()), int((~asks).sum())), np.float32)
    seat = np.where(asks, np.cumsum(asks) - 1, np.cumsum(~asks) - 1)
    width = 4096
    for lo in range(0, int(column.max()) + 1, width):  # columns of the incidence matrices, a bounded number at a time
        here = (column >= lo) & (column < lo + width)
        left = np.zeros((shared.shape[0], width), np.float32)
        right = np.zeros((shared.shape[1], width), np.float32)
        mine = here & asks[owner]
        left[seat[owner[mine]], column[mine] - lo] = 1
        mine = here & ~asks[owner]
        right[seat[owner[mine]], column[mine] - lo] = 1
        shared += left @ right.T
    total = sizes[asks][:, None] + sizes[~asks][None, :]
    x, y = np.nonzero(_linked(shared.astype(np.int64), total, percent))
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    out = []
    for i, j in zip(np.flatnonzero(asks)[x].tolist(), np.flatnonzero(~asks)[y].tolist(), strict=True):
        one, two = top(int(part[i])), top(int(part[j]))
        if one != two:
            root[one] = two
            out.append((int(ids[i]), int(ids[j])))
    return out
