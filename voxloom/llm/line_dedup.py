"""Line dedup: a segment-partition edit join of lines.

Two lines are linked if at most ``errors`` edits of bytes turn one into the other. A line is cut into errors + 1 segments, so each of its links
keeps one segment whole, at nearly the same place: every line puts its segments into an index under (length, segment number, content)
and probes the indexes of lines of its own and slightly smaller length with the substrings that can meet a segment. Candidates are
verified by a banded bit-parallel edit distance. Of linked lines, and of equal ones, the first (smaller document, earlier line) stays.

Equal lines count once from the start. A key of up to ``small`` lines gives its pairs (a bounded number per line); a larger one links its
lines into a cluster, which is cut into tiles by length, and tasks compare pairs of tiles: only a spanning forest of their links
leaves a task. A bitmap of fixed size tells a second scan which texts are asked for; the join that follows is exact.

Defined results: lines are what line feeds separate, without white space around them; blank lines are never removed; lines under ``least``
bytes, where two edits may be most of a line, are linked to no other line, and of equal ones the first stays if ``short`` is set (all stay
otherwise); null and empty texts have no lines; rows that share id and text are one document, rows that share an id only are
ordered by a fingerprint of their text; a null id comes after all others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxloom.llm import kernels as K
from voxloom.llm.components import components
from voxloom.llm.keyed import keyed, lists, named
from voxloom.session import durable

BYTES, TILE, BITS = 1 << 18, 256, 23


def remove_repeated_lines(docs: DataFrame, errors: int = 2, least: int = 24, small: int = 16, id: str = "doc_id", text: str = "text",
                          carry: tuple[str, ...] = (), short: bool = False) -> DataFrame:
    """`doc_id, n_lines, n_removed, n_near, kept_text` per row of `docs`; `n_near` of the removed lines equal no earlier line.

    The struct `carried` brings columns of `docs` along."""
    source = keyed(docs, id, text)
    lines = durable(source.mapInArrow(lambda b: _lines(b, 1 if short else least), "print long, id long, sub int, line int"))
    at = F.struct("id", "sub", "line")
    distinct = durable(lines.groupBy("print").agg(F.min(at).alias("first"), (F.min(at) != F.max(at)).alias("again")))
    index = source.mapInArrow(lambda b: _keys(b, least, errors, False), "key long, a long, own boolean")
    probe = source.mapInArrow(lambda b: _keys(b, least, errors, True), "key long, b long, own boolean")
    pairs = _pairs(index, probe, small)
    few, stars = (durable(pairs.where(big).select("a", "b").distinct()) for big in ("NOT big", "big"))
    clusters = components(stars)
    wanted = few.select(F.col("a").alias("print")).union(few.select("b")).union(clusters.select("id")).distinct()
    texts = durable(_texts(source, wanted, least))
    one = texts.select(F.col("print").alias("a"), F.col("bytes").alias("a_bytes"))
    two = texts.select(F.col("print").alias("b"), F.col("bytes").alias("b_bytes"))
    plain = few.join(one, "a").join(two, "b").select("a", "b", "a_bytes", "b_bytes").mapInArrow(lambda b: _close(b, errors), "a long, b long")
    links = durable(plain.unionByName(_tiled(clusters, texts, errors)))
    linked = components(links)
    grouped = distinct.join(linked, F.col("print") == F.col("id")).select("print", "first", "again", "component")
    heads = grouped.groupBy("component").agg(F.min("first").alias("head"))
    alone = distinct.where("again").join(linked.select(F.col("id").alias("print")), "print", "left_anti").select("print", "first", F.col("first").alias("head"))
    decided = durable(grouped.join(heads, "component").select("print", "first", "head").unionByName(alone))
    gone = lines.join(decided, "print").where(at != F.col("head")).select(
        "id", "sub", "line", (at == F.col("first")).alias("near"))
    places = gone.groupBy("id", "sub").agg(F.collect_set("line").alias("gone"), F.collect_set(F.when(F.col("near"), F.col("line"))).alias("near"))
    carried = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).isNull().alias("no_text")).alias("carried")
    whole = keyed(docs, id, text, carried)
    schema = "id long, n_lines long, n_removed long, n_near long, kept_text string, carried " + whole.schema["carried"].dataType.simpleString()
    return whole.join(places, ["id", "sub"], "left").select("id", "sub", "text", "gone", "near", "carried").mapInArrow(_cut, schema).select(
        named().alias("doc_id"), "n_lines", "n_removed", "n_near", "kept_text", "carried")


class Lines:
    """The trimmed lines of at least some length (blank ones never) of a slice: where they begin and end, their numbers and documents."""

    def __init__(self, part: K.Slice, least: int):
        data = part.data
        cut = np.flatnonzero(data == 10)
        start = np.union1d(cut + 1, part.offsets[:-1])
        start = start[start < len(data)]
        self.doc = np.searchsorted(part.offsets, start, "right") - 1
        end = np.minimum(np.append(cut, len(data))[np.searchsorted(cut, start)], part.offsets[self.doc + 1])
        self.number = np.arange(len(start)) - np.searchsorted(start, part.offsets[:-1])[self.doc]
        solid = np.flatnonzero(~K._SPACE[data])
        lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
        some = hi > lo
        lo, hi = lo[some], hi[some]
        self.doc, self.number = self.doc[some], self.number[some]
        self.start, self.end = solid[lo], solid[hi - 1] + 1
        long = self.end - self.start >= least
        self.doc, self.number, self.start, self.end = (x[long] for x in (self.doc, self.number, self.start, self.end))
        self.prefix = K.prefix_hash(K.byte_values(data))
        self.print = K.span_prints(data, self.prefix, self.start, self.end).view(np.int64)


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, subs = np.array(batch.column(0)), np.array(batch.column(1))
        for part in K.slices(batch.column(2), BYTES):
            found = Lines(part, least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.print), pa.array(ids[found.doc + part.lo]), pa.array(subs[found.doc + part.lo]),
                 pa.array(found.number.astype(np.int32))], names=["print", "id", "sub", "line"])


def _keys(batches: Iterator[pa.RecordBatch], least: int, errors: int, probing: bool) -> Iterator[pa.RecordBatch]:
    """Index or probe keys of the lines of every slice, each distinct line once."""
    for batch in batches:
        for part in K.slices(batch.column(2), BYTES):
            found = Lines(part, least)
            _, once = np.unique(found.print, return_index=True)
            start, size, name = found.start[once], (found.end - found.start)[once], found.print[once]
            for shorter in range(errors + 1 if probing else 1):
                length = size - shorter
                for i in range(errors + 1):
                    at, width = _segment(length, i, errors)
                    lo, hi = 0, 0
                    if probing:
                        lo, hi = max(-i, shorter - (errors - i)), min(i, shorter + errors - i)
                    for shift in range(lo, hi + 1):
                        begin = at + shift
                        fits = (begin >= 0) & (begin + width <= size)
                        a, b = (start + begin)[fits], (start + begin + width)[fits]
                        key = K.mix64(K.span_hash(found.prefix, a, b) + (length[fits] * 8 + i).astype(np.uint64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), pa.array(name[fits]), pa.array(np.full(len(key), shorter == shift == 0))],
                            names=["key", "b" if probing else "a", "own"])


def _segment(length: np.ndarray, i: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and width of segment i of errors + 1; the last ones are a byte longer where the length leaves a rest."""
    short, rest = length // (errors + 1), length % (errors + 1)
    longer = np.maximum(0, i - (errors + 1 - rest))
    return i * short + longer, short + (i >= errors + 1 - rest)


def _pairs(index: DataFrame, probe: DataFrame, small: int) -> DataFrame:
    """Candidates `a, b, big`: all pairs of keys that few lines share, and each line with the least line of a key that many share.

    A line also meets its own segments when it probes, so the probes alone tell which lines a key indexes.
    """
    held = index.groupBy("key").agg(F.min("a").alias("head"), F.max("a").alias("last"))
    # the key changes its name for the join, so both sides get an exchange that adaptive execution may split
    asked = durable(probe.withColumn("key", F.expr("~key")).join(held.withColumn("key", F.expr("~key")), "key").where(
        "head != last OR head != b"))
    direct = asked.where("head = last").select(F.col("head").alias("a"), "b", F.lit(False).alias("big"))
    shared = asked.where("head != last").select("key", "b", "own")
    sizes = durable(shared.groupBy("key").agg(F.count("*").alias("size"), F.min("b").alias("least")))
    little = shared.join(sizes.where(F.col("size") <= small), "key")
    few = little.where("own").select("key", F.col("b").alias("a")).join(little.select("key", "b"), "key").where("a != b").select(
        "a", "b", F.lit(False).alias("big"))
    many = shared.join(sizes.where(F.col("size") > small), "key").where("b != least").select(F.col("least").alias("a"), "b", F.lit(True).alias("big"))
    every = direct.unionByName(few).unionByName(many)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "big")


def _texts(source: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """`print, bytes` of the wanted lines."""
    bits = wanted.select(F.shiftright("print", 64 - BITS).alias("bit"))
    rows = bits.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("mask")).collect()
    half = 1 << (BITS - 7)
    bitmap = np.zeros(2 * half, np.int64)
    for row in rows:  # at most 2 ** (BITS - 6) rows
        bitmap[row["slot"] + half] = row["mask"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(2), BYTES):
                found = Lines(part, least)
                prints, once = np.unique(found.print, return_index=True)
                bit = prints >> (64 - BITS)
                hit = (bitmap[(bit >> 6) + half] >> (bit & 63) & 1).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[hit]), pa.array([part.data[a:b].tobytes() for a, b in zip(
                        found.start[once[hit]], found.end[once[hit]], strict=True)], pa.binary())], names=["print", "bytes"])

    found = source.mapInArrow(pick, "print long, bytes binary")
    return found.join(wanted, "print").groupBy("print").agg(F.min("bytes").alias("bytes"))


def _close(batches: Iterator[pa.RecordBatch], errors: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within(x, y, errors) for x, y in zip(batch.column("a_bytes").to_pylist(), batch.column("b_bytes").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def within(one: bytes, two: bytes, errors: int) -> bool:
    """Whether at most `errors` (up to 31) edits of bytes turn one into the other: bit vectors of the band of diagonals that can hold them."""
    if len(one) < len(two):
        one, two = two, one
    if len(one) - len(two) > errors:
        return False
    lo, top = 0, len(two)
    while lo < top and one[lo:lo + 64] == two[lo:lo + 64]:
        lo = min(lo + 64, top)
    while lo < top and one[lo] == two[lo]:
        lo += 1
    end = 0
    while end < top - lo and one[len(one) - 1 - end] == two[len(two) - 1 - end]:
        end += 1
    one, two = one[lo:len(one) - end], two[lo:len(two) - end]
    if len(one) <= errors:
        return True
    places: dict[int, int] = {}
    for i, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << (i + 63)
    # The highest bit of the vectors is row j + errors in column j; once that is past the last row, the last row moves down the bits.
    full = (1 << 64) - 1
    up, down = full << (63 - errors) & full, 0
    distance, row = errors, 1 << 62
    for j, c in enumerate(two):
        equal = places.get(c, 0) >> (j + errors) & full
        diagonal = (((equal & up) + up) ^ up | equal | down) & full
        right_up, right_down = (down | ~(diagonal | up)) & full, diagonal & up
        if j < len(one) - errors:
            distance += not diagonal >> 63
        else:
            distance += bool(right_up & row) - bool(right_down & row)
            row >>= 1
        if distance > 2 * errors + len(two) - len(one) + errors:
            return False
        moved = diagonal >> 1
        up, down = (right_down | ~(moved | right_up)) & full, moved & right_up
    return distance <= errors


def _tiled(clusters: DataFrame, texts: DataFrame, errors: int) -> DataFrame:
    """Links inside clusters, as a spanning forest per pair of tiles of nearly equal length."""
    held = clusters.join(texts.withColumnRenamed("print", "id"), "id").select(
        F.col("component").alias("cluster"), "id", "bytes", F.octet_length("bytes").alias("length"))
    sizes = held.groupBy("cluster", "length").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = durable(held.join(sizes, ["cluster", "length"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")))
    tiles = sizes.select("cluster", "length", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    other = tiles.select("cluster", F.col("length").alias("to_length"), F.col("tile").alias("to_tile"))
    plan = durable(tiles.join(other, "cluster").where(
        F.col("to_length").between(F.col("length"), F.col("length") + errors)
        & ((F.col("length") < F.col("to_length")) | (F.col("tile") <= F.col("to_tile")))))
    left = plan.join(dealt, ["cluster", "length", "tile"]).select(*plan.columns, "id", "bytes", F.lit(False).alias("right"))
    right = plan.join(dealt.select("cluster", F.col("length").alias("to_length"), F.col("tile").alias("to_tile"), "id", "bytes"),
                      ["cluster", "to_length", "to_tile"]).where("length != to_length OR tile != to_tile").select(
        *plan.columns, "id", "bytes", F.lit(True).alias("right"))

    def solve(table: pa.Table) -> pa.Table:
        side = np.array(table.column("right"))
        ids, texts = table.column("id").to_pylist(), table.column("bytes").to_pylist()
        counts = np.stack([np.bincount(np.frombuffer(t, np.uint8) & 63, minlength=64) for t in texts])
        one = np.flatnonzero(~side)
        two = np.flatnonzero(side) if side.any() else one
        root = list(range(len(ids)))

        def top(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        found = []
        for i in one.tolist():
            # an edit changes the counts of bytes by two at most
            near = two[np.abs(counts[two] - counts[i]).sum(axis=1) <= 2 * errors]
            for j in near.tolist():
                if i != j and top(i) != top(j) and within(texts[i], texts[j], errors):
                    root[top(i)] = top(j)
                    found.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return left.unionByName(right).groupBy(*plan.columns).applyInArrow(solve, "a long, b long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch.column(2), 8 << 20):
            gone, owner = lists(batch.column(3), part.lo, len(part))
            near, near_owner = lists(batch.column(4), part.lo, len(part))
            begin = np.searchsorted(owner, np.arange(len(part) + 1))
            counts, texts = [], []
            for i in range(len(part)):
                text = part.text(i)
                split = text.split(b"\n") if text else []
                counts.append(len(split))
                drop = set(gone[begin[i]:begin[i + 1]].tolist())
                texts.append((b"\n".join(x for k, x in enumerate(split) if k not in drop) if drop else text).decode())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(part.lo, len(part)), pa.array(counts, pa.int64()), pa.array(np.diff(begin), pa.int64()),
                pa.array(np.bincount(near_owner, minlength=len(part)), pa.int64()), pa.array(texts, pa.string()),
                batch.column(5).slice(part.lo, len(part))], names=["id", "n_lines", "n_removed", "n_near", "kept_text", "carried"])
