"""Substring dedup: Rabin-Karp fingerprints of fixed-length token windows, counted in Spark.

A window can only repeat if the least of its shorter grams (winnowing) occurs in two documents. So Spark first counts these least
grams, about one in twenty words, and then counts every window whose least gram repeats; all others are proven to occur in one
document only. Windows that also start in a smaller document are removed, and touching windows merge into maximal intervals.

Both counts combine in the map tasks and join back on fingerprints, so a window that a third of all documents hold is one row per
task in the count, and its join is split by adaptive execution. Positions go back to the texts through one exchange of the texts,
which all joins share.

Defined results: null and blank texts have no words; rows that share an id are not copies of one another (no smaller id), also where
their texts differ; a null id comes after all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxloom.llm import kernels as K
from voxloom.llm.keyed import SUB_BITS, keyed, lists, named

#: Words of the grams that choose which windows are counted, and bytes of text in one kernel call.
GRAM, BYTES = 12, 1 << 18


def remove_repeated_windows(docs: DataFrame, window: int = 50, gram: int = GRAM, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256, spans, kept_text` per row: `spans` are the maximal removed word intervals."""
    source = keyed(docs, id, text)
    marks = source.mapInArrow(lambda b: _least_grams(b, window, gram), "gram long, id long, sub int")
    # the key changes its name for a join, so both sides get an exchange that adaptive execution may split
    known = marks.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.expr("~gram").alias("key"), "lo", "hi")
    # role: 1 where a larger document has the gram too, 2 where a smaller one has it
    roles = marks.withColumn("key", F.expr("~gram")).join(known, "key").groupBy("id", "sub").agg(F.collect_set(F.struct(
        "gram", ((F.col("id") < F.col("hi")).cast("int") + 2 * (F.col("id") > F.col("lo")).cast("int")).alias("role"))).alias("marks"))
    held = source.join(roles, ["id", "sub"]).select("id", "sub", "text", F.col("marks.gram").alias("grams"), F.col("marks.role").alias("roles"))
    windows = held.mapInArrow(lambda b: _windows(b, window, gram), "print long, id long, place long, role int")
    first = windows.where("role % 2 = 1").groupBy("print").agg(F.min("id").alias("first")).select(F.expr("~print").alias("key"), "first")
    later = windows.where("role >= 2").withColumn("key", F.expr("~print")).join(first, "key").where("id > first")
    places = later.groupBy("id", F.col("place").bitwiseAND(2**SUB_BITS - 1).cast("int").alias("sub")).agg(
        F.collect_list(F.shiftright("place", SUB_BITS)).alias("starts"))
    return source.join(places, ["id", "sub"], "left").select("id", "sub", "text", "starts").mapInArrow(
        lambda b: _cut(b, window),
        "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string").select(
        named().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "spans", "kept_text")


def _least_grams(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, subs = np.array(batch.column(0)), np.array(batch.column(1))
        for part in K.slices(batch.column(2), BYTES):
            _, _, first, hashes = K.word_hashes(part, lower=False)
            if len(hashes) < window:
                continue
            _, grams = _grams(hashes, gram)
            _, at = K.anchors(grams, first, gram, window)
            row = np.searchsorted(first, at, "right") - 1 + part.lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[at].view(np.int64)), pa.array(ids[row]), pa.array(subs[row])], names=["gram", "id", "sub"])


def _grams(hashes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    prefix = K.prefix_hash(hashes)
    start = np.arange(len(hashes) - gram + 1)
    return prefix, K.span_hash(prefix, start, start + gram)


def _windows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the windows whose least gram repeats; a place is the first word's number, then `sub`."""
    for batch in batches:
        ids, subs = np.array(batch.column(0)), np.array(batch.column(1)).astype(np.int64)
        for part in K.slices(batch.column(2), BYTES):
            _, _, first, hashes = K.word_hashes(part, lower=False)
            if len(hashes) < window:
                continue
            prefix, grams = _grams(hashes, gram)
            least, _ = K.anchors(grams, first, gram, window)
            start = np.flatnonzero(least)
            row = np.searchsorted(first, start, "right") - 1
            marks, owner = lists(batch.column(3), part.lo, len(part))
            roles, _ = lists(batch.column(4), part.lo, len(part))
            known = _with_row(marks.view(np.uint64), owner)
            order = np.argsort(known)
            known, roles = known[order], roles[order]
            asked = _with_row(least[start], row)
            at = np.searchsorted(known, asked).clip(max=len(known) - 1)
            good = known[at] == asked
            start, row, role = start[good], row[good], roles[at[good]]
            place = (start - first[row]) << SUB_BITS | subs[row + part.lo]
            yield pa.RecordBatch.from_arrays(
                [pa.array(K.span_hash(prefix, start, start + window).view(np.int64)), pa.array(ids[row + part.lo]),
                 pa.array(place), pa.array(role.astype(np.int32))], names=["print", "id", "place", "role"])


def _with_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    return K.mix64(values ^ K.mix64(row.astype(np.uint64) + np.uint64(1)))


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch.column(2), 8 << 20):
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "spans": [], "kept_text": []}
            starts, owner = lists(batch.column(3), part.lo, len(part))
            begin = np.searchsorted(owner, np.arange(len(part) + 1))
            for i in range(len(part)):
                tokens = part.text(i).split()
                n = len(tokens)
                at = starts[begin[i]:begin[i + 1]]
                lo, hi = K.merge(at, at + window)
                for a, b in zip(lo[::-1].tolist(), hi[::-1].tolist(), strict=True):
                    del tokens[a:b]
                kept = b" ".join(tokens)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(tokens))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                out["kept_text"].append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.lo, len(part)), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                 pa.array(out["kept_sha256"], pa.string()),
                 pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(out["kept_text"], pa.string())], names=["id", *out])
