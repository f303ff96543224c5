"""Token files: flat unsigned integers with 64-bit document offsets, memory-mapped.

A folder holds, for each part, `part-N.ids` (the ids of its documents in a row, 16 bits wide if the vocabulary allows, else 32), `part-N.offsets`
(64-bit, where each document starts inside the part, and the part's end) and `part-N.docs` (64-bit document ids); and a table `parts` with
the parts' sizes and bases. Documents are ranged by id, so parts follow one another in ascending id order; a part's base, the number of ids in
all parts before it, is a prefix sum over the parts' totals (one row a file, the only thing the driver sees). Texts are shuffled once, into
their ranges; a task encodes and writes its range piece by piece. A file gets its name when it is complete, and a task that runs again
writes the same bytes, so a lost executor costs its unfinished parts.

The folder must be one that all executors mount under one path (`file:` or a plain path), since files are mapped into memory.

Defined results: a null text is the empty text; every document ends with the end id; rows with a null id come first, as one document each;
rows that share an id follow one another in the order of a hash of their texts; many rows of one id spread over several
parts; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm.pieces import Encoder
from voxloom.session import durable, scratch_path

#: Documents that one record of the reader covers.
RANGE = 2048
_PART = "part int, width int, n_docs long, n_null long, n_ids long"
_encoders: dict[tuple[int, int], Encoder] = {}


def local(folder: str) -> str:
    """The path of a mounted folder."""
    uri = urlparse(folder)
    if uri.scheme not in ("", "file"):
        raise ValueError(f"token files are mapped into memory: {folder} is no mounted folder")
    return unquote(uri.path) if uri.scheme else folder


def write_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = 2, id: str = "doc_id", text: str = "text") -> str:
    """Encode all texts with the tokenizer of the file `vocabulary` and write them to `folder` (a new one in the shared folder if None)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    path = local(folder)
    os.makedirs(path, exist_ok=True)
    with open(vocabulary, "rb") as file:
        shipped = spark.sparkContext.broadcast(file.read())  # a vocabulary is some megabytes whatever the corpus
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns(
        {"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # equal ids are told apart, so that no id, nor null, is one task
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_first(), "hash", "row").sortWithinPartitions(F.col("id").asc_nulls_first(), "hash", "text", "row")
    parts = durable(ranged.select("id", "text").mapInArrow(lambda batches: _written(batches, path, shipped, end), _PART))
    found = sorted(parts.collect())
    bases = np.cumsum([0, *(r.n_ids for r in found)]).tolist()
    first = np.cumsum([0, *(r.n_docs for r in found)]).tolist()
    table = [(*r, base, doc) for r, base, doc in zip(found, bases, first, strict=False)]
    spark.createDataFrame(table, f"{_PART}, base long, first_doc long").write.mode("overwrite").parquet(f"{folder}/parts")
    return folder


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32, position` of every document, from the mapped files."""
    path = local(folder)
    return _mapped(spark, folder, lambda batches: _digests(batches, path), "doc_id long, start long, n_tokens long, ids_crc32 long, position long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, start, ids, position` of every document, from the mapped files."""
    path = local(folder)
    return _mapped(spark, folder, lambda batches: _contents(batches, path), "doc_id long, start long, ids array<long>, position long")


def _mapped(spark: SparkSession, folder: str, read: Callable, schema: str) -> DataFrame:
    parts = spark.read.schema(f"{_PART}, base long, first_doc long").parquet(f"{folder}/parts").where("n_docs > 0")
    ranges = parts.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(RANGE).cast("long"))))
    return ranges.repartition("part", "lo").mapInArrow(read, schema)


class _Part:
    """The three files of a part while it is written."""

    def __init__(self, path: str, number: int):
        self.final = {kind: f"{path}/part-{number:06d}.{kind}" for kind in ("ids", "offsets", "docs")}
        self.temporary = {kind: f"{path}/.{os.path.basename(name)}.{uuid.uuid4().hex}" for kind, name in self.final.items()}
        self.open: dict[str, BinaryIO] = {kind: open(name, "wb") for kind, name in self.temporary.items()}
        self.n_ids = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.open["ids"].write(ids.tobytes())
        self.open["offsets"].write((self.n_ids + np.cumsum(counts) - counts).astype("<i8").tobytes())
        self.n_ids += len(ids)

    def close(self, whole: bool) -> None:
        if whole:
            self.open["offsets"].write(np.array([self.n_ids], "<i8").tobytes())
        for kind, file in self.open.items():
            if whole:
                file.flush()
                os.fsync(file.fileno())
            file.close()
            if whole:
                os.replace(self.temporary[kind], self.final[kind])
            else:
                os.unlink(self.temporary[kind])


def _written(batches: Iterator[pa.RecordBatch], path: str, vocabulary, end: int) -> Iterator[pa.RecordBatch]:
    """Write one part; its sizes are the only output."""
    number = TaskContext.get().partitionId()
    data = vocabulary.value
    key = zlib.crc32(data), end
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data, end)
    encoder = _encoders[key]
    part, n_docs, n_null, whole = _Part(path, number), 0, 0, False
    try:
        for batch in batches:
            for ids, counts in encoder.batches(batch.column("text")):
                part.add(ids, counts)
            docs = batch.column("id")
            n_docs += len(docs)
            n_null += docs.null_count
            part.open["docs"].write(np.asarray(docs.fill_null(0)).astype("<i8").tobytes())
        whole = True
    finally:
        part.close(whole)
    yield pa.RecordBatch.from_pydict(
        {"part": pa.array([number], pa.int32()), "width": pa.array([encoder.type.itemsize], pa.int32()), "n_docs": [n_docs], "n_null": [n_null], "n_ids": [part.n_ids]})


def _ranges(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int, int]]:
    """For each range of documents: their ids, offsets in the range, tokens, the start of the range and its first document's position."""
    for batch in batches:
        for r in batch.to_pylist():
            lo, hi = r["lo"], min(r["lo"] + RANGE, r["n_docs"])
            name = f"{path}/part-{r['part']:06d}"
            offsets = np.array(np.memmap(f"{name}.offsets", "<i8", "r")[lo:hi + 1])
            docs = np.array(np.memmap(f"{name}.docs", "<i8", "r")[lo:hi])
            ids = np.memmap(f"{name}.ids", f"<u{r['width']}", "r")[offsets[0]:offsets[-1]]  # the end id keeps it from being empty
            yield pa.array(docs, mask=np.arange(lo, hi) < r["n_null"]), offsets - offsets[0], ids, r["base"] + int(offsets[0]), r["first_doc"] + lo


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for docs, offsets, ids, start, position in _ranges(batches, path):
        data = memoryview(np.asarray(ids).astype("<u4").tobytes())
        crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": docs, "start": pa.array(start + offsets[:-1]), "n_tokens": pa.array(np.diff(offsets)), "ids_crc32": pa.array(crc, pa.int64()),
            "position": pa.array(position + np.arange(len(docs)))})


def _contents(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for docs, offsets, ids, start, position in _ranges(batches, path):
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.asarray(ids).astype(np.int64)))
        yield pa.RecordBatch.from_pydict({
            "doc_id": docs, "start": pa.array(start + offsets[:-1]), "ids": lists, "position": pa.array(position + np.arange(len(docs)))})
