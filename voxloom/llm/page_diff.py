"""HTML extraction by nearest-URL page differencing.

Pages of a host are put in the order of their URL paths; the nearer of the two neighbours (more leading path parts in common, the earlier
one on ties) is a page of the same template. The text lines of both are aligned by a longest common subsequence, and the lines they
share are deleted, as the template's. What the markup itself declares decides first: lines in an article stay (two articles may hold
the same sentence), lines in menus, footers, adverts and such go, and the difference decides on all others.

A host with a third of all pages spans many tasks: pages get their position in a range-partitioned order and are dealt in runs, each
with the page before and the page after it. Only line fingerprints travel for that; texts are written once and joined once.

A page whose neighbours have the same lines is compared with none, and one that shares all its lines keeps them: the difference
tells a template from an article, not a page from its copy.

Defined results: null html and pages without text give the empty text; pages without a host are compared with none; rows that share a page_id
are pages of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import xxhash

from voxloom.functions.ranking import position
from voxloom.llm.html_text import BODY, LOOSE, common, lines
from voxloom.session import durable

#: Consecutive pages of a host that one group compares.
RUN = 64
_BLOCKS = pa.list_(pa.string())


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id, url, text, n_chars, n_deleted` per row of `pages`; `n_deleted` lines were shared with the nearest page."""
    source = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    read = durable(source.mapInArrow(_read, "page_id long, url string, blocks array<string>, kinds array<int>, prints array<long>").withColumn(
        "row", F.monotonically_increasing_id()))
    address = F.regexp_replace(F.lower(F.trim("url")), r"[?#].*$", "")
    slim = read.select(
        "row", F.regexp_extract(address, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/]+)", 1).alias("host"),
        F.regexp_replace(F.regexp_extract(address, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/]+(/.*)?$", 1), r"/+$", "").alias("path"), "kinds", "prints").where("host != ''")
    ordered = position(slim, ("host",), [F.col("path"), F.col("row")])
    run = F.floor((F.col("pos") - 1) / RUN)
    own = ordered.withColumn("run", run)
    before = ordered.where(F.col("pos") % RUN == 0).withColumn("run", run + 1)
    after = ordered.where((F.col("pos") % RUN == 1) & (F.col("pos") > 1)).withColumn("run", run - 1)
    shared = own.unionByName(before).unionByName(after).groupBy("host", "run").applyInArrow(_deleted, "row long, deleted array<int>")
    # Only pages with lines that the difference decides on travel to their deletions.
    undecided = F.array_contains("kinds", LOOSE)
    open_pages = read.where(undecided).select("row", "page_id", "url", "blocks", "kinds").join(shared, "row", "left")
    closed = read.where(~undecided).withColumn("deleted", F.lit(None).cast("array<int>"))
    every = [df.select("page_id", "url", "blocks", "kinds", "deleted").mapInArrow(
        _join, "page_id long, url string, text string, n_chars long, n_deleted long") for df in (open_pages, closed)]
    return every[0].unionByName(every[1])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            some = batch.slice(lo, 512)
            found = [lines(h) if h else [] for h in some.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                some.column("page_id"), some.column("url"), pa.array([[t for t, _ in x] for x in found], _BLOCKS),
                pa.array([[k for _, k in x] for x in found], pa.list_(pa.int32())),
                pa.array([[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in x] for x in found], pa.list_(pa.int64()))],
                names=["page_id", "url", "blocks", "kinds", "prints"])


def _deleted(key: tuple, table: pa.Table) -> pa.Table:
    """Places of the lines that each page shares with the nearer of its neighbours, without those of an article."""
    table = table.sort_by("pos")
    rows, paths, kinds, prints, pos = (table.column(c).to_pylist() for c in ("row", "path", "kinds", "prints", "pos"))
    run = key[1].as_py()
    parts = [p.split("/") for p in paths]
    out_rows, out = [], []
    for i, p in enumerate(pos):
        if (p - 1) // RUN != run or LOOSE not in kinds[i]:
            continue
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(rows) and prints[j] != prints[i]]  # a copy tells nothing about the template
        if not near:
            continue
        best = max(near, key=lambda j: (_same(parts[i], parts[j]), -j))
        gone = [x for x in sorted(common(prints[i], prints[best])) if kinds[i][x] == LOOSE]
        if gone and (BODY in kinds[i] or len(gone) < kinds[i].count(LOOSE)):
            out_rows.append(rows[i])
            out.append(gone)
    return pa.table({"row": pa.array(out_rows, pa.int64()), "deleted": pa.array(out, pa.list_(pa.int32()))})


def _same(one: list[str], two: list[str]) -> int:
    n = 0
    for x, y in zip(one, two, strict=False):
        if x != y:
            break
        n += 1
    return n


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = [], []
        for blocks, kinds, deleted in zip(*(batch.column(c).to_pylist() for c in ("blocks", "kinds", "deleted")), strict=True):
            drop = set(deleted or ())
            texts.append(" ".join(t for i, (t, k) in enumerate(zip(blocks, kinds, strict=True)) if k in (BODY, LOOSE) and i not in drop))
            gone.append(len(drop))
        yield pa.RecordBatch.from_arrays([
            batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
            pa.array(np.array([len(t) for t in texts], np.int64)), pa.array(np.array(gone, np.int64))],
            names=["page_id", "url", "text", "n_chars", "n_deleted"])
