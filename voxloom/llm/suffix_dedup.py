"""Suffix-array dedup: longest previous factors over suffixes that can repeat, and removal of all later copies.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. In terms of the longest-previous-factor array: LPF[i] is the
longest prefix of suffix i that also starts earlier, the greater of its common prefixes with the nearest suffixes in suffix order that have
a smaller position; bytes i to i + length go where LPF[i] >= length.

1. Two equal strings share the least of their grams (winnowing), so suffixes are sorted only where such a gram occurs twice anywhere;
   Spark counts these grams, about one in forty bytes, and tells each document which of its own repeat.
2. Every occurrence of a repeated gram has a context: the strings that have this gram as their least. Contexts are exchanged without bytes, by
   gram and fingerprint; equal ones of a slice of texts before that. All but the first of equal contexts are copies as a whole.
3. A context that is the only one of its gram shares nothing else. Of the others, one representative per distinct context sends its bytes to its
   gram's block. A gram with very many distinct contexts is divided: equal strings hold it at the same place, so its strings are dealt by halves
   of these places, and all strings of a half hold the same bytes around the gram (its core). Cores take the gram's place in steps 2 and 3, and
   are divided again if they have very many distinct contexts.
4. A block sorts the suffixes of its contexts up to ``length`` bytes, takes the common prefixes of neighbours, the previous and next
   smaller position of each suffix, and from both its longest previous factor, which decides.
5. Cores that still have very many after the last division get several blocks; what is first in one of these is counted once more by
   fingerprint, across blocks.
6. Removed strings go back to the texts. Steps 2, 3 and 6 meet the texts in one exchange of these.

Defined results: null is the empty text; positions compare by document, then start; a null id comes after all others; rows that share
id and text are one document, each returned; rows that share an id only are ordered by a fingerprint of their text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.llm import kernels as K
from voxloom.llm.keyed import keyed, lists, named

#: Bytes of the grams; bytes of text of a kernel call; distinct contexts of a gram per block; contexts whose suffixes are sorted together;
#: divisions of a gram with more contexts than a block has, into 2, 4, .. cores (of 62, 81, .. bytes for strings of 100). Each division
#: doubles the plan.
GRAM, BYTES, BLOCK, CHUNK, HALVINGS = 24, 1 << 18, 8192, 4096, 1
_START_BITS = 40
#: The bits of fingerprints that travel. Two grams that share them send contexts in vain; contexts are equal where 96 bits are, gram and all.
_COUNTED = np.uint64((1 << 48) - 1)


def remove_later_copies(
        docs: DataFrame, length: int = 100, gram: int = GRAM, block: int = BLOCK, id: str = "doc_id", text: str = "text", halvings: int = HALVINGS) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans` per row of `docs`; `spans` are the maximal removed byte runs."""
    source = keyed(docs, id, text)
    marks = source.mapInArrow(lambda b: _marks(b, length, gram), "gram long, id long, spot long")
    # the gram changes its name for the join, so both sides get an exchange that adaptive execution may split
    counts = marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(F.expr("~gram").alias("key"))
    known = marks.select(F.expr("~gram").alias("key"), "id", "spot").join(counts, "key").select(
        "id", F.shiftright("spot", 32).cast("int").alias("sub"), F.col("spot").bitwiseAND((1 << 31) - 1).cast("int").alias("nth")).repartition("id", "sub").groupBy("id", "sub").agg(
        F.collect_set("nth").alias("known"))
    row = "gram long NOT NULL, print long NOT NULL, id long NOT NULL, place long NOT NULL, size int NOT NULL, again boolean NOT NULL"
    contexts = source.join(known, ["id", "sub"]).select("id", "sub", "text", "known").mapInArrow(lambda b: _contexts(b, length, gram), row)
    at = F.struct("id", "place")
    sub = F.shiftrightunsigned("place", _START_BITS).cast("int")
    removed, sent = [], []
    for level in range(halvings + 1):
        equal = Window.partitionBy("gram", "print").orderBy("id", "place", "size")
        # One exchange serves all uses as long as nothing is filtered or pruned below it for one of them: no column can be null, all are in
        # the window, and lag marks the first row, since Spark cuts by row_number before the exchange
        ranked = contexts.repartition("gram", "print").withColumn("first", F.first(at).over(equal)).withColumn("prior", F.lag("id").over(equal))
        removed.append(ranked.where(F.col("again") | (at != F.col("first"))).select("id", "place", "size"))
        distinct = ranked.where("NOT again AND prior IS NULL").select("gram", "print", "id", "place", "size")
        several = distinct.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(
            F.expr("~gram").alias("key"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        sharing = distinct.select(F.expr("~gram").alias("key"), "print", "id", "place", "size").join(several, "key")
        if level == halvings:
            sent.append(sharing)
            break
        sent.append(sharing.where("blocks = 1"))
        crowded = sharing.where("blocks > 1").groupBy("id", sub.alias("sub")).agg(F.collect_list(F.struct("print", "place", "size")).alias("asked"))
        contexts = source.join(crowded, ["id", "sub"]).select("id", "text", *(F.col(f"asked.{c}").alias(c) for c in ("print", "place", "size"))).mapInArrow(
            lambda b, n=2 << level: _cores(b, length, gram, n), row)
    # blocks of a gram that has one only are salt -1
    salt = F.when(F.col("blocks") > 1, F.pmod(F.shiftrightunsigned("print", 17), "blocks")).otherwise(-1).cast("int")
    asked = reduce(DataFrame.unionByName, sent).groupBy("id", sub.alias("sub")).agg(
        F.collect_list(F.struct(F.expr("~key").alias("gram"), salt.alias("salt"), "print", "place", "size")).alias("asked"))
    pieces = source.join(asked, ["id", "sub"]).select(
        "id", "text", *(F.col(f"asked.{c}").alias(c) for c in ("print", "place", "size", "gram", "salt"))).mapInArrow(
        _pieces, "gram long, salt int, id long, place long, size int, bytes binary")
    # a hash of both, so that the blocks of one gram are dealt apart
    dealt = pieces.repartition(F.col("gram"), F.col("salt")).sortWithinPartitions("gram", "salt")
    solved = dealt.mapInArrow(lambda b: _solve(b, length), "id long, place long, size int, print long")
    removed.append(solved.where("print IS NULL").select("id", "place", "size"))
    # a block sends a string once, so a fingerprint has one row per block of its gram at most
    first = F.first(at).over(Window.partitionBy("print").orderBy("id", "place"))
    removed.append(solved.where("print IS NOT NULL").withColumn("first", first).where(at != F.col("first")).select("id", "place", "size"))
    cuts = reduce(DataFrame.unionByName, removed).groupBy("id", sub.alias("sub")).agg(F.collect_list(F.struct(
        F.col("place").bitwiseAND((1 << _START_BITS) - 1).alias("start"), F.col("size").alias("size"))).alias("cuts"))
    return source.join(cuts, ["id", "sub"], "left").select("id", "sub", "text", F.col("cuts.start").alias("starts"), F.col("cuts.size").alias("sizes")).mapInArrow(
        _cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>").select(
        named().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def _grams(part: K.Slice, gram: int) -> tuple[np.ndarray, np.ndarray]:
    prefix = K.prefix_hash(K.byte_values(part.data))
    start = np.arange(max(0, len(part.data) - gram + 1))
    return prefix, K.span_hash(prefix, start, start + gram)


def _marks(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, subs = np.array(batch.column(0)), np.array(batch.column(1))
        for part in K.slices(batch.column(2), BYTES):
            _, grams = _grams(part, gram)
            _, at = K.anchors(grams, part.offsets, gram, length)
            row = np.searchsorted(part.offsets, at, "right") - 1
            spot = subs[row + part.lo].astype(np.int64) << 32 | np.arange(len(at)) - np.searchsorted(at, part.offsets)[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array((grams[at] & _COUNTED).view(np.int64)), pa.array(ids[row + part.lo]), pa.array(spot)], names=["gram", "id", "spot"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The strings that have a repeated gram as their least, one row per occurrence: from the first string's start to the last one's end."""
    for batch in batches:
        ids, subs = np.array(batch.column(0)), np.array(batch.column(1)).astype(np.int64)
        for part in K.slices(batch.column(2), BYTES):
            prefix, grams = _grams(part, gram)
            least, at = K.anchors(grams, part.offsets, gram, length)
            nth, owner = lists(batch.column(3), part.lo, len(part))
            begin = np.searchsorted(at, part.offsets)
            mark = begin[owner] + nth
            # a number beyond the text's marks belongs to another text of the same id and sub
            values = np.unique(grams[at[mark[mark < begin[owner + 1]]]])
            start = np.flatnonzero(least)
            if not len(start) or not len(values):
                continue
            found = np.searchsorted(values, least[start]).clip(max=len(values) - 1)
            good = values[found] == least[start]
            start, code = start[good], found[good]
            # the first occurrence of its least gram in every string: places sorted by gram, then position
            spot = np.searchsorted(values, grams[at]).clip(max=len(values) - 1)
            mine = values[spot] == grams[at]
            n = len(part.data) + 1
            places = np.sort(spot[mine] * n + at[mine])
            anchor = places[np.searchsorted(places, code * n + start)] % n
            fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])[:len(start)])
            last = np.concatenate([fresh[1:] - 1, [len(start) - 1]])
            lo, hi, code = start[fresh], start[last] + length, code[fresh]
            row = np.searchsorted(part.offsets, lo, "right") - 1
            place = subs[row + part.lo] << _START_BITS | (lo - part.offsets[row])
            yield _collapsed(part, values[code], ids[row + part.lo], place, lo, hi)


def _collapsed(part: K.Slice, gram: np.ndarray, key: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Rows of the contexts from `lo` to `hi` of a slice; `key` has their ids.

    Of equal contexts of a slice the one of the smallest position stands for all; the others are known to be later copies (`again`) and travel
    under a key of their own, unless they have that position too (a repeated row).
    """
    print_ = K.prints(part.data, lo, hi) & _COUNTED
    order = np.lexsort((place, key, print_))
    fresh = np.concatenate([[True], print_[order[1:]] != print_[order[:-1]]])[:len(order)]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    again = (key != key[head]) | (place != place[head])
    once = again | (head == np.arange(len(head)))
    size = (hi - lo).astype(np.int32)
    gram, print_, place, key, size, again = (x[once] for x in (gram, print_, place, key, size, again))
    # what has been decided goes by its position
    return pa.RecordBatch.from_arrays([
        pa.array(np.where(again, place, (gram & _COUNTED).view(np.int64))), pa.array(np.where(again, key, print_.view(np.int64))), pa.array(key), pa.array(place), pa.array(size),
        pa.array(again)], names=["gram", "print", "id", "place", "size", "again"])


def _asked(batch: pa.RecordBatch, part: K.Slice) -> tuple[np.ndarray, ...]:
    """Row, place, start and end of the contexts asked of a slice, and which of the asked they are: what does not bear its fingerprint
    belongs to another text of the same id and sub."""
    print_, owner = lists(batch.column(2), part.lo, len(part))
    place, size = (lists(batch.column(c), part.lo, len(part))[0] for c in (3, 4))
    lo = (place & ((1 << _START_BITS) - 1)) + part.offsets[owner]
    hi = lo + size
    good = np.flatnonzero(hi <= part.offsets[owner + 1])
    good = good[K.prints(part.data, lo[good], hi[good]) & _COUNTED == print_[good].view(np.uint64)]
    return owner[good] + part.lo, place[good], lo[good], hi[good], good


def _cores(batches: Iterator[pa.RecordBatch], length: int, gram: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Contexts divided by where their strings hold the gram: `parts` ranges of places, each with a key of its own.

    Equal strings hold their least gram first at the same place, so they fall into one range, and they agree in all bytes that every string of
    this range holds around the gram. These bytes, the core, are the key. A context has one piece per range at most.
    """
    edges = sorted({(length - gram + 1) * k // parts for k in range(parts + 1)})
    for batch in batches:
        ids = np.array(batch.column(0))
        for part in K.slices(batch.column(1), BYTES):
            row, place, lo, hi, _ = _asked(batch, part)
            if not len(row):
                continue
            _, grams = _grams(part, gram)
            # the first least of the grams that all strings of a context hold is the one they have as their least
            anchor = np.empty(len(lo), np.int64)
            for k in range(0, len(lo), CHUNK):
                spot = lo[k:k + CHUNK, None] + np.arange(length - gram + 1)
                common = spot >= (hi[k:k + CHUNK] - length)[:, None]
                anchor[k:k + CHUNK] = lo[k:k + CHUNK] + np.where(common, grams[spot], np.iinfo(np.uint64).max).argmin(axis=1)
            most, fewest = anchor - lo, anchor - (hi - length)
            found = []
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                some = np.flatnonzero((fewest < end) & (most >= begin))
                start = anchor[some] - np.minimum(most[some], end - 1)
                stop = anchor[some] - np.maximum(fewest[some], begin) + length
                core = K.prints(part.data, anchor[some] - begin, anchor[some] + length + 1 - end)
                found.append((core, ids[row[some]], place[some] + start - lo[some], start, stop))
            yield _collapsed(part, *(np.concatenate(x) for x in zip(*found, strict=True)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked contexts."""
    for batch in batches:
        ids = np.array(batch.column(0))
        for part in K.slices(batch.column(1), BYTES):
            row, place, lo, hi, good = _asked(batch, part)
            gram, salt = (lists(batch.column(c), part.lo, len(part))[0][good] for c in (5, 6))
            yield pa.RecordBatch.from_arrays([
                pa.array(gram), pa.array(salt), pa.array(ids[row]), pa.array(place), pa.array((hi - lo).astype(np.int32)),
                pa.array([part.data[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())],
                names=["gram", "salt", "id", "place", "size", "bytes"])


def _solve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks come one after the other; whole blocks are solved together, about CHUNK contexts at a time.

    Several blocks of one gram are solved one by one: this runs once for what is decided and once for what is not, in tasks that adaptive
    execution may cut differently, and what a block sends must not depend on its neighbours in a task.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) > CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            gram, salt = (np.array(table.column(c)) for c in ("gram", "salt"))
            edge = np.flatnonzero((gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])) + 1
            ready = edge[np.searchsorted(edge, CHUNK, "right") - 1] if len(edge) and edge[0] <= CHUNK else edge[0] if len(edge) else 0
            if not ready:
                held = table.to_batches()
                break
            yield from _blocks(table.slice(0, ready), length)
            held = table.slice(ready).to_batches()
    if held and sum(b.num_rows for b in held):
        yield from _blocks(pa.Table.from_batches(held), length)


def _blocks(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    gram, salt = (np.array(table.column(c)) for c in ("gram", "salt"))
    several = salt >= 0
    edge = np.flatnonzero(((gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])) & (several[1:] | several[:-1])) + 1
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(gram)], strict=True):
        yield _block(table.slice(lo, hi - lo), length)


def _rows(ids: np.ndarray, place: np.ndarray, size: np.ndarray, print_: np.ndarray | None) -> pa.RecordBatch:
    prints = pa.nulls(len(ids), pa.int64()) if print_ is None else pa.array(print_.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place), pa.array(size.astype(np.int32)), prints], names=["id", "place", "size", "print"])


def _block(table: pa.Table, length: int) -> pa.RecordBatch:
    """Removed strings of some blocks, and the first strings of shared blocks with their fingerprints."""
    gram, ids, place, size, salt = (np.array(table.column(c)) for c in ("gram", "id", "place", "size", "salt"))
    shared = salt >= 0
    order = np.lexsort((place, ids))
    gram, ids, place, size, shared = gram[order], ids[order], place[order], size[order], shared[order]
    raw = table.column("bytes").combine_chunks().take(pa.array(order)).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    prefix = K.prefix_hash(K.byte_values(data))
    # a repeated row sends its contexts more than once
    keep = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])])[:len(ids)])
    counts = size[keep] - length + 1
    owner = np.repeat(keep, counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    suffix = offsets[owner] + start
    later, heads = previous_factors(data, prefix, suffix, ids[owner], place[owner] + start, length)
    lo, hi = _strings(owner[later], start[later], length)
    pending = heads[shared[owner[heads]]]
    found = [
        _rows(ids[owner[later][lo]], place[owner[later][lo]] + start[later][lo], start[later][hi] - start[later][lo] + length, None),
        _rows(ids[owner[pending]], place[owner[pending]] + start[pending], np.full(len(pending), length),
              K.prints(data, suffix[pending], suffix[pending] + length))]
    return pa.concat_batches(found)


def previous_factors(data: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, ids: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose longest previous factor reaches `length`, and the others, as sorted numbers; no two have one position.

    Suffixes with a fingerprint of their own have none and are set aside. The rest are sorted by their first `length` bytes. The longest
    previous factor is the greater of the common prefixes with the nearest suffixes of a smaller position, before and after in this order.
    """
    _, inverse, times = np.unique(K.span_hash(prefix, suffix, suffix + length), return_inverse=True, return_counts=True)
    alone = times[inverse] == 1
    some = np.flatnonzero(~alone)
    if not len(some):
        return some, np.flatnonzero(alone)
    # one byte more than text has keeps zero bytes at the end apart in comparisons
    keys = np.full((len(some), length + 1), 1, np.uint8)
    keys[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[suffix[some]]
    order = np.argsort(keys.view(f"S{length + 1}").ravel(), kind="stable")
    ranked = keys[order]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    position = np.empty(len(some), np.int64)
    position[np.lexsort((place[some], ids[some]))] = np.arange(len(some))
    position = position[order]
    before = _smaller(position, common)
    after = _smaller(position[::-1], common[::-1])[::-1]
    reached = np.maximum(before, after) >= length
    return np.sort(some[order[reached]]), np.sort(np.concatenate([np.flatnonzero(alone), some[order[~reached]]]))


def _smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it that has a smaller position (0 if there is none).

    All pointers begin at the neighbour and jump to the pointer of what they point at until that is smaller: what lies between is greater.
    """
    # entry 0 stands before all suffixes, with the smallest position and nothing in common
    position = np.concatenate([[-1], position])
    near = np.maximum(np.arange(len(position)) - 1, 0)
    shared = np.concatenate([[0, 0], common])[:len(position)]
    open_ = np.flatnonzero(position[near] > position)
    while len(open_):
        at = near[open_]
        shared[open_] = np.minimum(shared[open_], shared[at])
        near[open_] = near[at]
        open_ = open_[position[near[open_]] > position[open_]]
    return shared[1:]


def _strings(owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last entries of the runs of removed strings that start one byte after the other."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]))
    return fresh, np.concatenate([fresh[1:] - 1, [len(owner) - 1]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch.column(2), 8 << 20):
            starts, owner = lists(batch.column(3), part.lo, len(part))
            sizes, _ = lists(batch.column(4), part.lo, len(part))
            begin = np.searchsorted(owner, np.arange(len(part) + 1))
            removed, shas, spans = [], [], []
            for i in range(len(part)):
                text = part.text(i)
                at = starts[begin[i]:begin[i + 1]]
                lo, hi = K.merge(at, at + sizes[begin[i]:begin[i + 1]])
                edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(text)] if len(lo) else [0, len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                removed.append(len(text) - len(kept))
                shas.append(hashlib.sha256(kept).hexdigest())
                spans.append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(part.lo, len(part)), pa.array(np.diff(part.offsets)), pa.array(removed, pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()), pa.array(shas, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
