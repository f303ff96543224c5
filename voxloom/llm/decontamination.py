"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

1. A seed is four words in order within six: a contiguous 4-gram, or one with up to two words passed over, so that changed, added and left-out
   words break few of an item's seeds (with every third word changed, an item keeps no 4-gram but every fifteenth seed).
2. The benchmark's seeds fill a Bloom filter sized by their number (at most 16 MB) and a table of the lengths of their items. One scan of
   the documents looks every seed up and keeps the words around those that hit, as far as the longest item of that seed's slot reaches;
   a filter that a huge benchmark fills lets more through, never less.
3. Rare seeds join passages to items by value: of the `seeds` different seeds of an item, the `seeds` // SHARE that most passages hold are left out, and
   a passage meets the item if it holds `seeds` // SHARE (or one) of the others. Whatever shares twice that many with an item, a twentieth,
   is met for sure, however many copies make its seeds frequent: leaving out is bounded by number, not by frequency.
4. Each pair is aligned locally on words (match 2, mismatch and gap -1), so that edited or paraphrased copies score too. The score is the
   share of the item's best possible score. A passage that holds too few of the item's words to reach the bound, in whatever order, is passed over.

A hot item is a hot key only in joins whose other side is the benchmark, which adaptive execution broadcasts or splits.

Defined results: words are runs of letters and digits in lower case; null and blank texts match nothing; items of fewer words than a seed
match nothing; rows that share an id (documents or items) are reported once, with their best score; null ids are not
reported; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.llm import kernels as K
from voxloom.session import durable

#: Words of a seed, and words that it may span.
GRAM, SPAN = 4, 6
#: The words of a seed after its first one.
PATTERNS = tuple(combinations(range(1, SPAN), GRAM - 1))
#: An item's most frequent seeds, one in so many, are no index; as many of the others must hit.
SHARE = 40
#: Slots of the table of reaches and bits of the Bloom filter, as powers of two; a seed sets PROBES bits.
TABLE, LEAST_BITS, MOST_BITS, PROBES = 20, 20, 27, 3
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
MATCH, MISS, GAP = 2, 1, 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id: str = "doc_id", text: str = "text",
          item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`doc_id, item_id, score, start, end`: the best aligned passage (word numbers) of every document and item that reach `least`."""
    items = durable(benchmark.select(F.col(item).cast("long").alias("item"), F.lower(item_text).alias("text")).where("item IS NOT NULL").mapInArrow(
        _items, "item long, words array<long>, seeds int, grams array<long>, places array<int>").withColumn("number", F.monotonically_increasing_id()))
    grams = durable(items.select("number", "seeds", F.size("words").alias("length"), F.explode(F.arrays_zip("grams", "places")).alias("seed")).select(
        "number", "seeds", "length", F.col("seed.grams").alias("gram"), F.col("seed.places").alias("place")))
    reach, bloom = _filter(grams)
    source = docs.select(F.col(id).cast("long").alias("id"), F.lower(text).alias("text")).where("id IS NOT NULL")
    passages = durable(source.mapInArrow(
        lambda b: _passages(b, reach, bloom), "id long, first long, words array<long>, grams array<long>, places array<int>").withColumn(
        "row", F.monotonically_increasing_id()))
    held = passages.select("row", F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))
    rarest_last = Window.partitionBy("number").orderBy(F.col("held").desc(), "gram")
    rare = durable(grams.select("number", "seeds", "gram").distinct().join(held, "gram").withColumn("rank", F.row_number().over(rarest_last)).where(
        F.col("rank") > F.floor(F.col("seeds") / SHARE)).select("number", "seeds", "gram"))
    index = grams.select("number", "gram", "place").join(rare, ["number", "gram"])
    # the key changes its name for the join, so a hot seed may be split
    hits = passages.select("row", F.explode(F.arrays_zip("grams", "places")).alias("hit")).select(
        "row", F.expr("~hit.grams").alias("key"), F.col("hit.places").alias("at"))
    met = hits.join(index.select("number", "seeds", "place", "gram", F.expr("~gram").alias("key")), "key")
    pairs = met.groupBy("row", "number").agg(
        F.first("seeds").alias("seeds"), F.collect_set("gram").alias("grams"), F.collect_set((F.col("at") - F.col("place")).cast("int")).alias("offsets")).where(
        F.size("grams") >= F.greatest(F.lit(1), F.floor(F.col("seeds") / SHARE)))
    both = pairs.select("row", "number", "offsets").join(passages.select("row", "id", "first", "words"), "row").join(
        items.select("number", "item", F.col("words").alias("item_words")), "number").select("id", "item", "first", "words", "item_words", "offsets")
    found = both.mapInArrow(lambda b: _aligned(b, least), "id long, item long, score double, start long, end long")
    return found.groupBy("id", "item").agg(F.max(F.struct("score", (-F.col("start")).alias("back"), "end")).alias("best")).select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "best.score", (-F.col("best.back")).alias("start"), "best.end")


def _filter(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """By the leading bits of a seed the length of its longest item (as a power of two, 0 without one), and a Bloom filter of all seeds in 64-bit words."""
    slots = grams.groupBy(F.shiftright("gram", 64 - TABLE).alias("slot")).agg(
        F.max(F.ceil(F.log2("length"))).cast("int").alias("power"), F.count("*").alias("n")).toArrow()  # at most 2 ** TABLE rows
    reach = np.zeros(1 << TABLE, np.uint8)
    reach[np.array(slots.column("slot")) + (1 << TABLE - 1)] = np.array(slots.column("power"))
    bits = min(max(int(sum(slots.column("n").to_pylist()) * 32).bit_length(), LEAST_BITS), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = np.array(batch.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_bit(seeds, i, bits) for i in range(PROBES)]).astype(np.int64))], names=["bit"])

    masks = grams.select("gram").mapInArrow(places, "bit long").groupBy(F.shiftright("bit", 6).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("mask")).toArrow()  # at most 2 ** (MOST_BITS - 6) rows
    bloom = np.zeros(1 << bits - 6, np.int64)
    bloom[np.array(masks.column("slot"))] = np.array(masks.column("mask"))
    return reach, bloom


def _bit(seeds: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (seeds * _MULTIPLIERS[probe]) >> np.uint64(64 - bits)


def _hashes(part: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of a slice, and where each document's begin."""
    low = K.LOWER[part.data]
    inner = np.zeros(len(low) + 2, bool)
    inner[1:-1] = _WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[part.offsets] = True
    start = np.flatnonzero(inner[1:-1] & (~inner[:-2] | edge[:-1]))
    end = np.flatnonzero(inner[1:-1] & (~inner[2:] | edge[1:])) + 1
    return K.span_prints(low, K.prefix_hash(K.byte_values(low)), start, end), np.searchsorted(start, part.offsets)


def _seeds(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For every pattern the seeds that begin at each word, as far as words reach, and how many words they span."""
    terms = [hashes * m for m in _MULTIPLIERS]
    for pattern in PATTERNS:
        n = max(0, len(hashes) - pattern[-1])
        yield K.mix64(sum(term[at:at + n] for term, at in zip(terms, (0, *pattern), strict=True))).view(np.int64), pattern[-1] + 1


def _longs(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]), kind))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch.column("text")):
            hashes, first = _hashes(part)
            words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            seeds = [[seeds for seeds, _ in _seeds(w)] for w in words]
            grams = [np.concatenate(s) for s in seeds]
            places = [np.concatenate([np.arange(len(x)) for x in s]) for s in seeds]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").slice(part.lo, len(part)), _longs([w.view(np.int64) for w in words], pa.int64()),
                 pa.array([len(np.unique(g)) for g in grams], pa.int32()), _longs(grams, pa.int64()), _longs(places, pa.int32())],
                names=["item", "words", "seeds", "grams", "places"])


def _passages(batches: Iterator[pa.RecordBatch], reach: np.ndarray, bloom: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words around seeds that hit, on either side as many as an item may have; hits whose words overlap share a passage."""
    bits = len(bloom).bit_length() + 5
    for batch in batches:
        ids = np.array(batch.column("id"))
        for part in K.slices(batch.column("text"), 1 << 18):
            hashes, first = _hashes(part)
            last = np.repeat(first[1:], np.diff(first))  # where the document of each word ends
            hits: list[tuple[np.ndarray, ...]] = []
            for seeds, span in _seeds(hashes):
                power = reach[(seeds >> (64 - TABLE)) + (1 << TABLE - 1)]
                at = np.flatnonzero(power)
                at = at[at + span <= last[at]]
                for i in range(PROBES):
                    bit = _bit(seeds[at].view(np.uint64), i, bits).astype(np.int64)
                    at = at[(bloom[bit >> 6] >> (bit & 63) & 1).astype(bool)]
                hits.append((at, seeds[at], np.int64(1) << power[at].astype(np.int64)))
            at, seeds, far = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(at, kind="stable")
            at, seeds, far = at[order], seeds[order], far[order]
            row = np.searchsorted(first, at, "right") - 1
            # shifted by the document's number, passages of neighbouring documents don't touch
            lo, hi = K.merge(np.maximum(first[row], at - far) + row, np.minimum(first[row + 1], at + SPAN + far) + row)
            owner = np.searchsorted(first + np.arange(len(first)), lo, "right") - 1
            lo, hi = lo - owner, hi - owner
            begin = np.searchsorted(at, lo)
            end = np.searchsorted(at, hi)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[owner + part.lo]), pa.array(lo - first[owner]),
                _longs([hashes[a:b].view(np.int64) for a, b in zip(lo, hi, strict=True)], pa.int64()),
                _longs([seeds[a:b] for a, b in zip(begin, end, strict=True)], pa.int64()),
                _longs([at[a:b] - x for a, b, x in zip(begin, end, lo, strict=True)], pa.int32())],
                names=["id", "first", "words", "grams", "places"])


def _aligned(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"id": [], "item": [], "score": [], "start": [], "end": []}
        columns = [batch.column(c) for c in ("words", "item_words", "offsets")]
        for i in range(batch.num_rows):
            words, item, offsets = (np.array(c[i].values) for c in columns)
            best = (0.0, 0, 0)
            lo, hi = K.merge(np.maximum(offsets - len(item) // 2, 0), np.minimum(offsets + len(item) + len(item) // 2, len(words)))
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                if np.isin(item, words[a:b]).sum() < least * len(item):
                    continue  # every match takes a word of the item
                score, start, end = smith_waterman(item, words[a:b])
                best = max(best, (score / (MATCH * len(item)), start + a, end + a), key=lambda x: x[0])
            if best[0] >= least:
                at = batch.column("first")[i].as_py()
                for name, value in zip(out, (batch.column("id")[i].as_py(), batch.column("item")[i].as_py(), best[0], at + best[1], at + best[2]), strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[c], pa.float64() if c == "score" else pa.int64()) for c in out], names=list(out))


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of an item with a passage: score, first and one past the last word of the passage."""
    n = len(words)
    if not n:
        return 0, 0, 0
    place = np.arange(n)
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)  # of alignments that end before word j
    best = (0, 0, 0)
    for x in item:
        step = np.where(words == x, MATCH, -MISS)
        through, down = score[:-1] + step, score[1:] - GAP
        value = np.maximum(np.maximum(through, down), 0)
        start = np.where(value == 0, place + 1, np.where(through >= down, begin[:-1], begin[1:]))
        # gaps in the item: the best earlier value, less a gap for every word since
        slope = value + GAP * place
        top = np.maximum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == top, place, 0))
        value, start = top - GAP * place, start[source]
        score, begin = np.concatenate([[0], value]), np.concatenate([[0], start])
        at = int(value.argmax())
        if value[at] > best[0]:
            best = (int(value[at]), int(start[at]), at + 1)
    return best
