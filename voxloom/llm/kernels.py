"""Array kernels over Arrow text columns: words, rolling fingerprints and sliding minima of a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

#: Bytes of text that one kernel call works on; a longer document is one call of its own.
SLICE = 2 << 20
#: Bytes from which on a span is told apart by ``prints``: polynomials modulo 2**64 collide by rule from about 1,024 symbols on.
LONG = 128

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = np.asarray(x)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


class Slice:
    """Some whole documents of a batch: rows ``lo`` to ``hi``, their bytes and where each begins."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    """Cut a string column into runs of documents of about ``limit`` bytes; null is the empty text."""
    column = pc.cast(pc.fill_null(column, ""), pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit symbols, for ``span_hash``."""
    up, _ = _power(len(values))
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp fingerprints of the symbols from ``start`` to ``end``; equal symbols give equal values anywhere."""
    _, down = _power(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def prints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of byte spans that no rule for ``span_hash`` forces to collide (sums modulo 2**64 have such rules for long spans)."""
    view = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))


def span_prints(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of byte spans of any length: ``span_hash`` up to ``LONG`` bytes, ``prints`` beyond."""
    out = span_hash(prefix, start, end)
    long = np.flatnonzero(end - start > LONG)
    if len(long):
        out[long] = prints(data, start[long], end[long])
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (runs of bytes other than blank, tab to carriage return), and where each document's words begin."""
    solid = ~_SPACE[part.data]
    bounds = np.zeros(len(solid) + 1, bool)
    bounds[part.offsets] = True
    before = np.empty_like(solid)
    after = np.empty_like(solid)
    if len(solid):
        before[0] = False
        before[1:] = solid[:-1]
        before &= ~bounds[:-1]
        after[-1] = False
        after[:-1] = solid[1:]
        after &= ~bounds[1:]
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, part.offsets)


def word_hashes(part: Slice, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as in ``words`` and a fingerprint of each."""
    start, end, first = words(part)
    data = LOWER[part.data] if lower else part.data
    return start, end, first, span_prints(data, prefix_hash(byte_values(data)), start, end)


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    keep = np.minimum if least else np.maximum
    fill = np.iinfo(np.uint64).max if least else 0
    size = -(-len(values) // width) * width
    padded = np.full(size, fill, values.dtype)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = keep.accumulate(rows, axis=1).ravel()
    back = keep.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return keep(back[:n], ahead[width - 1:width - 1 + n])


def inside(starts: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` symbols from each start lie in one document; ``bounds`` has the documents' limits."""
    end = bounds[np.searchsorted(bounds, starts, "right").clip(max=len(bounds) - 1)]
    return starts + width <= end


def anchors(grams: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: ``least[i]`` is the least gram fingerprint in the window that starts at symbol i (0 where it would leave its
    document), and the positions of the grams that are least in some window. Equal windows have equal least grams."""
    width = window - gram + 1
    least = sliding(grams, width)
    if not len(least):
        return least, np.zeros(0, np.int64)
    limit = np.repeat(bounds[1:], np.diff(bounds))[:len(least)]
    least[np.arange(len(least)) + window > limit] = 0
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1:width - 1 + len(least)] = least
    chosen = sliding(padded, width, least=False)
    return least, np.flatnonzero((chosen[:len(grams)] == grams) & (grams > 0))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as sorted maximal ones; touching intervals join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(start) - 1]])
    return start[fresh], reach[last]
