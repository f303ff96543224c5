"""Whole texts to token ids with the `tokenizers` library, each different piece of text encoded once.

A byte-level BPE never merges across the pieces that its pre-tokenizer cuts a text into, so the ids of a text are those of its pieces in a
row. Here arrays find the pieces of some megabytes of texts, equal pieces are one, and the library encodes those that this worker has
not met. The library also says what kind of character a code point is. Texts that hold an added token, and tokenizers of any other kind, are
encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from voxloom.llm.kernels import mix64, prefix_hash, slices, span_hash

#: Pieces a worker remembers; it forgets those it has not met for a while, so its memory is bounded.
REMEMBERED = 500_000
LETTER, NUMBER, OTHER, SPACE, END = range(5)
_BLANK, _QUOTE = 32, 39
#: What a quote mark takes along (fixed values of this kind of pre-tokenizer).
_SHORT = ("s", "t", "m", "d")
_LONG = ("re", "ve", "ll")


class Encoder:
    """Ids of texts, each followed by `end`; `vocabulary` is the tokenizer's file."""

    def __init__(self, vocabulary: bytes, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(vocabulary)
        self.end = end
        largest = max([end, *self.library.get_vocab(with_added_tokens=True).values()])
        self.type = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        stated = json.loads(vocabulary)
        cut = stated.get("pre_tokenizer") or {}
        self.by_piece = (
            stated["model"].get("type") == "BPE" and not stated["model"].get("dropout") and not stated.get("normalizer") and not stated.get("truncation")
            and not stated.get("padding") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"))
        self.kinds = np.full(0x110000, -1, np.int8)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.letters = _letters(self.library) if self.by_piece else {}

    def batches(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time, in order: all their ids, and how many each text has; null is the empty text."""
        for part in slices(column):
            texts = [t or "" for t in column.slice(part.lo, len(part)).to_pylist()]
            found = None
            if self.by_piece and not any(a in t for a in self.added for t in texts):
                found = self._pieces(texts)
            ids, counts = found if found is not None else self._whole(texts)
            ends = np.cumsum(counts)
            yield np.insert(ids, ends, self.end), counts + 1

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, self.type) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*ids, np.zeros(0, self.type)]).astype(self.type), np.array([len(x) for x in ids], np.int64)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        bounds = np.flatnonzero(self._starts(points, ends))
        start, stop = bounds, np.append(bounds[1:], len(points))
        solid = np.ones(len(start), bool)
        solid[np.searchsorted(start, ends)] = False
        start, stop = start[solid], stop[solid]
        if not len(start):
            return np.zeros(0, self.type), np.zeros(len(texts), np.int64)
        marks = span_hash(prefix_hash(mix64(points.astype(np.uint64) + np.uint64(1))), start, stop)
        _, first, which = np.unique(marks, return_index=True, return_inverse=True)
        if not _equal(points, start, stop, first[which]):
            return None  # two different pieces with one fingerprint
        spans = zip(start[first].tolist(), stop[first].tolist(), strict=True)
        ids = self._encoded([joined[a:b] for a, b in spans])
        flat = np.frombuffer(b"".join(ids), self.type)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.type.itemsize
        begin = np.cumsum(size) - size
        many = size[which]
        upto = np.cumsum(many)
        at = np.repeat(begin[which] - (upto - many), many) + np.arange(upto[-1])
        reached = np.concatenate([[0], upto])[np.searchsorted(start, ends)]
        return flat[at], np.diff(reached, prepend=0)

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        tokenize, older = self.library.model.tokenize, self.older
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = pieces[i]
            ids = older.get(piece)
            if ids is None:  # the model reads bytes as the letters that stand for them
                ids = array(self.code, [t.id for t in tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
            found[i] = self.known[piece] = ids
        if len(self.known) > REMEMBERED // 2:  # what is met again moves over, the rest goes
            self.known, self.older = {}, self.known
        return found

    def _starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces start: runs of letters, numbers or other characters with the blank before them, white space, and short endings."""
        kind = self._kinds(points)
        kind[ends] = END
        starts = np.ones(len(points), bool)
        starts[1:] = kind[1:] != kind[:-1]
        starts[ends] = True
        after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END)) + 1
        starts[after - 1] = True  # the last one of several white spaces is on its own, or a blank that belongs to what follows
        starts[after[points[after - 1] == _BLANK]] = False
        quote = np.flatnonzero(starts & (points == _QUOTE) & (kind == OTHER))
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        padded[ends] = 0
        one = quote[np.isin(padded[quote + 1], [ord(c) for c in _SHORT])]
        two = quote[np.any([(padded[quote + 1] == ord(a)) & (padded[quote + 2] == ord(b)) for a, b in _LONG], axis=0)]
        for some, size in ((one, 2), (two, 3)):
            starts[some + 1] = False
            starts[some + size] = True
        return starts

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kind = self.kinds[points]
        if (kind < 0).any():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kind < 0]).tolist():
                self.kinds[p] = next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(before + chr(p))) == 1), SPACE)
            kind = self.kinds[points]
        return kind


def _letters(library) -> dict[int, str]:
    """The letter that stands for each byte, as the library's pre-tokenizer has it."""
    letters = {}
    for point in [*range(0x80), *range(0x80, 0x800, 0x40), *range(0x800, 0x10000, 0x1000), 0xD000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000,
                  *range(0x80, 0xC0)]:
        if not 0xD800 <= point < 0xE000:
            spelt = "".join(piece for piece, _ in library.pre_tokenizer.pre_tokenize_str(chr(point)))
            letters |= dict(zip(chr(point).encode(), spelt, strict=True))
    return letters


def _equal(points: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> bool:
    """Whether every piece has the code points of the piece that stands for it."""
    size = stop - start
    if (size != size[other]).any():
        return False
    upto = np.cumsum(size)
    inside = np.arange(upto[-1]) - np.repeat(upto - size, size)
    return bool((points[np.repeat(start, size) + inside] == points[np.repeat(start[other], size) + inside]).all())
