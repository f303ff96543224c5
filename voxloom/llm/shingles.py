"""Word shingle sets and SuperMinHash signatures of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from voxloom.llm import kernels as K

_STEP = 0x9E3779B97F4A7C15


def _step(n: int) -> np.uint64:
    return np.uint64(n * _STEP % (1 << 64))


def shingle_sets(part: K.Slice, words_each: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle fingerprints of every document. A text of fewer words is one shingle; a text without words has none."""
    _, _, first, hashes = K.word_hashes(part, lower=True)
    prefix = K.prefix_hash(hashes)
    starts = np.arange(len(hashes))
    ends = np.minimum(starts + words_each, len(hashes))
    grams = K.span_hash(prefix, starts, ends)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= words_each:
            yield np.unique(grams[lo:hi - words_each + 1])
        elif hi > lo:
            yield K.span_hash(prefix, np.array([lo]), np.array([hi]))
        else:
            yield grams[:0]


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash: element e sends value j + r_j(e) to slot p_j(e), where p(e) is a permutation of the slots; a slot keeps the least.

    All documents go through step j together. A value of step j is below every value of step j + 1, so a document whose slots are
    all taken after step j is finished: long documents stop after the first steps. Step and fraction are the upper and lower
    half of an integer. Rows of empty sets stay at the greatest value.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate([*sets, np.zeros(0, np.uint64)])
    out = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for j in range(slots):
        drawn = K.mix64(elements + _step(j + 1))
        pick = j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(32)) | (drawn >> np.uint64(32))
        if j == 0:
            slot = pick
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                at = np.arange(len(elements))
                order[at, first_pick], order[at, 0] = 0, first_pick
            at = np.arange(len(elements))
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[at, j]
            order[at, j] = slot
        np.minimum.at(out, owner * slots + slot, value)
        full = (out.reshape(-1, slots) != np.iinfo(np.uint64).max).all(axis=1)
        left = ~full[owner]
        if not left.any():
            break
        owner, elements = owner[left], elements[left]
        if j == 0:
            first_pick = pick[left]
        else:
            order = order[left]
    return out.reshape(-1, slots)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One fingerprint per document and band of equally many slots; bands differ in their seed."""
    rows = signatures.shape[1] // bands
    out = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signatures), _step(b + 1), np.uint64)
        for s in signatures[:, b * rows:(b + 1) * rows].T:
            key = K.mix64(key ^ s) + key
        out[:, b] = key
    return out
