"""Word shingles of whole texts as 64-bit hashes, computed on arrays."""

from __future__ import annotations

import numpy as np

from heedstream.llm._common import mix, prefix_sums, range_hash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of lower-cased texts.

    Returns their hashes, their starts, their ends and, for each text, the
    index of its first word (one entry more than texts).
    """
    data = _LOWER[data]
    size = len(data)
    solid = ~_SPACE[data]
    begins = np.zeros(size + 1, dtype=bool)
    begins[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | begins[1:size]
    start = np.flatnonzero(start)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | begins[1:size]
    end = np.flatnonzero(last) + 1
    sums = prefix_sums(data)
    return range_hash(sums, start, end), start, end, np.searchsorted(start, offsets)


def shingle_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; texts aren't told apart here."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = word[:n] * _STEPS[0]
    for k in range(1, width):
        out += word[k : k + n] * _STEPS[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: (values, offsets).

    A text with fewer than ``width`` words has its whole word sequence as
    its only shingle; a text without words has none.
    """
    word, _, _, first = words(data, offsets)
    count = np.diff(first)
    every = shingle_hashes(word, width)
    own = np.maximum(count - width + 1, 0)
    owner = np.repeat(np.arange(len(own)), own)
    begin = np.cumsum(own) - own
    at = np.arange(int(own.sum())) - np.repeat(begin - first[:-1], own)
    value = every[at]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        total = np.full(len(short), 77, dtype=np.uint64) * count[short].astype(np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            total[has] += word[first[short[has]] + k] * _STEPS[k]
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, mix(total)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[keep], value[keep]
    return value, np.searchsorted(owner, np.arange(len(own) + 1))
