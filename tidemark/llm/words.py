"""Hashes of words and word shingles of many texts at once, on UTF-8 bytes.

A word is a run of `[^\\x20\\x09-\\x0D]`; A-Z count as a-z. Hashes have 64 bits and depend on the words alone.
"""

from __future__ import annotations

import numpy as np

from .common import mix

SHINGLE = 5


def _constants(n: int, start: int) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _constants(256, 1000)[_LOWER]
_PLACE = _constants(256, 5000)
_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True
_WORD = _constants(SHINGLE, 9000)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte) of each word of the texts data[offs[i]:offs[i + 1]]."""
    gap = _BREAK[data]
    before = np.append(True, gap[:-1])[: data.size]
    before[offs[:-1][offs[:-1] < data.size]] = True
    start = np.flatnonzero(before & ~gap)
    if not start.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), start
    body = slice(start[0], None)
    place = np.arange(start[0], data.size) - np.repeat(start, np.diff(np.append(start, data.size)))
    # a place has its own constant up to 255; beyond, the quotient enters too
    v = mix(_BYTE[data[body]] * _PLACE[place & 255] + (place >> 8).astype(np.uint64))
    v[gap[body]] = 0
    return mix(np.add.reduceat(v, start - start[0])), np.searchsorted(offs, start, "right") - 1, start


def repeats(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows the number of distinct hashes and the count of its commonest one. row must ascend."""
    if not h.size:
        return np.zeros(n), np.zeros(n)
    key = np.sort(mix(h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(20) | (row.astype(np.uint64) << np.uint64(44)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    of = (key[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(first, key.size)))
    return np.bincount(of, minlength=n), most


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles of `size` words, ascending; of a text with fewer words the one of them all."""
    h, row, _ = word_hashes(data, offs)
    words = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(words) - words
    full = max(0, h.size - size + 1)
    s = np.zeros(full, np.uint64)
    for j in range(size):
        s += h[j : j + full] * _WORD[j]
    s = mix(s)
    out = []
    for at, n in zip(first, words):
        if n >= size:
            x = np.sort(s[at : at + n - size + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif n:
            out.append(mix((h[at : at + n] * _WORD[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
