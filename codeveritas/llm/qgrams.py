"""Bucket identifiers of q-grams over byte buffers, all documents of a block at once.

An identifier of a 2d-gram is mixed from the identifiers of its two d-grams, the one at the offset
and the one d bytes later, so identifiers double their depth by reading identifiers of later
offsets. Equal strings get equal identifiers in every task; nothing has to be agreed on.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the mixing steps (fixed values).
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The identifier of a string from those of its two parts."""
    return mix(left * _M1 + (right ^ (right >> np.uint64(29))) * _M3 + _M2)


def eight_grams(buffer: np.ndarray) -> np.ndarray:
    """Identifiers of the 8-grams of a byte buffer, one for each offset but the last seven."""
    if len(buffer) < 8:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(len(buffer) - 7, dtype=np.uint64)
    for shift in range(8):
        words = buffer[shift : shift + (len(buffer) - shift) // 8 * 8].view("<u8")
        out[shift::8] = words[: len(out[shift::8])]
    out += _M1
    return mix(out)


def doubled(ids: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of depth-grams turned into those of 2*depth-grams."""
    return pair(ids[:-depth], ids[depth:]) if len(ids) > depth else ids[:0]


def joined(ids: np.ndarray, depth: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Identifiers of the strings [start, start + length), depth <= length <= 3 * depth."""
    last = start + length - depth
    middle = start + (length - depth) // 2
    return mix(pair(pair(ids[start], ids[middle]), ids[last]) + np.uint64(length) if np.isscalar(length)
               else pair(pair(ids[start], ids[middle]), ids[last]) + np.asarray(length).astype(np.uint64))


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or greatest) of each run of `width` values, by doubling."""
    if len(values) < width:
        return values[:0]
    done = 1
    while done * 2 <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    if rest := width - done:
        values = best(values[:-rest], values[rest:])
    return values
