"""numpy kernels over blocks of UTF-8 text: word hashes, shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
#: A random 64-bit number for each byte; A-Z share those of a-z.
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_CODES_LOWER = BYTE_CODES.copy()
BYTE_CODES_LOWER[65:91] = BYTE_CODES[97:123]
_BASE = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII bytes other than letters and digits.
IS_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(n, 1 << 16)
        found = np.full(size, U64(base), dtype=np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        _powers[base] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and how many each row has. Words are runs without \\x20 and \\x09-\\x0D,
    or without other bytes given as `gap`."""
    solid = ~gap[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES_LOWER) -> np.ndarray:
    """64-bit hashes of words after lower-casing A-Z; equal words have equal hashes in every block."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts])


def exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words as they are."""
    return word_hashes(data, starts, ends, BYTE_CODES)


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans, one after another, and the offsets of each."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)], offsets


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A text of each row's words, joined by one space."""
    # every word takes the byte after it along, which becomes the space; a row's last is cut off
    padded = np.append(data, np.uint8(32))
    joined, offsets = gathered(padded, starts, ends + 1)
    joined[offsets[1:] - 1] = 32
    last = np.cumsum(counts)
    keep = np.ones(len(joined), dtype=bool)
    keep[offsets[last[counts > 0]] - 1] = False
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    bounds[1:] = offsets[last] - np.cumsum(counts > 0)
    return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(joined[keep]))]).cast(pa.string())


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within a row, and how many each row has; a shorter row is one shingle."""
    n_out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    at = np.repeat(np.cumsum(counts) - counts, n_out)
    at += np.arange(len(at)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
    left = np.repeat(np.where(counts >= width, width, counts), n_out)
    acc = np.full(len(at), U64(width), dtype=np.uint64)
    for j in range(width):
        inside = j < left
        more = words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else words
        acc = np.where(inside, acc * U64(0x9E3779B97F4A7C15) + more, acc * U64(3))
    return mix(acc), n_out


def sets_of(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each row."""
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - n : e]) for e, n in zip(ends, counts, strict=True)]
