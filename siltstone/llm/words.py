"""Words of a batch of texts and their 64-bit hashes, without a Python string for each word.

A word is a run of bytes other than space and U+0009 to U+000D, that is ``[^\\x20\\x09-\\x0D]+`` of the text. Words of up to ``SHORT`` bytes
are hashed together as polynomials, longer ones each with xxh3: a polynomial modulo 2**64 has known collisions of long, regular words.
Bytes are worked on in blocks, so what is needed beside the words themselves does not grow with the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from siltstone.llm.shared import buffers

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
SHORT, BLOCK = 64, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _geometric(base: int, n: int) -> np.ndarray:
    step = np.full(n, np.uint64(base), np.uint64)
    step[0] = 1
    return np.multiply.accumulate(step)


POWERS = _geometric(BASE, BLOCK + SHORT + 1), _geometric(pow(BASE, -1, 1 << 64), BLOCK + SHORT + 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    return POWERS if n < len(POWERS[0]) else (_geometric(BASE, n + 1), _geometric(pow(BASE, -1, 1 << 64), n + 1))


@dataclass
class Words:
    """Word i is ``data[start[i]:end[i]]`` with hash ``hash[i]``; text d has the words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = SPACE[data]
    begins, ends = ~space, ~space
    if len(data):
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = ~space[edges]
        ends[edges - 1] = ~space[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    power, inverse = POWERS
    cut = np.searchsorted(start, np.arange(0, len(data), BLOCK))
    for a, b in zip(cut, [*cut[1:], len(start)], strict=True):
        short = np.flatnonzero(end[a:b] - start[a:b] <= SHORT) + a
        if len(short):
            low, high = int(start[short[0]]), int(end[short[-1]])
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=total[1:])
            out[short] = mix((total[end[short] - low] - total[start[short] - low]) * inverse[start[short] - low])
    for i in np.flatnonzero(end - start > SHORT):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = buffers(texts)
    if lower:
        data = UPPER[data]
    start, end = _bounds(data, offsets)
    return Words(data, offsets, start, end, _hashes(data, start, end), np.searchsorted(start, offsets))


def windows_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words; element i begins at word i."""
    n = max(0, len(hashes) - k + 1)
    power = lambda j: np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64))
    # polynomials of 1, 2, 4, ... words; those that k is the sum of, one after the other
    step, size, out, done = hashes, 1, np.full(n, np.uint64(k), np.uint64), 0
    while done < k and n:
        if k & size:
            out = out * power(size) + step[done : done + n]
            done += size
        if 2 * size <= k:
            step = step[:-size] * power(size) + step[size:]
        size *= 2
    return mix(out)


def least(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` consecutive positions the one whose hash is least, the last of equals."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def later(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(hashes[y] <= hashes[x], y, x)

    at, size = np.arange(len(hashes)), 1
    while 2 * size <= window:
        at, size = later(at[:-size], at[size:]), 2 * size
    return later(at[:n], at[window - size : window - size + n])


def covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the ranges from ``low`` to ``high`` (exclusive)."""
    low, high = np.clip(low, 0, n), np.clip(high, 0, n)
    some = low < high
    return np.cumsum(np.bincount(low[some], minlength=n + 1) - np.bincount(high[some], minlength=n + 1))[:n] > 0


def spans_in_words(w: Words, spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Spans (span_start, span_end) in bytes of the only text of ``w``: the first word of each and the word after its last; none if null."""
    if spans.values is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = (x.to_numpy() for x in spans.values.flatten())
    return np.searchsorted(w.start, start), np.searchsorted(w.end, end, "right")


def shingle_sets(texts: pa.Array, k: int):
    """For each text the sorted distinct hashes of its k-word shingles, of the whole sequence if it has fewer words."""
    w = words(texts, lower=True)
    every = windows_of(w.hash, k)
    for d in range(len(w.first) - 1):
        a, b = w.first[d], w.first[d + 1]
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield windows_of(w.hash[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)
