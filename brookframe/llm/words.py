"""Vectorised words and hashes over the UTF-8 bytes of many texts at once.

A word is a run of bytes outside \\x20 and \\x09-\\x0D. A word's hash sums a pseudo-random number for each byte and its
place; a window's hash is a polynomial modulo the prime 2**61 - 1 over its words' hashes, by prefix sums, so that every
window of k words costs the same, whatever k is. Neither has the families of collisions that a polynomial modulo a power of
two has. Where equal hashes are to mean equal words, exact_sets compares the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PRIME = (1 << 61) - 1
_BASE = 0x0D6E8FEB86659FD9
_POWERS: dict[int, np.ndarray] = {}
_PLACES = 64  # places of a word whose numbers are in a table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(place_and_byte: np.ndarray) -> np.ndarray:
    return mix(mix(place_and_byte.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x5851F42D4C957F2D)))


_TABLE = _numbers(np.arange(_PLACES << 8))


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**64."""
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves of 31 bits: 2**62 is 2 and 2**61 is 1."""
    low, half, thirty = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(30)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _reduce(((a1 * b1) << np.uint64(1)) + (middle >> thirty) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime; kept and grown."""
    have = _POWERS.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, _times(have, np.uint64(pow(base, len(have), _PRIME)))])
    _POWERS[base] = have
    return have[:n]


def text_slices(column: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about max_bytes at most; a null text is empty. One longer text is a run of its own."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def split_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each text (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= edge[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [starts, ends), which follow each other without overlap."""
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(starts), 8192):  # blocks that stay in the processor's cache
        a, b = starts[i : i + 8192], ends[i : i + 8192]
        first, last = int(a[0]), int(b[-1])
        begin = (a - first).astype(np.int32)
        place = np.arange(last - first, dtype=np.int32) - np.repeat(begin, np.diff(np.r_[begin, last - first]))
        code = place << 8 | buf[first:last]
        far = np.flatnonzero(place >= _PLACES) if last - first > _PLACES else ()
        if len(far):
            number = _TABLE.take(code, mode="clip")
            number[far] = _numbers(place[far].astype(np.int64) << 8 | buf[first:last][far])
        else:
            number = _TABLE.take(code)
        sums = np.zeros(len(number) + 1, np.uint64)
        np.cumsum(number, out=sums[1:])
        out.append(mix(sums[b - first] - sums[a - first] + (b - a).astype(np.uint64)))
    return np.concatenate(out)


def window_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [first, last) of hashed words."""
    if not len(first):
        return np.zeros(0, np.uint64)
    n = len(words)
    terms = _times(_reduce(words), _powers(_BASE, n))
    low, high = np.cumsum(terms & np.uint64(0xFFFFFFFF)), np.cumsum(terms >> np.uint64(32))
    sums = np.zeros(n + 1, np.uint64)
    sums[1:] = _reduce(_reduce(low) + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))
    between = _reduce(sums[last] + np.uint64(_PRIME) - sums[first])
    return mix(_times(between, _powers(pow(_BASE, -1, _PRIME), n + 1)[first]) + (last - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _word_types(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only: words of equal hashes are compared byte by byte."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, shown, types = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    twin, size = shown[types], ends - starts
    if (size == size[twin]).all():
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(starts - begin, size)
        if (buf[at] == buf[at + np.repeat(starts[twin] - starts, size)]).all():
            return types
    known: dict[bytes, int] = {}
    raw = buf.tobytes()
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def exact_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text (all words as one if there are fewer) in lower case, as numbers.

    Within one call, numbers are equal if and only if the shingles' words are: those with equal hashes are compared.
    """
    parts = list(text_slices(column, 1 << 62))
    if not parts:
        return []
    (_, buf, offs), = parts
    buf = LOWER[buf]
    starts, ends, first = split_words(buf, offs)
    types, count = _word_types(buf, starts, ends), np.diff(first)
    shingles = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    own = np.repeat(np.arange(len(count)), shingles)
    begin = np.cumsum(shingles) - shingles
    at = np.arange(shingles.sum()) + np.repeat(first[:-1] - begin, shingles)
    last = np.minimum(at + k, first[1:][own])
    hashes = window_hashes(mix(types.astype(np.uint64) + np.uint64(1)), at, last)
    _, shown, found = np.unique(hashes, return_index=True, return_inverse=True)
    padded = np.r_[types, np.full(k, -1)]
    rows = np.stack([np.where(at + i < last, padded[at + i], -1) for i in range(k)], axis=1) if len(at) else np.zeros((0, k), np.int64)
    if (rows != rows[shown[found]]).any():
        found = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    most = int(found.max()) + 1 if len(found) else 1
    both = np.unique(own * most + found)
    return np.split(both % most, np.searchsorted(both, np.arange(1, len(count)) * most))
