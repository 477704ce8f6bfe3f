"""Hashes of words and word n-grams of a batch of texts, in numpy, without an object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: White space of the n-gram join: blank, tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: What separates the words of passages: every ASCII character that is neither a letter nor a digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_RNG = np.random.default_rng(20240229)
_START, _STEP = (_RNG.integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: The low bytes of a little-endian piece of eight that belong to a span which has so many left.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each); nulls count as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def eights(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on, as one little-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, after replacing bytes by ``table``: equal spans have equal hashes wherever they are.

    Eight bytes at a time are mixed into the state, which no fixed pattern of bytes undoes (as the sum of a polynomial's
    terms modulo 2**64 would let one do); spans of the same length up to eight never clash.
    """
    data = table[data]
    eight = eights(data)
    size = end - start
    h = mixed(size.astype(np.uint64) * np.uint64(_STEP) + np.uint64(_START))
    h = mixed(h ^ (eight[start] & _LOW[np.minimum(size, 8)]))
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, LONG, 8):
        if not len(rest):
            break
        piece = eight[start[rest] + k] & _LOW[np.minimum(size[rest] - k, 8)]
        h[rest] = mixed((h[rest] + np.uint64(_STEP)) ^ mixed(piece * np.uint64(_START)))
        rest = rest[size[rest] > k + 8]
    long = np.flatnonzero(size > LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(view[a:b], _START) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word with A-Z in lower case, first byte of each word, number of words of each text)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offsets[1:][offsets[1:] > 0]
    after[ends - 1] = False
    end = np.flatnonzero(inside & ~after)
    return span_hashes(data, start, end + 1, FOLD), start, np.diff(np.searchsorted(start, offsets))


def grams(value: np.ndarray, number: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, its first word, number of n-grams of each text); ``short``: a text of fewer words is one n-gram."""
    first = np.cumsum(number) - number
    count = np.maximum(number - n + 1, 0)
    total = int(count.sum())
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h += value[at + k] * _PLACE[k]
    h = mixed(h)
    few = np.flatnonzero((number > 0) & (number < n)) if short else np.zeros(0, np.int64)
    if len(few):
        own = np.array([int(mixed(np.array([(value[f : f + m] * _PLACE[8 : 8 + m]).sum(dtype=np.uint64) + np.uint64(m)]))[0]) for f, m in zip(first[few].tolist(), number[few].tolist(), strict=True)], np.uint64)
        put = (np.cumsum(count) - count)[few]
        h, at = np.insert(h, put, own), np.insert(at, put, first[few])
        count = count.copy()
        count[few] = 1
    return h, at, count


def gram_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams of each text in ascending order, one text after the other; how many each has)."""
    value, _, number = words(*raw(texts), SPACES)
    h, _, count = grams(value, number, n)
    sets, sizes, at = [], np.zeros(len(count), np.int64), 0
    for i, c in enumerate(count.tolist()):
        if c:
            own = np.unique(h[at : at + c])
            sets.append(own)
            sizes[i] = len(own)
            at += c
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes
