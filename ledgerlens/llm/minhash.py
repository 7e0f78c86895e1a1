"""One-permutation MinHash over hashed word shingles, vectorised over whole texts.

All shingle hashes of a text are binned once by their top bits; the smallest hash of each bin is
its value. An empty bin takes the value of the first filled bin in a pseudo-random sequence of its
own, the same for all texts, so equal bins stay equally likely as the sets' similarity
(optimal densification). A signature of a text without shingles does not exist.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np

BINS = 128
SPACES = b" \t\n\r\x0b\x0c"
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A pseudo-random 64-bit value per byte, with A-Z as a-z.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Bytes hashed at once.
PIECE = 1 << 17
BASE = 0x9FB21C651E98DF25


@functools.lru_cache(maxsize=3)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, BASE, _U), np.full(n, pow(BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand."""
    up, down = powers(1 << max(16, len(data).bit_length()))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mixed((total[stops] - total[starts]) * down[starts])


def words_between(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between gaps."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def pieces(gap: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut long texts at gaps, into pieces of about ``PIECE`` bytes."""
    at = 0
    while at < len(gap):
        stop = len(gap)
        if stop - at > PIECE:
            gaps = np.flatnonzero(gap[at + PIECE :])
            stop = at + PIECE + int(gaps[0]) if len(gaps) else stop
        yield at, stop
        at = stop


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word of a text, A-Z lower-cased; words stand between ASCII white space."""
    data = np.frombuffer(text.encode(), np.uint8)
    gap = IS_SPACE[data]
    return np.concatenate([np.empty(0, _U), *[span_hashes(data[a:b], *words_between(gap[a:b])) for a, b in pieces(gap)]])


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole sequence if it is shorter."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(words, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mixed(out + _U(i)) ^ h[i : len(h) - k + 1 + i]
    if k < words:
        out = mixed(out + _U(1 << 20 | k))  # a short sequence is no shingle of a longer text
    return np.unique(mixed(out))


@functools.lru_cache(maxsize=2)
def sequences(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the other bins."""
    i, j = np.meshgrid(np.arange(bins, dtype=_U), np.arange(bins, dtype=_U), indexing="ij")
    return np.argsort(mixed((i * _U(1 << 20) + j) * _U(0x9E3779B97F4A7C15) + _U(77)), axis=1, kind="stable").astype(np.int16)


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified one-permutation signature of a sorted, non-empty set; ``bins`` is a power of two."""
    shift = _U(64 - bins.bit_length() + 1)
    at = np.searchsorted(hashes, np.arange(bins, dtype=_U) << shift)
    at[at == len(hashes)] = 0
    out = hashes[at]
    filled = out >> shift == np.arange(bins, dtype=_U)
    if not filled.all():
        order = sequences(bins)
        empty = np.flatnonzero(~filled)
        asked = order[empty]
        out[empty] = out[asked[np.arange(len(empty)), filled[asked].argmax(axis=1)]]
    return out


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One bucket key per band of ``rows`` bins."""
    n = len(sig) // rows
    out = np.arange(n, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for i in range(rows):
        out = mixed(out ^ sig[i : n * rows : rows] + _U(i))
    return out


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
