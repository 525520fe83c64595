"""Vectorised word, shingle and line arithmetic on Arrow string buffers.

Documents of a batch lie in one UTF-8 byte array. Words are found and hashed
with whole-array numpy steps, so the cost per word holds no Python object.
All hashes are fixed functions of the bytes: they agree between workers,
runs and machines.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: Masks of the first n bytes of a lane, and the range length from which hashing goes range by range.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
LONG = 128
#: Bytes of text handled at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 3 << 20

_white = np.zeros(256, bool)
_white[[0x20, 9, 10, 11, 12, 13]] = True
#: Byte tables: which bytes belong to a word.
NON_SPACE = ~_white
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together, one at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of the documents of one chunk.

    start, end: byte positions in ``buf``; first (n_docs + 1): index of each
    document's first word; hash: 64-bit hash of each word's bytes.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray = NON_SPACE, fold: bool = False, hashed: bool = True):
        self.n_docs, self.offs = len(offs) - 1, offs
        self.buf = buf = LOWER[buf] if fold else buf
        inside = np.zeros(len(buf) + 1, bool)
        inside[:-1] = table[buf]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        stops = np.zeros(len(buf) + 1, bool)
        stops[1:] = inside[:-1] & ~inside[1:]
        cuts = offs[1:-1]  # a word ends where its document does
        cuts = cuts[(cuts > 0) & (cuts < len(buf))]
        cuts = cuts[inside[cuts] & inside[cuts - 1]]
        starts[cuts] = stops[cuts] = True
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, offs)
        if hashed:
            self.hash = span_hash(buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts())


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one value, zeros behind the end."""
    return np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(15, np.uint8)]), strides=(1,))


def span_ends(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second value of each byte range, from its size and its first and last eight bytes, to hold against span_hash."""
    lanes, size = _lanes(buf), end - start
    keep = _KEEP[np.minimum(size, 8)]
    return mix((lanes[start] & keep) + _Q) * _P + (lanes[np.maximum(end - 8, start)] & keep) + size.astype(U64)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: its eight-byte lanes, each mixed into the state before.

    Ranges of one length up to eight bytes never collide. Ranges over ``LONG`` bytes go through BLAKE2.
    """
    size = end - start
    state = mix(size.astype(U64) * _P)
    lanes, short = _lanes(buf), size <= LONG
    at, live = 0, np.flatnonzero(short & (size > 0))
    while len(live):
        rest = np.minimum(size[live] - at, 8).astype(np.int64)
        state[live] = mix(state[live] ^ (lanes[start[live] + at] & _KEEP[rest]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(~short):
        state[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return state


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return mix(mix(left + _P) * _Q + right)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; run i starts at value i. Runs are joined from runs of powers of two."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, U64)
    out, done, power, size = None, 0, words, 1
    while True:
        if k & size:
            own = power[done : done + n]
            out = own if out is None else _joined(out, own)
            done += size
        if done == k:
            return mix(out + U64(k))
        power = _joined(power[:-size], power[size:])
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours; element i covers x[i : i + w]."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def utf8_lengths(buf: np.ndarray) -> np.ndarray:
    """Cumulated count of code points before each byte position (n + 1)."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def give_back() -> None:
    """Return memory that a finished task has freed to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def binary_array(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary())
