"""Words of whole texts as 64-bit hashes, for the tasks that work on Arrow batches.

A batch is cut into runs of rows of a few megabytes; each run is split into words and hashed by
NumPy at once, eight bytes of every word at a time. Equal words have equal hashes; two of a billion
different words share one with a chance of about 3 in 100.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 2 << 20
LONG_WORD = 1024
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)

#: glibc's function that returns free pages; other C libraries have none.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space; or letters, digits and all that is not ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(29))


@dataclass
class Run:
    """Consecutive rows of a batch: the words of row i are those from ptr[i] to ptr[i + 1]."""

    first: int
    rows: int
    text: np.ndarray  # lower-cased bytes, and eight more
    at: np.ndarray  # of each row's first byte, and the end
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.ptr))

    def word(self, i: int) -> bytes:
        return self.text[self.start[i] : self.start[i] + self.length[i]].tobytes()


def tidy() -> None:
    """Gives freed memory back, so that a worker which waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def hash_words(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """text must have eight bytes more than the last word needs."""
    h = length.astype(np.uint64) * M1
    lanes = np.ndarray((max(len(text) - 7, 0),), dtype="<u8", buffer=text, strides=(1,))
    which, k, most = np.arange(len(start)), 0, int(length.max(initial=0))
    long = np.flatnonzero(length > LONG_WORD) if most > LONG_WORD else np.zeros(0, np.int64)
    if len(long):
        which = np.flatnonzero(length <= LONG_WORD)
    while len(which):
        left = length[which] - k
        v = lanes[start[which] + k] & KEEP[np.minimum(left, 8)]
        x = (h[which] ^ v) * M1
        h[which] = x ^ (x >> np.uint64(31))
        which, k = which[left > 8], k + 8
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(text[start[i] : start[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def hash_of(word: bytes) -> int:
    text = np.frombuffer(word + bytes(8), dtype=np.uint8)
    return int(hash_words(text, np.array([0]), np.array([len(word)]))[0])


def runs(column: pa.Array, kept: np.ndarray = NOT_SPACE, most: int = RUN_BYTES) -> Iterator[Run]:
    data, at = raw(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        last = min(last, n)
        lo, hi = int(at[first]), int(at[last])
        text = np.zeros(hi - lo + 8, dtype=np.uint8)
        np.take(LOWER, data[lo:hi], out=text[: hi - lo])
        inside = np.take(kept, text[: hi - lo])
        offsets = at[first : last + 1] - lo
        edge = np.zeros(hi - lo + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        length = end - start
        yield Run(first, last - first, text, offsets, start, length, hash_words(text, start, length), np.searchsorted(start, offsets))
        first = last
    tidy()


def shingles(run: Run, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word shingles, in order, and their pointers; a row of fewer words, but not none, has one."""
    h, count = run.hash, np.diff(run.ptr)
    short = (count > 0) & (count < n)
    made = np.where(count >= n, count - n + 1, short.astype(count.dtype))
    ptr = np.concatenate([[0], np.cumsum(made)])
    if not len(h):
        return np.zeros(0, np.uint64), ptr
    padded = np.concatenate([h, np.zeros(n - 1, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    for k in range(n):
        total += padded[k : k + len(h)] * STEPS[k % len(STEPS)] + np.uint64(k)
        if k % len(STEPS) == len(STEPS) - 1:
            total = mix(total)
    all_of = mix(total)
    row = run.row_of()
    keep = np.arange(len(h)) - run.ptr[row] < made[row]
    out = all_of[keep]
    for i in np.flatnonzero(short):
        own = h[run.ptr[i] : run.ptr[i + 1]]
        total = np.uint64(len(own))
        with np.errstate(over="ignore"):
            for k, x in enumerate(own):
                total = total * M1 + x * STEPS[k % len(STEPS)]
        out[ptr[i]] = mix(np.array([total], np.uint64))[0]
    return out, ptr
