"""Arrow batches of texts as flat byte buffers, and words found in them.

A batch becomes one ``uint8`` array and its row offsets, so that words, hashes
and shingles of all rows come from a few vector operations instead of a Python
loop over rows. Slices hold about ``SLICE_BYTES`` of text, or one row if that
is longer, which bounds the temporary arrays.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. These bytes
never occur inside a multi-byte UTF-8 character, so byte runs and character
runs are the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the one of SplitMix64)."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def salted(seed: int) -> np.uint64:
    return U((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)


@dataclass
class Texts:
    """Rows of one slice: ``data[offsets[i]:offsets[i + 1]]`` is row i; null is empty."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a slice: byte ranges, hashes, and ``first[i]:first[i + 1]`` for row i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut batches so that each slice has at most SLICE_BYTES of text or one row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(at, to - at), flat(texts.slice(at, to - at))
            at = to
    released()


def released() -> None:
    """Give freed memory back at a task's end: workers are reused, and what they hold counts in their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def flat(texts: pa.Array) -> Texts:
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    valid = np.ones(n, bool) if not texts.null_count else texts.is_valid().to_numpy(zero_copy_only=False)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    if not valid.all() and sizes[~valid].any():  # a null may still own bytes
        keep = np.repeat(valid, sizes)
        data, sizes = data[keep], np.where(valid, sizes, 0)
    return Texts(data, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), valid)


#: Words up to so many bytes are hashed side by side, longer ones one by one.
LONG_WORD = 64
#: The low 0 to 8 bytes of a 64-bit integer.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of ``data``.

    Eight bytes at a time go through a bijective mixer whose state holds all bytes
    before, so that no family of words meets by construction (as it would under a
    polynomial modulo 2^64); words of equal length up to eight bytes never meet.
    """
    out = np.zeros(len(start), U)
    if not len(start):
        return out
    size = (end - start).astype(np.int64)
    with np.errstate(over="ignore"):
        out[:] = mix(size.astype(U) * _M2 + salted(5))
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] ^= U(xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes()))
        left = np.flatnonzero(size <= LONG_WORD)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        for at in range(0, LONG_WORD, 8):
            left = left[size[left] > at]
            if not len(left):
                break
            part = eights[start[left] + at] & _LOW[np.minimum(size[left] - at, 8)]
            out[left] = mix(out[left] ^ part)
        return out


def words(texts: Texts, data: np.ndarray | None = None) -> Words:
    """The words of every row; ``data`` may be a byte-for-byte mapping of the texts."""
    data = texts.data if data is None else data
    inside = ~SEPARATOR[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    before = np.concatenate([np.zeros(1, bool), inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], np.zeros(1, bool)]) if n else inside
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1 : n + 1])) + 1
    return Words(start, end, range_hash(data, start, end), np.searchsorted(start, texts.offsets))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they stay in the row."""
    h, n = w.hash, len(w.hash)
    row_end = np.repeat(w.first[1:], np.diff(w.first))
    whole = np.arange(n) + size <= row_end
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for k in range(min(size, n)):
            part = h[k:] * salted(k + 1)
            out[: n - k] += (part ^ (part >> U(29))) * _M1
    return mix(out), whole


