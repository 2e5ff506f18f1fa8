"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space and \\x09-\\x0D of the UTF-8 text with A-Z lower-cased. A word's hash is a
polynomial over random values of its bytes modulo 2**64, finished by a mixing step; it is the same in every process.
Two of n different words share a hash with probability of about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


#: As _LOWER, but only letters, digits and bytes from 128 on belong to words.
ALNUM = np.full(256, 32, np.uint8)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
ALNUM[65:91] = np.arange(97, 123)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, in order, and where each text's words begin (one more than texts)."""
    (hashes,), offsets = run_hashes(texts, _LOWER, (None,))
    return hashes, offsets


def run_hashes(texts: list[bytes], table: np.ndarray, prefixes: tuple[int | None, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words that `table` (byte -> byte, 32 between words) leaves: of their first so many bytes, or of all (None)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    if not len(buf):
        return [np.zeros(0, U64) for _ in prefixes], np.zeros(len(texts) + 1, np.int64)
    low = table[buf]
    change = np.diff(low != 32, prepend=False).nonzero()[0]
    starts, ends = change[0::2], change[1::2]
    powers, inverse = power_tables(len(buf))
    total = np.cumsum(_VALUE[low] * powers[: len(buf)])
    before = np.where(starts > 0, total[starts - 1], U64(0))
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[1:] = np.searchsorted(starts, np.cumsum(lengths), side="left")
    out = []
    for n in prefixes:
        last = ends if n is None else np.minimum(ends, starts + n)
        out.append(mix((total[last - 1] - before) * inverse[starts]))
    return out, offsets


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words within a text, and where each text's runs begin. Shorter texts: all their words as one run."""
    counts = np.diff(offsets)
    if not len(words):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    keep = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(keep)])
    padded = np.concatenate([words, np.zeros(n, U64)])
    doc = np.repeat(np.arange(len(counts)), keep)
    at = np.arange(out_offsets[-1]) - out_offsets[doc] + offsets[doc]
    left = offsets[doc + 1] - at
    h = np.full(len(at), 0x2545F4914F6CDD1D, dtype=U64)
    for i in range(n):
        w = padded[at + i]
        if (left <= i).any():
            w = np.where(left > i, w, U64(i + 1))
        h = (h ^ w) * U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(33)
    return mix(h), out_offsets


def text_chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """The batch's texts as UTF-8 (null: empty), in runs of about CHUNK_BYTES: first row, end row, texts."""
    column = batch.column(text)
    values = [v or b"" for v in column.cast(pa.binary()).to_pylist()]
    first, size = 0, 0
    for i, v in enumerate(values):
        size += len(v)
        if size >= CHUNK_BYTES:
            yield first, i + 1, values[first : i + 1]
            first, size = i + 1, 0
    if first < len(values):
        yield first, len(values), values[first:]


def segments(offsets: np.ndarray) -> np.ndarray:
    """For each element, the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class Index:
    """Places of 64-bit values in a sorted array of well-mixed ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = U64(64 - max(1, int(np.log2(len(keys) + 1)) + 1))
        self.start = np.searchsorted(keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=U64)).astype(np.int32)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        out = np.full(len(values), -1, np.int64)
        if not len(self.keys):
            return out
        bucket = (values >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, want = at[left], end[left], values[left]
        while len(left):
            same = self.keys[at] == want
            out[left[same]] = at[same]
            at = at + 1
            go = ~same & (at < end)
            left, at, end, want = left[go], at[go], end[go], want[go]
        return out


def counted(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(values, return_counts=True)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.diff(values, prepend=values[:1] ^ U64(1))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts
