"""Vectorised text kernels shared by the operators: words, hashes, shingles over Arrow string arrays.

Every function takes whole texts. A null text counts as empty. Work goes chunk by chunk (about ``CHUNK`` bytes,
always whole documents), so memory follows the chunk and the longest single document, not the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U = np.uint64

# White space of the word pattern [^\x20\x09-\x0D]+
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LONG = 64
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: bijective, well spread."""
    x = x + U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(NamedTuple):
    """Words of consecutive documents: byte ranges into ``data``; document i owns words first[i]:first[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool, seed: int = 0) -> np.ndarray:
        """A hash per word, eight bytes at a time; words of one size up to eight bytes never share one. Seeds are independent."""
        data = LOWER[self.data] if lower else self.data
        blocks = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        sizes = self.ends - self.starts
        out = mix(sizes.astype(U), seed)
        rows = np.flatnonzero(sizes <= _LONG)
        at, left = self.starts[rows], sizes[rows]
        while len(rows):
            out[rows] = mix(out[rows] ^ (blocks[at] & _MASKS[np.minimum(left, 8)]), seed)
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(sizes > _LONG):
            word = data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([seed])).digest(), "little")
        return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each of its values starts and ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(texts: pa.Array) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of every text, on the UTF-8 bytes."""
    data, at = buffers(texts)
    word = ~IS_SPACE[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = word[edge]  # a document begins here
    stops[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of ``column`` each."""
    _, at = buffers(batch.column(column))
    row = 0
    while row < len(batch):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words inside one document: hash, index of the first word, and bounds per document."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    out = hashes[: n - k + 1].copy()
    for j in range(1, k):
        out *= U(0xD6E8FEB86659FD93)
        out += hashes[j : n - k + 1 + j]
    stops = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n - k + 1) + k <= stops[: n - k + 1])
    return mix(out[at], 1), at, np.searchsorted(at, first)


def run_indices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)


def same_bytes(one: np.ndarray, one_at: np.ndarray, two: np.ndarray, two_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each run of non-zero size in ``one`` has the bytes of the one in ``two``."""
    if not len(sizes):
        return np.zeros(0, bool)
    equal = one[run_indices(one_at, sizes)] == two[run_indices(two_at, sizes)]
    return np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: all bytes, and bounds per document."""
    data = words.data.copy()
    chosen = np.zeros(len(data) + 1, np.int8)
    starts, ends = words.starts[keep], words.ends[keep]
    chosen[starts] += 1
    np.subtract.at(chosen, ends, 1)
    mask = np.cumsum(chosen[:-1], dtype=np.int8).astype(bool)
    before = np.concatenate([[0], np.cumsum(keep)])[words.first]  # kept words before each document
    last = np.zeros(len(starts), bool)
    last[before[1:][before[1:] > before[:-1]] - 1] = True
    gaps = ends[~last]
    data[gaps] = 0x20
    mask[gaps] = True
    sizes = ends - starts + ~last
    return data[mask], np.concatenate([[0], np.cumsum(sizes)])[before]
