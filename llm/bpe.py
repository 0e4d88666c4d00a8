"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Encoding cuts texts into the vocabulary's pre-tokens by classes of code points, then merges the distinct pre-tokens of
a batch together: their symbols lie in one flat array, each round finds every pair's rank by binary search over the
sorted pair keys, merges the lowest rank of each word, and closes the gaps. Seen pre-tokens are kept in a table of
fixed size per worker, found by a hash and compared by their bytes. Memory follows the chunk and the longest text.

The result equals the tokenizers library's for a byte-level BPE file without normaliser: added tokens are cut out
first, ids are whole texts', no special tokens are added.

Nulls: a null text encodes as an empty one, a null id list decodes to an empty text. Empty tables give empty results.
Repeated rows and null ids pass through. Other columns are kept, except one that has the output's name: it is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import map_arrow, spare_name
from llm.kernel import U, Words, buffers, chunks, run_indices, same_bytes

_LETTER, _NUMBER, _BLANK, _OTHER = 0, 1, 2, 3
_SLOTS = 1 << 19
_STORE, _SPELT = 1 << 22, 1 << 23
_IDS = 1 << 16
_NONE = np.iinfo(np.int64).max
# The contractions of the pre-token pattern, and the printable code points that stand for their own byte
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point in the pattern of pre-tokens."""
    out = np.full(0x110000, _OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[shift[m.start() : m.end()]] = kind
    return out


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    out, spare = {b: chr(b) for b in PRINTABLE}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


def token_starts(points: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of consecutive texts; ``doc`` marks each text's first code point."""
    n = len(points)
    kind = classes()[points]
    new = doc.copy()
    new[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    space = points == 32
    after = np.ones(n, bool)  # the text ends after this code point
    after[:-1] = doc[1:]
    start = new & ~blank
    led = np.zeros(n, bool)  # the code point before is a space of the same text
    led[1:] = space[:-1] & ~doc[1:]
    start &= ~led
    start |= new & blank  # a blank run begins
    last = np.zeros(n, bool)  # last blank of a run that something follows
    last[:-1] = blank[:-1] & ~blank[1:] & ~doc[1:]
    start |= last
    # contractions: an apostrophe that opens a pre-token, then one or two letters of fixed forms
    quote = np.flatnonzero((points == 39) & new & ~led & ~after)
    if len(quote):
        padded = np.append(points, [0, 0])
        inside = np.append(~doc, [False, False])
        one, two = padded[quote + 1], padded[quote + 2]
        single = np.isin(one, [ord(c) for c in CONTRACTIONS if len(c) == 1])
        double = np.zeros(len(quote), bool)
        for c in CONTRACTIONS:
            if len(c) == 2:
                double |= (one == ord(c[0])) & (two == ord(c[1])) & inside[quote + 2]
        for at, size in ((quote[single], 1), (quote[double & ~single], 2)):
            start[at + 1] = False
            rest = at + 1 + size
            rest = rest[rest < n]
            start[rest[(kind[rest] == _LETTER) & ~doc[rest]]] = True
    return start


def _distinct(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for all distinct words, and which of them each row is; a word that only shares a hash stands for itself."""
    _, pick, back = np.unique(hashes, return_index=True, return_inverse=True)
    alike = sizes == sizes[pick[back]]
    long = np.flatnonzero(alike & (sizes > 8))
    alike[long] = same_bytes(raw, starts[long], raw, starts[pick[back[long]]], sizes[long])
    odd = np.flatnonzero(~alike)
    back[odd] = len(pick) + np.arange(len(odd))
    return np.concatenate([pick, odd]), back


class Vocabulary:
    """Merge table of a tokenizers file, and the pre-tokens it has already encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[c] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.by_rank = np.array([vocab[a + b] for a, b in pairs], np.int64)
        both = self.byte_ids[:, None] * self.size + self.byte_ids[None, :]
        found = np.minimum(np.searchsorted(self.keys, both), len(self.keys) - 1)
        self.byte_ranks = np.where(self.keys[found] == both, self.ranks[found], _NONE)
        back = {c: b for b, c in enumerate(symbols)}
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.piece_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.slot_key = np.zeros(_SLOTS, U)
        self.slot_size = np.full(_SLOTS, -1, np.int32)
        self.slot_at = np.zeros(_SLOTS, np.int64)
        self.slot_n = np.zeros(_SLOTS, np.int32)
        self.slot_word = np.zeros(_SLOTS, np.int64)
        self.words, self.spelt = np.zeros(1 << 20, np.uint8), 0
        self.store = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def merge(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the non-empty words data[at[i]:at[i+1]] and how many each has."""
        count = len(at) - 1
        symbols = self.byte_ids[data]
        owner = np.repeat(np.arange(count), np.diff(at))
        place = np.arange(len(symbols))
        rank = np.full(len(symbols), _NONE)
        inner = np.ones(len(symbols), bool)
        inner[at[1:] - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner] = self.byte_ranks[data[inner], data[inner + 1]]
        done = []
        while len(symbols):
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(owner)))
            if (best == _NONE).any():  # these words are finished
                over = np.repeat(best == _NONE, sizes)
                done.append((owner[over], symbols[over], place[over]))
                symbols, owner, place, rank = symbols[~over], owner[~over], place[~over], rank[~over]
                going = best != _NONE
                best, sizes = best[going], sizes[going]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, sizes)
            first = hit.copy()
            first[1:] &= ~hit[:-1]
            if not (first == hit).all():  # in a run of overlapping pairs every other one merges, from the left
                index = np.arange(len(hit))
                hit &= (index - np.maximum.accumulate(np.where(first, index, -1))) % 2 == 0
            at_hit = np.flatnonzero(hit)
            symbols[at_hit] = self.by_rank[rank[at_hit]]
            keep = np.ones(len(symbols), bool)
            keep[at_hit + 1] = False
            fresh = np.cumsum(keep)[at_hit] - 1  # where the merged symbols are once the gaps are closed
            symbols, owner, place, rank = symbols[keep], owner[keep], place[keep], rank[keep]
            mark = np.zeros(len(symbols), bool)
            mark[fresh] = True
            mark[np.maximum(fresh - 1, 0)] = True
            fresh = np.flatnonzero(mark)
            after = np.minimum(fresh + 1, len(symbols) - 1)
            key = np.where((owner[fresh] == owner[after]) & (after > fresh), symbols[fresh] * self.size + symbols[after], -1)
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[fresh] = np.where(self.keys[found] == key, self.ranks[found], _NONE)
        owner, symbols, place = map(np.concatenate, zip(*done))
        order = np.argsort(place)
        return symbols[order].astype(np.uint32), np.bincount(owner, minlength=count)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their bounds."""
        raw, at = buffers(texts)
        if self.split is not None and any(t.encode() in raw.tobytes() for t in self.added):
            return self._encode_added(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.zeros(len(points), bool)
        firsts = np.searchsorted(lead, at)
        doc[firsts[:-1][firsts[:-1] < len(points)]] = True
        starts = lead[token_starts(points, doc)]
        ends = np.append(starts[1:], len(raw))
        words = Words(raw, starts, ends, np.searchsorted(starts, at))
        hashes, sizes = words.hashes(False), (ends - starts).astype(np.int32)
        slot = (hashes & U(_SLOTS - 1)).astype(np.int64)
        miss = (self.slot_key[slot] != hashes) | (self.slot_size[slot] != sizes)
        long = np.flatnonzero(~miss & (sizes > 8))  # up to eight bytes, the hash is the word
        miss[long] = ~same_bytes(raw, starts[long], self.words, self.slot_word[slot[long]], sizes[long].astype(np.int64))
        token_at, token_n = self.slot_at[slot], self.slot_n[slot]
        if miss.any():
            rows = np.flatnonzero(miss)
            first, back = _distinct(raw, starts[rows], sizes[rows].astype(np.int64), hashes[rows])
            first = rows[first]
            lengths = sizes[first].astype(np.int64)
            data = raw[run_indices(starts[first], lengths)]
            ids, n = self.merge(data, np.concatenate([[0], np.cumsum(lengths)]))
            if self.used + len(ids) > _STORE or self.spelt + len(data) > _SPELT:
                # what this batch found in the store moves to the front of a new one
                hit = np.flatnonzero(~miss)
                own = self.store[run_indices(token_at[hit], token_n[hit].astype(np.int64))]
                self._forget()
                token_at[hit] = np.cumsum(token_n[hit]) - token_n[hit]
                self._add(own)
            base = self._add(ids)
            where = base + np.cumsum(n) - n
            token_at[rows], token_n[rows] = where[back], n[back]
            if self.spelt + len(data) <= _SPELT:
                own = slot[first]
                self.slot_key[own], self.slot_size[own] = hashes[first], sizes[first]
                self.slot_at[own], self.slot_n[own] = where, n
                self.slot_word[own] = self.spelt + np.cumsum(lengths) - lengths
                self._spell(data)
        counts = token_n.astype(np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.store[run_indices(token_at, counts)], total[words.first]

    def _add(self, ids: np.ndarray) -> int:
        base = self.used
        if base + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(len(self.store), len(ids)), np.uint32)])
        self.store[base : base + len(ids)] = ids
        self.used = base + len(ids)
        return base

    def _spell(self, data: np.ndarray) -> None:
        if self.spelt + len(data) > len(self.words):
            self.words = np.concatenate([self.words, np.zeros(max(len(self.words), len(data)), np.uint8)])
        self.words[self.spelt : self.spelt + len(data)] = data
        self.spelt += len(data)

    def _encode_added(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, kinds, counts = [], [], []
        for text in texts.to_pylist():
            text, at, n = text or "", 0, len(pieces)
            for m in self.split.finditer(text):
                pieces += [text[at : m.start()], ""]
                kinds += [-1, self.added[m.group()]]
                at = m.end()
            pieces.append(text[at:])
            kinds.append(-1)
            counts.append(len(pieces) - n)
        split, self.split = self.split, None
        try:
            ids, bounds = self.encode(pa.array(pieces, pa.large_string()))
        finally:
            self.split = split
        kinds = np.array(kinds)
        sizes = np.where(kinds >= 0, 1, np.diff(bounds))
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(total[-1], np.uint32)
        plain = kinds < 0
        out[run_indices(total[:-1][plain], sizes[plain])] = ids
        out[total[:-1][~plain]] = kinds[~plain]
        return out, total[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id lists, one after another, and their bounds."""
        sizes = self.piece_at[ids.astype(np.int64) + 1] - self.piece_at[ids]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[at]
        return self.piece_bytes[run_indices(self.piece_at[ids], sizes)], bounds


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def id_lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with ``ids_col`` (array<int>): the ids of the whole text."""
    source = df.drop(ids_col) if ids_col != text_col else df
    kept = [c for c in source.columns if c != ids_col]
    text = spare_name(source)
    work_text = source.withColumn(text, F.col(f"`{text_col}`").cast("string"))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for part in chunks(batch, text):
                ids, at = known.encode(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), id_lists(ids, at)], names=[*kept, ids_col])

    return map_arrow(work_text, work, schema)


def _some_ids(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``_IDS`` ids each."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0)
    at = np.concatenate([[0], np.cumsum(np.asarray(sizes).astype(np.int64) + 1)])
    row = 0
    while row < len(batch):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + _IDS, side="right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with ``text_col``: the text of the ids; ids outside the vocabulary are nothing, broken UTF-8 is replaced."""
    source = df.drop(text_col) if text_col != ids_col else df
    kept = [c for c in source.columns if c != text_col]
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(text_col, T.StringType())])
    held = spare_name(source)
    work_ids = source.withColumn(held, F.col(f"`{ids_col}`").cast("array<int>"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for part in _some_ids(batch, held):
                lists = part.column(held)
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
                ids = lists.flatten()
                valid = np.asarray(pa.compute.fill_null(ids, -1))
                good = (valid >= 0) & (valid < known.size)
                bounds = np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], np.cumsum(sizes)])]
                data, at = known.decode(valid[good], bounds)
                raw = data.tobytes()
                texts = pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(at.tolist(), at[1:].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), texts], names=[*kept, text_col])

    return map_arrow(work_ids, work, schema)
