"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact fitting distance.

Texts and items are lower-cased and read as words: runs of letters, digits and other characters above 127. A document leaks
an item of m words if some consecutive words of it, however many, lie within floor((1 - similarity) * m) word edits of the item.

1. At most that many edits leave one run of at least q = ceil((m - edits) / (edits + 1)) words of the item as it is. So the
   candidate windows are those of the item's length whose start lies within the edits of where such a run of q
   words says; no leak can be elsewhere. Windows may reach beyond the text by the edits: pads stand there.
2. Windows and items walk by the CGK embedding: a random bit per step and symbol says whether the walk moves on, which
   maps edit distance to Hamming distance. Each repetition samples ``SAMPLED`` steps of the walk as a key. The number of
   repetitions follows from the target recall and the agreement expected at the largest distance.
3. Where a window shares a key with an item of its length, the item is fitted into the window widened by the edits of both:
   the exact distance to any words in it, with free ends, many pairs at a time.

The items are collected and sent to every task: the benchmark must be below ``MAX_ITEM_BYTES`` of text, else it is refused.

Nulls: null or wordless documents and items leak nothing. Items without id are left out, repeated items are reported by
each id once. Rows without id are judged like others; repeated rows all come out. Empty tables give empty results
or clean documents. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.kernel import U, Words, buffers, chunks, grams, mix, run_indices

SAMPLED = 2
RECALL = 0.99
AGREEMENT = 0.5  # share of equal steps expected at the largest distance
MAX_ITEM_BYTES = 64 << 20
_BATCH = 1 << 12
_CELLS = 1 << 19  # words of the texts that are fitted at a time
_HELD = 1 << 17  # windows of a batch that wait for one another
_EDIT = 1 << 32
_SPAN = 1 << 40
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def repetitions(recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT**SAMPLED))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each text's first word."""
    raw, at = buffers(texts)
    word = _WORD[raw]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begins[edge] = word[edge]
    stops[edge - 1] = word[edge - 1]
    starts = np.flatnonzero(begins)
    words = Words(raw, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at))
    return words.hashes(True), words.first


def keys(symbols: np.ndarray, count: int) -> np.ndarray:
    """LSH keys (one column per repetition) of windows of one length: sampled steps of the CGK walk."""
    n, m = symbols.shape
    rng = np.random.default_rng([m, count])
    sampled = np.stack([rng.choice(3 * m, SAMPLED, replace=False) for _ in range(count)])
    turn = rng.integers(0, 1 << 63, (3 * m, count), dtype=np.uint64)
    padded = np.concatenate([symbols, np.zeros((n, 1), U)], 1).ravel()  # beyond the end the walk sees a pad
    rows = (np.arange(n) * (m + 1))[:, None]
    place = np.zeros((n, count), np.int64)
    key = np.tile(np.arange(count, dtype=U), (n, 1))
    for step in range(int(sampled.max()) + 1):
        here = padded[rows + place]
        taken = np.flatnonzero((sampled == step).any(1))
        if len(taken):
            key[:, taken] = mix(key[:, taken] ^ here[:, taken], 40)
        coin = (here ^ turn[step]) * U(0x9E3779B97F4A7C15)
        place += ((coin >> U(61)) & U(1)).astype(np.int64)
        np.minimum(place, m, out=place)
    return key


def fit(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest word edits between each item and any words of the text beside it, and where these begin and end."""
    n, width = texts.shape
    steps = np.arange(width + 1, dtype=np.int64)
    row = np.tile(steps, (n, 1))  # edits, and in the low bits where the words begin: the earliest of equals
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + _EDIT
        new[:, 1:] = np.minimum(row[:, :-1] + _EDIT * (texts != items[:, i : i + 1]), row[:, 1:] + _EDIT)
        row = np.minimum.accumulate(new - steps * _EDIT, 1) + steps * _EDIT  # insertions run along the row
    end = np.argmin(row, 1)
    best = row[np.arange(n), end]
    return best // _EDIT, best % _EDIT, end


class Items:
    """The benchmark's items by length, with their keys and their runs of words."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float, recall: float):
        hashes, first = word_hashes(pa.array(texts, pa.large_string()))
        self.repetitions = repetitions(recall)
        self.lengths: dict[int, tuple] = {}
        runs: dict[int, list[tuple]] = {}
        sizes = np.diff(first)
        for m in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == m)
            symbols = np.stack([hashes[first[r] : first[r] + m] for r in rows])
            key = keys(symbols, self.repetitions)
            order = np.argsort(key, axis=0, kind="stable")
            edits = int((1 - similarity) * m + 1e-9)
            self.lengths[m] = (np.array([ids[r] for r in rows]), symbols, np.take_along_axis(key, order, 0), order, edits)
            q = -(-(m - edits) // (edits + 1))
            for row in symbols:
                found, at, _ = grams(row, np.array([0, m]), q)
                runs.setdefault(q, []).append((found, at, np.full(len(at), m)))
        self.runs = {}
        for q, parts in runs.items():
            found, at, m = map(np.concatenate, zip(*parts))
            order = np.argsort(found, kind="stable")
            small = np.zeros(1 << 16, bool)
            small[(found >> U(48)).astype(np.int64)] = True
            self.runs[q] = (small, found[order], at[order], m[order])

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Texts and starts of the windows that may leak an item, by length; starts count from the text's first word."""
        stops = np.repeat(first[1:], np.diff(first))
        begins = np.repeat(first[:-1], np.diff(first))
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out: dict[int, list[np.ndarray]] = {}
        for q, (small, known, offset, length) in self.runs.items():
            found, at, _ = grams(hashes, first, q)
            near = np.flatnonzero(small[(found >> U(48)).astype(np.int64)])
            found, at = found[near], at[near]
            low, high = np.searchsorted(known, found), np.searchsorted(known, found, side="right")
            rows = run_indices(low, high - low)
            place = np.repeat(at, high - low)
            for m in np.unique(length[rows]).tolist():
                own = length[rows] == m
                edits = self.lengths[m][4]
                starts = (place[own] - offset[rows[own]])[:, None] + np.arange(-edits, edits + 1)
                home = np.broadcast_to(place[own][:, None], starts.shape)
                good = (starts >= begins[home] - edits) & (starts + m <= stops[home] + edits)
                # one number for text and start: what lies before one text's words is not after another's
                out.setdefault(m, []).append(np.unique(owner[home[good]] * _SPAN + (starts - begins[home])[good] + _SPAN // 2))
        both = {m: np.unique(np.concatenate(parts)) for m, parts in out.items()}
        return {m: (x // _SPAN, x % _SPAN - _SPAN // 2) for m, x in both.items()}

    def confirm(self, m: int, held: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, item's id, edits, start, words) of the leaks in windows (words of texts, their bounds, rows, text and start of each window)."""
        ids, symbols, table, order, edits = self.lengths[m]
        hashes = np.concatenate([h for h, *_ in held])
        shift = np.cumsum([0, *(len(h) for h, *_ in held)])[:-1]
        begins = np.concatenate([f[:-1][x] + s for (_, f, _, x, _), s in zip(held, shift)])
        stops = np.concatenate([f[1:][x] + s for (_, f, _, x, _), s in zip(held, shift)])
        rows, starts = np.concatenate([r for _, _, r, *_ in held]), np.concatenate([s for *_, s in held])

        def words(at: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
            place = (begins[at] + starts)[:, None] + np.arange(width)
            inside = (place >= begins[at][:, None]) & (place < stops[at][:, None])
            return np.where(inside, hashes[np.clip(place, 0, len(hashes) - 1)], U(0))

        left, step = 2 * edits, edits + 1
        width = m + 5 * edits + step - 1  # a leak begins and ends within twice and thrice the edits of each window near its run
        size = max(1, min(_BATCH, _CELLS // width))
        for s in range(0, len(rows), _BATCH):
            at = np.arange(s, min(s + _BATCH, len(rows)))
            key, pairs = keys(words(at, starts[at], m), self.repetitions), []
            for r in range(self.repetitions):
                low, high = np.searchsorted(table[:, r], key[:, r]), np.searchsorted(table[:, r], key[:, r], side="right")
                pairs.append(np.repeat(np.arange(len(at)), high - low) * len(ids) + order[run_indices(low, high - low), r])
            both = np.unique(np.concatenate(pairs))
            near, item = at[both // len(ids)], both % len(ids)
            # windows of a text that begin close to each other are fitted once
            block = starts[near] // step * step
            _, once = np.unique(np.stack([begins[near], block, item]), axis=1, return_index=True)
            near, item, block = near[once], item[once], block[once]
            for c in range(0, len(near), size):
                own, b, i = near[c : c + size], block[c : c + size] - left, item[c : c + size]
                far, low, high = fit(symbols[i], words(own, b, width))
                length = stops[own] - begins[own]
                low, high = np.clip(b + low, 0, length), np.clip(b + high, 0, length)
                good = far <= edits
                yield rows[own[good]], ids[i[good]], far[good], low[good], (high - low)[good]


def load_items(benchmark: DataFrame, item_col: str, text_col: str, similarity: float, recall: float) -> Items:
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.lower(F.col(text_col).cast("string")).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; split it into parts below {MAX_ITEM_BYTES}")
    found = rows.distinct().collect()
    return Items([r.i for r in found], [r.t for r in found], similarity, recall)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = 0.8, recall: float = RECALL, keep_columns: bool = False,
) -> DataFrame:
    """Per row: id, n_items, leaks: array of (item_id, edits, start word, n_words), the closest words to each leaked item.

    With ``keep_columns`` the row's own columns come first, and those two replace columns of the same names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_items(benchmark, item_col, item_text_col, similarity, recall))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64())]))

    def leaks(part: pa.RecordBatch) -> list[dict[int, tuple]]:
        items = shared.value
        held: dict[int, list[tuple]] = {}
        best: list[dict[int, tuple]] = [{} for _ in range(len(part))]

        def settle() -> None:
            for m, parts in held.items():
                for found in items.confirm(m, parts):
                    for row, i, e, s, n in zip(*(x.tolist() for x in found)):
                        new = (e, s, n)
                        if i not in best[row] or new < best[row][i]:
                            best[row][i] = new
            held.clear()

        before = size = 0
        for piece in chunks(part, "text"):
            hashes, first = word_hashes(piece.column("text"))
            for m, (texts, starts) in items.windows(hashes, first).items():
                for s in range(0, len(starts), _HELD):
                    at, own = starts[s : s + _HELD], texts[s : s + _HELD]
                    used = np.unique(own)  # only texts with windows wait
                    lengths = np.diff(first)[used]
                    words = hashes[run_indices(first[used], lengths)]
                    held.setdefault(m, []).append((words, np.concatenate([[0], np.cumsum(lengths)]), own + before, np.searchsorted(used, own), at))
                    size += len(at) + len(words) // 8
                    if size >= _HELD:
                        settle()
                        size = 0
            before += len(piece)
        settle()
        return best

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            best = leaks(part)
            lists = [[{"item_id": i, "edits": e, "start": s, "n_words": m} for i, (e, s, m) in sorted(b.items())] for b in best]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([len(b) for b in best], pa.int64()), pa.array(lists, kind)], names=["row", "n_items", "leaks"])

    own = [c for c in docs.columns if c not in ("n_items", "leaks")] if keep_columns else [id_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.lower(F.col(text_col).cast("string")).alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType)]).add("n_items", "long")
    schema = schema.add("leaks", T.DataType.fromDDL("array<struct<item_id:long,edits:long,start:long,n_words:long>>"))
    return rows.mapInArrow(work, schema).select("row.*", "n_items", "leaks")
