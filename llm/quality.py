"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters (and of other bytes above 127) or runs of other visible characters, A-Z lower-cased. Features
are hashed single words, word pairs, a mark for every word that repeats the one before it, and the text's length in
powers of two; a feature's value is the square root of its count, and the vector has length one. Texts only, nothing else.

Training takes at most ``sample`` labelled rows (16,384; those with the smallest hash of their id, over all labels), whose
features go to one task; it passes over them in small batches with per-coordinate FTRL-proximal steps. The model is
2**18 weights, so its size is fixed. Scores are sparse dot products through the logistic function.

Nulls: a null text is an empty one and is scored by its length mark alone; labels without id or value are left out. Rows
without id are scored. A label id that repeats trains with each of its rows. With one class or none, every score is the
share of that class (one half without labels). An empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import map_arrow, spare_name
from llm.kernel import IS_SPACE, U, Words, buffers, chunks, mix

BITS = 18
SAMPLE = 16_384
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
EPOCHS, BATCH = 6, 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values, and bounds of each text."""
    raw, at = buffers(texts)
    kind = np.where(IS_SPACE[raw], 0, np.where(_LETTER[raw], 1, 2))
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(raw))
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    words = Words(raw, starts, ends, np.searchsorted(starts, at))
    hashes, counts = words.hashes(True), np.diff(words.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    pair = mix(hashes[inner] * U(0xD6E8FEB86659FD93) + hashes[inner + 1], 31)
    again = inner[hashes[inner] == hashes[inner + 1]]
    length = np.floor(np.log2(counts + 1)).astype(U)
    number = np.concatenate([mix(hashes, 30), pair, mix(np.zeros(len(again), U), 32), mix(length, 33)]) >> U(64 - BITS)
    owners = np.concatenate([owner, owner[inner], owner[again], np.arange(len(counts))])
    key, times = np.unique((owners.astype(U) << U(BITS)) | number, return_counts=True)
    values, rows = np.sqrt(times), (key >> U(BITS)).astype(np.int64)
    norm = np.sqrt(np.bincount(rows, values**2, minlength=len(counts)))
    return (key & U((1 << BITS) - 1)).astype(np.int32), (values / norm[rows]).astype(np.float32), np.searchsorted(rows, np.arange(len(counts) + 1))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            number, value, at = features(part.column("text"))
            pack = lambda a: pa.array([a[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), part.column("order"), part.column("label"), pack(number), pack(value)], names=["one", "order", "label", "number", "value"])


def ftrl(number: list[np.ndarray], value: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. The bias starts at the log odds of the labels."""
    share = float(label.mean()) if len(label) else 0.5
    weights = np.zeros(1 << BITS, np.float64)
    if share in (0.0, 1.0) or not len(label):
        odds = {0.0: -20.0, 1.0: 20.0}.get(share, 0.0)
        return weights.astype(np.float32), odds
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        rows = order.permutation(len(label))
        for s in range(0, len(rows), BATCH):
            pick = rows[s : s + BATCH]
            index = np.concatenate([number[i] for i in pick])
            x = np.concatenate([value[i] for i in pick]).astype(np.float64)
            owner = np.repeat(np.arange(len(pick)), [len(number[i]) for i in pick])
            dot = np.bincount(owner, x * weights[index], minlength=len(pick)) + bias
            error = 1 / (1 + np.exp(-np.clip(dot, -30, 30))) - label[pick]
            touched, back = np.unique(index, return_inverse=True)
            g = np.bincount(back, error[owner] * x)
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / ALPHA
            z[touched] += g - sigma * weights[touched]
            n[touched] += g * g
            zt = z[touched]
            weights[touched] = np.where(np.abs(zt) <= L1, 0, -(zt - np.sign(zt) * L1) / ((BETA + np.sqrt(n[touched])) / ALPHA + L2))
            step = float(error.sum())
            bias_n += step * step
            bias -= 0.1 * step / (1 + np.sqrt(bias_n))
    return weights.astype(np.float32), bias


def _train(table: pa.Table) -> pa.Table:
    table = table.sort_by("order")
    number = [np.frombuffer(b, np.int32) for b in table.column("number").to_pylist()]
    value = [np.frombuffer(b, np.float32) for b in table.column("value").to_pylist()]
    weights, bias = ftrl(number, value, np.asarray(table.column("label")).astype(np.float64))
    return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": pa.array([bias])})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows; ``labels`` has ``id_col`` and ``label_col`` (0 or 1)."""
    marked = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("double").alias("label")).filter("label IN (0, 1) AND label_id IS NOT NULL")
    chosen = marked.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample)  # at most `sample` short rows, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("id", "label", F.xxhash64("id", "text", "label").alias("order"), "text")
    # a labelled id that repeats counts once, whatever share of the rows has it: one row per task is shuffled
    rows = rows.groupBy("id", "label").agg(F.min(F.struct("order", "text")).alias("row")).select("row.order", "label", "row.text")
    packed = map_arrow(rows, _featurise, "one int, order long, label double, number binary, value binary")
    model = packed.groupBy("one").applyInArrow(_train, "weights binary, bias double").first()
    if model is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model.weights, np.float32), model.bias


def score(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with ``score_col``: the probability of label 1."""
    kept = [c for c in df.columns if c.lower() != score_col.lower()]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(score_col, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)
    held = spare_name(df)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part in chunks(batch, held):
                number, value, at = features(part.column(held))
                owner = np.repeat(np.arange(len(part)), np.diff(at))
                dot = np.bincount(owner, value * weights[number], minlength=len(part)) + bias
                out = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out)], names=[*kept, score_col])

    texts = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(held))
    return map_arrow(texts, work, schema)
