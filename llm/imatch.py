"""Document fingerprints by I-Match over several randomised lexicon subsets.

Terms are the distinct words (A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``) of a text. The lexicon holds the terms whose share of
documents lies in a band: ``LEAST`` to ``MOST``, that is an inverse document frequency between two bounds. It is
counted over all documents. At most ``terms per document / LEAST`` terms can reach the lower bound, however large the
corpus: that bounds what is broadcast. The lexicon stands for a text if it holds at least ``CARRIED`` of the text's terms.
Otherwise all terms do: copies that make up a large share of the rows have most of their terms above the band. A text
without terms is hashed as it stands.

The fingerprint is 16 hex digits of the sorted terms that stand for the text, two digits that say which (``01``: the lexicon's,
``00``: all), then two digits for each of ``SEEDS`` random subsets of the lexicon at each of ``LEVELS`` rates (1/4, 1/16, ...): the
hash of the terms in that subset, ``00`` if there are none; then the same for subsets of all terms. Two texts are compared by the
lexicon if it stands for both, else both by all their terms. They agree in a subset that none of their differing terms
falls into, so the shares of agreeing and of empty subsets at a rate estimate the sizes of difference and union. The rates'
estimates of the Jaccard value count by the inverse of their variance; the likeness is 2 J / (1 + J).

Nulls: a null text is an empty one. Rows without id come first, equal ids in text order. Repeated rows all come out.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import buckets, column_bytes, map_arrow, partitions
from llm.kernel import U, chunks, mix, split_words

LEAST, MOST = 0.001, 0.25
CARRIED = 0.25
SEEDS, LEVELS = 40, 6
_FLUSH = 1 << 20


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of each text, and bounds."""
    words = split_words(texts)
    hashes, parts, sizes = words.hashes(True), [], np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(words.first.tolist(), words.first[1:].tolist())):
        if b > a:
            own = np.sort(hashes[a:b])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            parts.append(own)
            sizes[i] = len(own)
    return np.concatenate([np.zeros(0, U), *parts]), np.concatenate([[0], np.cumsum(sizes)])


def _count(n: int):
    """Per task: each term once with its number of documents."""

    def emit(parts: list[np.ndarray], counts: list[np.ndarray]):
        terms, back = np.unique(np.concatenate(parts), return_inverse=True)
        return terms, np.bincount(back, np.concatenate(counts)).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts, held = [], [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                terms, _ = distinct_terms(part.column("text"))
                parts.append(terms)
                counts.append(np.ones(len(terms), np.int64))
                held += len(terms)
                if held >= _FLUSH:
                    terms, df = emit(parts, counts)
                    parts, counts, held = [terms], [df], len(terms)
                    if held >= _FLUSH // 2:
                        yield from buckets(["terms", "df"], (terms % U(n)).astype(np.int32), [terms, df.astype(np.uint32)])
                        parts, counts, held = [], [], 0
        if held:
            terms, df = emit(parts, counts)
            yield from buckets(["terms", "df"], (terms % U(n)).astype(np.int32), [terms, df.astype(np.uint32)])

    return work


def _band(least: float, most: float):
    def work(table: pa.Table) -> pa.Table:
        terms, df = column_bytes(table.column("terms"), U), column_bytes(table.column("df"), np.uint32)
        terms, back = np.unique(terms, return_inverse=True)
        df = np.bincount(back, df, len(terms))
        kept = terms[(df >= least) & (df <= most)]
        return pa.table({"terms": pa.array([kept.tobytes()], pa.binary())})

    return work


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all rows."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = docs.count()
    counted = map_arrow(texts, _count(partitions(docs.sparkSession)), "bucket int, terms binary, df binary")
    kept = counted.groupBy("bucket").applyInArrow(_band(least * total, most * total), "terms binary")
    return np.sort(np.concatenate([np.zeros(0, U), *(np.frombuffer(r.terms, U) for r in kept.toLocalIterator())]))


def _subsets(terms: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One byte per text, rate and random subset: the hash of the text's terms in it, 0 if there are none."""
    subsets = np.zeros((n, SEEDS, LEVELS), U)
    value = mix(terms, 50)
    for group in range(-(-SEEDS // 4)):  # 16 bits of a hash for each of four subsets
        bits = mix(terms, 60 + group)
        for k in range(min(4, SEEDS - 4 * group)):
            seed = 4 * group + k
            u = ((bits >> U(16 * k)) & U(0xFFFF)).astype(np.int64)
            rows = np.flatnonzero(u < 1 << 14)
            level = np.minimum((15 - np.floor(np.log2(np.maximum(u[rows], 1))).astype(np.int64)) // 2, LEVELS) - 1
            np.add.at(subsets, (owner[rows], seed, level), value[rows])
    subsets = np.cumsum(subsets[:, :, ::-1], axis=2, dtype=U)[:, :, ::-1]  # a rare level's terms are in every wider one
    return np.where(subsets == 0, 0, mix(subsets, 70) % U(255) + U(1)).astype(np.uint8).transpose(0, 2, 1).reshape(n, -1)


def fingerprints(texts: pa.Array, known: np.ndarray) -> list[bytes]:
    """For each text 8 bytes of its whole term list, one that says which terms, SEEDS * LEVELS of the lexicon's subsets and as many of all terms'."""
    terms, at = distinct_terms(texts)
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    inside = known[np.minimum(np.searchsorted(known, terms), len(known) - 1)] == terms if len(known) else np.zeros(len(terms), bool)
    held = np.bincount(owner[inside], minlength=n)
    carried = (held > 0) & (held >= CARRIED * np.diff(at))
    banded, every = _subsets(terms[inside], owner[inside], n), _subsets(terms, owner, n)
    stands = inside | ~carried[owner]
    terms, owner = terms[stands], owner[stands]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    raw = texts.fill_null("").to_pylist() if (np.diff(bounds) == 0).any() else None
    out = []
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        whole = terms[a:b].tobytes() if b > a else b"text" + raw[i].encode("utf-8", "surrogatepass")
        out.append(hashlib.blake2b(whole, digest_size=8).digest() + bytes([int(carried[i])]) + banded[i].tobytes() + every[i].tobytes())
    return out


def likeness(one: bytes, two: bytes) -> float:
    """0 to 1 from two fingerprints: 1 if the whole term lists agree."""
    if one[:8] == two[:8]:
        return 1.0
    size = SEEDS * LEVELS
    at = 9 if one[8] and two[8] else 9 + size  # the lexicon speaks for both texts, or all terms do for both
    a = np.frombuffer(one, np.uint8, size, at).reshape(LEVELS, SEEDS)
    b = np.frombuffer(two, np.uint8, size, at).reshape(LEVELS, SEEDS)
    same, empty = (a == b).mean(1), ((a == 0) & (b == 0)).mean(1)
    told = (empty < 1) & (empty >= 3 / SEEDS)
    if not told.any():
        told = np.arange(LEVELS) == np.argmin(np.abs(empty - 0.4))
    same, empty = same[told], np.clip(empty[told], 0.5 / SEEDS, 1 - 0.5 / SEEDS)
    same = np.maximum(same, empty)  # below chance is no likeness
    union, alike = np.log(empty), np.log(same)
    # each rate's estimate counts by its spread: of both shares, smoothed
    smooth_same, smooth_empty = (same * SEEDS + 0.5) / (SEEDS + 1), (empty * SEEDS + 0.5) / (SEEDS + 1)
    spread = (1 - smooth_same) / smooth_same / union**2 + (alike / union**2) ** 2 * (1 - smooth_empty) / smooth_empty
    jaccard = np.sum((1 - alike / union) / spread) / np.sum(1 / spread)
    return float(min(1.0, max(0.0, 2 * jaccard / (1 + jaccard))))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt to ranges of ids, each range with the row that follows it: (bucket, carry, id, text), in order."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    count = partitions(docs.sparkSession)
    cuts = rows.select(F.percentile_approx("id", [i / count for i in range(1, count)] or [0.5], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    if cuts:
        bucket = F.aggregate(F.array(*[F.lit(int(c)) for c in cuts]), F.lit(0), lambda n, c: n + (F.col("id") >= c).cast("int"))
    dealt = rows.withColumn("bucket", F.coalesce(bucket, F.lit(0)))
    firsts = {r.bucket: r.low for r in dealt.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("low")).collect()}
    order = sorted(firsts)  # at most one row per partition
    carried = [(order[i - 1], firsts[b].id) for i, b in enumerate(order)]
    spark = docs.sparkSession
    extra = spark.createDataFrame(carried, "target int, first long")
    again = rows.join(F.broadcast(extra), F.col("id").eqNullSafe(F.col("first"))).select(F.col("target").alias("bucket"), F.lit(1).alias("carry"), "id", "text")
    all_rows = dealt.select("bucket", F.lit(0).alias("carry"), "id", "text").union(again)
    return all_rows.repartition(count, "bucket").sortWithinPartitions("bucket", "carry", "id", "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(lexicon(docs, text_col))
    rows = with_next(docs, id_col, text_col)

    def judged(group: list[tuple]) -> pa.RecordBatch:
        ids, texts, following = zip(*group)
        edited = []
        for text, after in zip(texts, following):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + after[:cut])
        own = fingerprints(pa.array(texts, pa.large_string()), known.value)
        new = fingerprints(pa.array(edited, pa.large_string()), known.value)
        last = own[-1] if following[-1] is texts[-1] else fingerprints(pa.array([following[-1]], pa.large_string()), known.value)[0]
        nexts = [*own[1:], last]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(edited, pa.string()),
                pa.array([f.hex() for f in own]), pa.array([f.hex() for f in new]),
                pa.array([likeness(a, b) for a, b in zip(own, new)]), pa.array([likeness(a, b) for a, b in zip(own, nexts)]),
            ],
            names=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size = None, [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                columns = [part.column(c).to_pylist() for c in ("bucket", "carry", "id", "text")]
                for bucket, carry, i, text in zip(*columns):
                    if held is not None and held[0] == bucket:
                        group.append((held[1], held[2], text))
                        size += len(text)
                    if group and (carry or size >= 1 << 20):  # a range ends with the row that follows it
                        yield judged(group)
                        group, size = [], 0
                    held = None if carry else (bucket, i, text)
        if group:
            yield judged(group)

    out = rows.mapInArrow(work, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
