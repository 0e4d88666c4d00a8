"""Token ids in compressed files: Re-Pair grammars per block of documents, with random access.

Documents are encoded, sorted by id and cut into blocks of about ``BLOCK`` ids. In each block frequent pairs of
neighbouring symbols (never across documents) are replaced by nonterminals, round by round until none pays: pair counts come from a
hashed histogram that is exact for the pairs it lets through, each round replaces every pair that still saves space,
and where two pairs overlap the more frequent one wins. A block stores its rules, the expansion length of each rule, the symbols and each document's
first symbol and number of ids. One document is read by its own symbols and the rules alone.

A file set is a table of blocks written by Spark: ``shard``, ``block``, ``doc_ids``, ``id_valid``, ``n_tokens``, ``symbol_at``, ``rules``,
``rule_lengths``, ``symbols`` and ``n_ids``, the lists packed little-endian. Shards and blocks follow the documents' ids.

Nulls: a null text is an empty document, so it holds the end id alone. Rows without id come first. Rows that repeat
an id all stay, in an order of their own among themselves. An empty table gives an empty file set. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.bpe import id_lists, vocabulary
from llm.common import partitions
from llm.kernel import U, chunks, run_indices

BLOCK = 1 << 20
LEAST = 24  # occurrences from which a pair is worth a rule
_BITS = 20
FORMAT = (
    "shard int, block int, doc_ids binary, id_valid binary, n_tokens binary, symbol_at binary, "
    "rules binary, rule_lengths binary, symbols binary, n_ids long"
)
_NAMES = [f.split()[0] for f in FORMAT.split(", ")]


def _bins(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key * U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int32)


def _chosen(key: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs worth a rule, and the places to replace: which of these pairs, and where. ``key`` has the pair at each of ``rows``.

    A hashed histogram, about as long as ``key``, leaves few other pairs to sort; its bins then find each place's pair, and only bins of several
    frequent pairs need a search. Where pairs overlap, the more frequent wins; equal ones from the left.
    """
    none = np.zeros(0, np.int64)
    bits = min(_BITS, max(8, len(key).bit_length()))
    bins = _bins(key, bits)
    often = np.flatnonzero((np.bincount(bins, minlength=1 << bits) >= least)[bins])
    key, rows, bins = key[often], rows[often], bins[often]
    pairs, counts = np.unique(key, return_counts=True)
    good = counts >= least
    pairs, counts = pairs[good], counts[good].astype(np.int32)
    if not len(pairs):
        return pairs, none, none
    own = _bins(pairs, bits)
    of_bin = np.full(1 << bits, -1, np.int32)
    of_bin[own] = np.arange(len(pairs), dtype=np.int32)
    found = of_bin[bins]
    some = pairs[found] == key
    several = np.flatnonzero((np.bincount(own, minlength=1 << bits) > 1)[bins] & ~some)
    if len(several):
        place = np.minimum(np.searchsorted(pairs, key[several]), len(pairs) - 1)
        found[several], some[several] = place, pairs[place] == key[several]
    some = np.flatnonzero(some)
    rows, found = rows[some], found[some]
    weight = counts[found]
    near = np.diff(rows) == 1
    hit = np.ones(len(rows), bool)
    hit[:-1] &= ~near | (weight[:-1] >= weight[1:])
    hit[1:] &= ~near | (weight[1:] >= weight[:-1])
    index = np.arange(len(hit), dtype=np.int32)
    begins = hit & ~np.append(False, hit[:-1] & near)
    hit &= (index - np.maximum.accumulate(np.where(begins, index, np.int32(-1)))) % 2 == 0
    used = np.bincount(found[hit], minlength=len(pairs))
    keep = used >= max(least // 2, 1)
    hit &= keep[found]
    return pairs[keep], (np.cumsum(keep) - 1)[found[hit]], rows[hit]


def compress(ids: np.ndarray, first: np.ndarray, size: int, least: int = LEAST):
    """Rules (pairs of symbols from ``size`` up), symbols, and where each document's symbols begin.

    Rounds go on until no pair pays. A round after the first looks at pairs with a symbol of the round before, since other
    counts only fall; when these give nothing, a last look at all pairs ends the loop or goes on.
    """
    symbols = ids.astype(np.uint32)
    fresh = np.zeros(len(symbols), bool)  # a document begins here
    fresh[first[:-1][first[:-1] < len(symbols)]] = True
    rules: list[np.ndarray] = []
    top, since = size, 0
    while len(symbols) >= 2:
        inside = ~fresh[1:]
        if since:
            late = symbols >= since
            inside &= late[:-1] | late[1:]
        rows = np.flatnonzero(inside)
        new, found, at = _chosen((symbols[rows].astype(U) << U(32)) | symbols[rows + 1], rows, least)
        if not len(new):
            if not since:
                break
            since = 0
            continue
        rules.append(np.stack([new >> U(32), new & U(0xFFFFFFFF)], 1).astype(np.uint32))
        symbols[at] = top + found
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, fresh = symbols[keep], fresh[keep]
        top, since = top + len(new), top
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    empty = np.diff(first) == 0
    begins = np.zeros(len(first), np.int64)
    begins[-1] = len(symbols)
    begins[:-1][~empty] = np.flatnonzero(fresh)
    for i in np.flatnonzero(empty)[::-1]:
        begins[i] = begins[i + 1]
    return table, symbols, begins


def expansions(rules: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every rule, one after another, and bounds. A rule only uses symbols made before it."""
    at = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    out = np.zeros(at[-1], np.uint32)
    pairs = rules.astype(np.int64) - size
    open_ = np.arange(len(rules))
    ready = np.zeros(len(rules), bool)
    while len(open_):
        p = pairs[open_]
        done = ((p[:, 0] < 0) | ready[np.maximum(p[:, 0], 0)]) & ((p[:, 1] < 0) | ready[np.maximum(p[:, 1], 0)])
        now = open_[done]
        offset = at[now].copy()
        for side in (0, 1):
            p = pairs[now, side]
            leaf = p < 0
            out[offset[leaf]] = rules[now[leaf], side]
            n = np.where(leaf, 1, lengths[np.maximum(p, 0)]).astype(np.int64)
            deep = ~leaf
            out[run_indices(offset[deep], n[deep])] = out[run_indices(at[p[deep]], n[deep])]
            offset += n
        ready[now] = True
        open_ = open_[~done]
    return out, at


def rule_lengths(rules: np.ndarray, size: int) -> np.ndarray:
    lengths = np.zeros(len(rules), np.int64)
    pairs = rules.astype(np.int64) - size
    todo = np.arange(len(rules))
    while len(todo):
        p = pairs[todo]
        n = np.where(p < 0, 1, lengths[np.maximum(p, 0)])
        good = (n > 0).all(1)
        lengths[todo[good]] = n[good].sum(1)
        todo = todo[~good]
    return lengths.astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """The ids of a run of symbols."""
    flat, at = expansions(rules, lengths, size)
    nonterminal = symbols >= size
    index = np.where(nonterminal, symbols.astype(np.int64) - size, 0)
    n = np.where(nonterminal, lengths[index] if len(lengths) else 1, 1).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(total[-1], np.uint32)
    out[total[:-1][~nonterminal]] = symbols[~nonterminal]
    out[run_indices(total[:-1][nonterminal], n[nonterminal])] = flat[run_indices(at[index[nonterminal]], n[nonterminal])]
    return out


def _blocks(path: str, end_id: int, block_ids: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, shard, block = vocabulary(path), TaskContext.get().partitionId(), 0
        parts, docs, valid, counts, held = [], [], [], [], 0

        def pack() -> pa.RecordBatch:
            ids, n = np.concatenate(parts), np.concatenate(counts)
            first = np.concatenate([[0], np.cumsum(n)])
            rules, symbols, at = compress(ids, first, known.size)
            columns = [
                np.concatenate(docs).astype("<i8"), np.concatenate(valid).astype(np.uint8), n.astype("<u4"), at[:-1].astype("<u4"),
                rules.astype("<u4"), rule_lengths(rules, known.size).astype("<u4"), symbols.astype("<u4"),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([len(ids)])],
                names=_NAMES,
            )

        for batch in batches:
            for part in chunks(batch, "text"):
                ids, at = known.encode(part.column("text"))
                n = np.diff(at) + 1
                out = np.full(n.sum(), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(n) - 1] = False
                out[keep] = ids
                column = part.column("id")
                parts.append(out)
                counts.append(n)
                docs.append(np.asarray(column.fill_null(0)))
                valid.append(np.asarray(column.is_valid()))
                held += len(out)
                if held >= block_ids:
                    yield pack()
                    parts, docs, valid, counts, held, block = [], [], [], [], 0, block + 1
        if counts:
            yield pack()

    return work


def write_tokens(docs: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None) -> None:
    """Writes the file set ``out`` (a folder of any file system Spark writes to)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    count = shards or partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(count, "id").sortWithinPartitions("id")
    ordered.mapInArrow(_blocks(tokenizer, end_id, BLOCK), FORMAT).write.option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, path: str, size: int, ids: list[int] | None = None) -> DataFrame:
    """Per document of the file set, or of the given ids: id, start, n_tokens, ids. Only the wanted documents' symbols are expanded."""
    blocks = spark.read.schema(FORMAT).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one number per block, then one per shard
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shard_at"))
    starts = (
        sizes.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_block_at"))
        .join(shards, "shard")
        .select("shard", "block", (F.col("_shard_at") + F.col("_block_at")).alias("start"))
    )
    wanted = None if ids is None else np.array(sorted(set(ids)), np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, valid = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["id_valid"], np.uint8).astype(bool)
                n = np.frombuffer(row["n_tokens"], "<u4").astype(np.int64)
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                lengths, symbols = np.frombuffer(row["rule_lengths"], "<u4"), np.frombuffer(row["symbols"], "<u4")
                at = np.append(np.frombuffer(row["symbol_at"], "<u4").astype(np.int64), len(symbols))
                start = row["start"] + np.cumsum(n) - n
                pick = np.arange(len(doc)) if wanted is None else np.flatnonzero(np.isin(doc, wanted) & valid)
                if not len(pick):
                    continue
                own = symbols[run_indices(at[pick], at[pick + 1] - at[pick])]
                flat = expand(own, rules, lengths, size)
                bounds = np.concatenate([[0], np.cumsum(n[pick])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[pick], mask=~valid[pick]), pa.array(start[pick]), pa.array(n[pick]), id_lists(flat, bounds)],
                    names=["id", "start", "n_tokens", "ids"],
                )

    return blocks.drop("n_ids").join(starts, ["shard", "block"]).mapInArrow(work, "id long, start long, n_tokens long, ids array<int>")


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, ids_crc32) of rows as ``read_tokens`` gives them; ids as little-endian 32-bit integers."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(np.asarray(batch.column("n_tokens")))])
        raw = memoryview(np.asarray(batch.column("ids").flatten()).astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
