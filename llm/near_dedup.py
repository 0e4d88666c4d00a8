"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct ``width``-word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``), the whole
sequence as one shingle if it has fewer words, and empty without words.

1. Every text gives its set's size, a 128-bit set digest and HyperMinHash registers: per bucket the minimum hash
   as leading-zero count and ten mantissa bits. Empty buckets borrow the register of a filled one. Registers are
   banded; the number of rows in a band follows from the threshold and the wanted recall.
2. Equal sets collapse to one. Equal bands are joined by star edges, whose components are rough clusters.
3. Inside a rough cluster the collision-corrected Jaccard estimate discards what lies five standard deviations
   below the threshold; the rest is confirmed on full sets. A pair already connected needs no check, so only a
   spanning forest leaves a task. A cluster beyond a block's size is cut into blocks, each pair of blocks a task.
4. Components of the confirmed links give the result.

Nulls: a null or wordless text has an empty set and is linked with nothing. A row without id takes part, never
counts as the smallest, and has a null ``component_id`` only if its whole component has no id. Repeated rows are
copies and each comes out. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import binary, buckets, column_bytes, components, folders, forget, group_arrow, map_arrow, partitions, saved, sliced
from llm.kernel import U, chunks, grams, mix, split_words

REGISTERS = 252
MANTISSA = 10
COLLISION = 0.17 / (1 << MANTISSA)  # two independent minima share a register this often
_FLUSH = 1 << 18
_PROBES = 64
_BLOCK_SHINGLES, _BLOCK_SETS = 1 << 20, 512


def band_rows(threshold: float, miss: float = 1e-5) -> int:
    """The most rows per band that still lose at most ``miss`` of the pairs exactly at the threshold."""
    good = [r for r in range(1, 17) if (1 - threshold**r) ** (REGISTERS // r) <= miss]
    return max(good, default=1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their bounds."""
    words = split_words(texts)
    hashes, counts = words.hashes(True), np.diff(words.first)
    values, _, at = grams(hashes, words.first, width)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts.tolist()):
        if not n:
            continue
        if n < width:
            own, _, _ = grams(hashes[words.first[i] : words.first[i + 1]], np.array([0, n]), n)
            own = mix(own, n)
        else:
            own = np.sort(values[at[i] : at[i + 1]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate([np.zeros(0, U), *parts]), np.concatenate([[0], np.cumsum(sizes)])


def digests(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two sums of remixed members: equal sets, and only they, agree in 128 bits."""
    out = np.zeros((len(at) - 1, 2), U)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k in (0, 1):
            out[full, k] = np.add.reduceat(mix(sets, 7 + k), at[:-1][full])
    return out


def registers(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each set (one row each); zero rows for empty sets."""
    n = len(at) - 1
    low = np.full(n * REGISTERS, np.iinfo(U).max, U)
    place = (((sets >> U(32)) * U(REGISTERS)) >> U(32)).astype(np.int64) + np.repeat(np.arange(n), np.diff(at)) * REGISTERS
    np.minimum.at(low, place, mix(sets, 3) >> U(1))
    filled = low != np.iinfo(U).max
    _, exponent = np.frexp(np.where(filled, low, 1).astype(np.float64))
    zeros = (64 - exponent).astype(U)
    mantissa = (low << np.minimum(zeros + U(1), U(63))) >> U(64 - MANTISSA)
    out = ((zeros << U(MANTISSA)) | mantissa).astype(np.uint16).reshape(n, REGISTERS)
    filled = filled.reshape(n, REGISTERS)
    todo = np.flatnonzero(filled.any(1) & ~filled.all(1))
    source, known = out.copy(), filled.copy()
    index = np.arange(REGISTERS)
    for probe in range(_PROBES):
        if not len(todo):
            break
        pick = (mix(index.astype(U), 100 + probe) % U(REGISTERS)).astype(np.int64)
        take = ~known[todo] & filled[todo][:, pick]
        out[todo] = np.where(take, source[todo][:, pick], out[todo])
        known[todo] |= take
        todo = todo[~known[todo].all(1)]
    for row in todo:  # few filled buckets: the next filled one to the right
        have = np.flatnonzero(filled[row])
        gaps = np.flatnonzero(~known[row])
        out[row, gaps] = source[row, have[np.searchsorted(have, gaps) % len(have)]]
    out[~filled.any(1)] = 0
    return out


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band and set."""
    bands = regs.shape[1] // rows
    cut = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(U)
    key = np.zeros((len(regs), bands), U) + np.arange(bands, dtype=U)
    for k in range(rows):
        key = mix(key ^ (cut[:, :, k] + U(0x9E3779B97F4A7C15)), k)
    return key


def estimate(regs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Jaccard estimates of every row of registers against ``one``, corrected for chance collisions."""
    return ((regs == one).mean(1) - COLLISION) / (1 - COLLISION)


def _profile(id_col: str, text_col: str, width: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                sets, at = shingle_sets(part.column(text_col), width)
                sizes = np.diff(at)
                digest, keys = digests(sets, at), band_keys(registers(sets, at), rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col).cast(pa.int64()),
                        pa.array(sizes, pa.int64()),
                        binary([d.tobytes() if n else None for d, n in zip(digest, sizes.tolist())]),
                        binary([k.tobytes() if n else None for k, n in zip(keys, sizes.tolist())]),
                        part.column("hash"),
                    ],
                    names=["id", "n_shingles", "digest", "bands", "hash"],
                )

    return work


def _star(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest node per key, and an edge to it from each other node of the key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    owners, at = sliced(keys, keys)
    least = nodes[at[:-1]] if len(owners) else nodes
    roots = np.repeat(least, np.diff(at)) if len(owners) else least
    other = nodes != roots
    edges = np.unique(np.stack([nodes[other], roots[other]], 1), axis=0)
    return owners, least, edges[:, 0], edges[:, 1]


def _collide(count: int):
    """Per task: local stars leave as edges; one (key, smallest node) goes on to the key's bucket."""

    def emit(keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        owners, least, u, v = _star(np.concatenate(keys), np.concatenate(nodes))
        yield from buckets(["keys", "nodes"], (owners % U(count)).astype(np.int32), [owners, least])
        yield from buckets(["keys", "nodes"], -1 - (u % U(count)).astype(np.int32), [u, v])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for batch in batches:
            for digest, bands in zip(batch.column("digest").to_pylist(), batch.column("bands").to_pylist()):
                own = np.frombuffer(bands, U)
                keys.append(own)
                nodes.append(np.full(len(own), np.frombuffer(digest, U)[0]))
                held += len(own)
                if held >= _FLUSH:
                    yield from emit(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield from emit(keys, nodes)

    return work


def _edges(key: tuple, table: pa.Table) -> pa.Table:
    keys, nodes = column_bytes(table.column("keys"), U), column_bytes(table.column("nodes"), U)
    if key[0].as_py() >= 0:
        _, _, u, v = _star(keys, nodes)
    else:
        u, v = keys, nodes
    return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})


def _members(id_col: str, text_col: str, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                sets, at = shingle_sets(part.column(text_col), width)
                own = digests(sets, at)
                wanted = part.column("digest").to_pylist()
                same = [i for i, d in enumerate(wanted) if own[i].tobytes() == d]
                kept = part.take(pa.array(same, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("label"), kept.column("blocks"), kept.column("digest"), binary([sets[at[i] : at[i + 1]].tobytes() for i in same])],
                    names=["label", "blocks", "digest", "shingles"],
                )

    return work


def links(sets: list[np.ndarray], side: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of all pairs with 100 * intersection >= 100 * threshold * union; only across sides if given."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets) if n else np.zeros(0, U)
    regs = registers(flat, at)
    percent = round(threshold * 100)
    comp = np.arange(n)
    out = []
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        fits = (comp[rest] != comp[i]) & (100 * small >= percent * large)
        if side is not None:
            fits &= side[rest] != side[i]
        rest, small = rest[fits], small[fits]
        if not len(rest):
            continue
        slack = 5 * np.sqrt(threshold * (1 - threshold) / np.minimum(small, REGISTERS))
        rest = rest[estimate(regs[rest], regs[i]) >= threshold - slack]
        if not len(rest):
            continue
        lengths = sizes[rest]
        values = np.concatenate([sets[j] for j in rest])
        found = np.searchsorted(sets[i], values)
        hit = sets[i][np.minimum(found, sizes[i] - 1)] == values
        both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        for j in rest[100 * both >= percent * (sizes[i] + lengths - both)]:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                out.append((i, int(j)))
    return out


def _confirm(threshold: float):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        table = table.sort_by([("label", "ascending"), ("digest", "ascending")])
        labels = np.asarray(table.column("label"))
        digest, blobs, block = table.column("digest").to_pylist(), table.column("shingles").to_pylist(), np.asarray(table.column("block"))
        _, at = sliced(labels, labels)
        u, v = [], []
        for s, e in zip(at, at[1:]):
            rows = [r for r in range(s, e) if r == s or digest[r] != digest[r - 1]]
            for i, j in links([np.frombuffer(blobs[r], U) for r in rows], block[rows] if one != two else None, threshold):
                u.append(digest[rows[i]])
                v.append(digest[rows[j]])
        return pa.table({"u": binary(u), "v": binary(v)})

    return work


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept (its id is the component's)."""
    spark = docs.sparkSession
    rows, count = band_rows(threshold), partitions(spark)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    sets = saved(map_arrow(texts, _profile("id", "text", width, rows), "id long, n_shingles long, digest binary, bands binary, hash long"), "sets")

    unique = saved(
        sets.filter("digest IS NOT NULL").groupBy("digest").agg(
            F.min("id").alias("rep"), F.coalesce(F.min_by("hash", "id"), F.min("hash")).alias("hash"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        ),
        "unique",
    )
    lasting = folders()
    packed = map_arrow(unique.select("digest", "bands"), _collide(count), "bucket int, keys binary, nodes binary")
    rough = components(group_arrow(packed, ["bucket"], _edges, "u long, v long"))

    nodes = map_arrow(unique.select("digest", "rep", "hash", "n"), _nodes, "digest binary, rep long, hash long, n long, node long")
    members = nodes.join(rough, "node").select("label", "digest", "rep", "hash", "n")
    size = members.groupBy("label").agg(
        F.ceil(F.greatest(F.sum("n") / _BLOCK_SHINGLES, F.count("*") / _BLOCK_SETS)).cast("int").alias("blocks")
    )
    members = saved(members.join(size, "label"), "members")
    wanted = members.select("label", "blocks", "digest", "rep", F.col("hash").alias("of"))
    found = texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("of")))
    # rows that repeat an id with its text are one set: each task sends one of them
    found = found.groupBy("digest").agg(F.first("text").alias("text"), F.first("label").alias("label"), F.first("blocks").alias("blocks")).select("text", "label", "blocks", "digest")
    blocks = map_arrow(found, _members("id", "text", width), "label long, blocks int, digest binary, shingles binary")
    block = F.pmod(F.hash("digest"), F.col("blocks"))
    pairs = (
        blocks.withColumn("block", block)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            F.when(F.col("blocks") == 1, F.pmod(F.hash("label"), F.lit(4 * count)).cast("long")).otherwise(F.col("label")).alias("part"),
            F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "label", "digest", "shingles", "block",
        )
    )
    confirmed = group_arrow(pairs, ["part", "one", "two"], _confirm(threshold), "u binary, v binary")
    inner = folders() - lasting
    joined = components(confirmed)
    forget(inner)
    labelled = unique.select("digest", "rep").join(joined, F.col("digest") == F.col("node"), "left").select("digest", "rep", F.coalesce("label", "digest").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("least"))
    classes = labelled.join(least, "label").select("digest", F.col("least").alias("component_id"))
    out = sets.select("id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = np.frombuffer(b"".join(d[:8] for d in batch.column("digest").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64())], names=["digest", "rep", "hash", "n", "node"])


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows whose id is their component's; rows that repeat that id all stay."""
    kept = near_duplicates(docs, id_col, text_col, threshold).filter("kept").select(F.col(id_col).alias("_kept")).distinct()
    # shuffled at every size: the kept ids grow with the corpus
    return docs.join(kept.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("_kept")), "left_semi")
