"""Removal of passages that repeat across documents, by compacting a de Bruijn graph of words.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window of ``width`` consecutive words is an edge of the graph between its
first and its last ``width - 1`` words. A word goes if a window over it also starts in a document with a smaller id.

1. A window's anchor is the smallest hash of its short word grams. Equal windows have equal anchors, so windows
   whose anchor occurs in one document only are unique; anchors are about ``2 / (width - 3)`` of the windows.
2. Windows with a shared anchor become edges (64 and 32 bits of two independent hashes, id, position). Their first occurrence, by id and position, is their source.
3. Edges that continue each other in the document and in the source compact into paths: spans with source
   coordinates and the sum of their windows' hashes. A join by id brings them back to their texts, where a span only
   counts if the text's own windows give that sum. Whole copies are spans of their own, found by a text digest.

Each task combines what it holds before it sends: a window in a third of all documents crosses the shuffle once per
task, and documents that share it inside a task are settled there.

Nulls: a null text has no words. A row without id loses nothing and is no source. Rows that repeat an id are
one document: they take nothing from each other. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import buckets, column_bytes, group_arrow, ids_of, map_arrow, partitions, sliced
from llm.kernel import U, chunks, grams, joined, mix, split_words

_GRAM = 5
_FLUSH = 1 << 18
_HITS = "bucket int, docs binary, anchors binary"
# Edges: one and two are a window's hashes. Spans: runs of ``n`` windows, one is the sum of their hashes.
_NAMES = ["docs", "at", "n", "one", "two", "source", "source_at"]
_KINDS = [np.int64, np.uint32, np.uint32, U, np.uint32, np.int64, np.uint32]
_EDGES = "bucket int, " + ", ".join(f"{n} binary" for n in _NAMES)
SPANS = "array<struct<start:long,length:long,source_id:long,source_start:long>>"


def window_anchors(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of every window, the window's first word, and bounds per document."""
    n, k = len(hashes), min(_GRAM, width)
    if n < width:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    gram = hashes[: n - k + 1].copy()
    for j in range(1, k):
        gram *= U(0xD6E8FEB86659FD93)
        gram += hashes[j : n - k + 1 + j]
    low, span = mix(gram, 5), 1
    while span < width - k + 1:  # minima over doubling spans
        step = min(span, width - k + 1 - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    stops = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n - width + 1) + width <= stops[: n - width + 1])
    return low[at], at, np.searchsorted(at, first)


def _first_of(keys: list[np.ndarray]) -> np.ndarray:
    """True where a row differs from the one above in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _doc_bucket(ids: np.ndarray, count: int) -> np.ndarray:
    return -1 - (mix(ids.view(U), 9) % U(count)).astype(np.int32)


def _send_anchors(count: int, width: int):
    """Anchors go to their bucket as 32 bits: enough for a filter, since a bucket holds a bounded share of the data."""

    def emit(anchors: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((docs, anchors))
        anchors, docs = anchors[order], docs[order]
        new = _first_of([anchors, docs])
        anchors, docs = anchors[new], docs[new]
        new = _first_of([anchors])
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1 if len(group) else new
        low = (anchors >> U(32)).astype(np.uint32)
        for rows, place in ((new, (anchors % U(count)).astype(np.int32)), (shared, _doc_bucket(docs, count))):
            rows = np.flatnonzero(rows)
            rows = rows[np.argsort(docs[rows], kind="stable")]  # equal neighbours compress
            yield from buckets(["docs", "anchors"], place[rows], [docs[rows], low[rows]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, owners = 0, [], []
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, known = ids_of(part.column("id"))
                words = split_words(part.column("text"))
                anchors, _, at = window_anchors(words.hashes(False), words.first, width)
                docs = np.repeat(np.arange(len(ids)), np.diff(at))
                new = _first_of([anchors, docs]) & known[docs]
                parts.append(anchors[new])
                owners.append(ids[docs[new]])
                held += len(parts[-1])
                if held >= _FLUSH:
                    yield from emit(np.concatenate(parts), np.concatenate(owners))
                    held, parts, owners = 0, [], []
        if held:
            yield from emit(np.concatenate(parts), np.concatenate(owners))

    return work


def _shared_anchors(count: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        docs, anchors = column_bytes(table.column("docs"), np.int64), column_bytes(table.column("anchors"), np.uint32)
        if key[0].as_py() >= 0:
            order = np.argsort(anchors, kind="stable")
            docs, anchors = docs[order], anchors[order]
            group = np.cumsum(_first_of([anchors])) - 1
            shared = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
            docs, anchors = docs[shared], anchors[shared]
            order = np.argsort(docs, kind="stable")
            docs, anchors = docs[order], anchors[order]
        return pa.Table.from_batches(list(buckets(["docs", "anchors"], _doc_bucket(docs, count), [docs, anchors])), _schema(["docs", "anchors"]))

    return work


def _schema(names: list[str]) -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names)])


def _per_document(names: list[str], kinds: list):
    """One row per document of a document bucket, its entries packed."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        docs = column_bytes(table.column("docs"), np.int64)
        order = np.argsort(docs, kind="stable")
        owners, at = sliced(docs, docs[order])
        columns = [pa.array(owners, pa.int64())]
        for name, kind in zip(names, kinds):
            values = column_bytes(table.column(name), kind)[order]
            columns.append(pa.array([values[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary()))
        return pa.table(columns, names=["doc", *names])

    return work


def _member(values: np.ndarray, at: np.ndarray, packed: list[bytes | None]) -> np.ndarray:
    """Whether each value is in its own document's packed set."""
    out = np.zeros(len(values), bool)
    for i, blob in enumerate(packed):
        if blob:
            own = np.sort(np.frombuffer(blob, values.dtype))
            mine = values[at[i] : at[i + 1]]
            out[at[i] : at[i + 1]] = own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine
    return out


def _settle(docs, at, one, two):
    """Occurrences sorted by window, id and position; which belong to their window's first document, and the first one's row."""
    order = np.lexsort((at, docs, two, one))
    docs, at, one, two = docs[order], at[order], one[order], two[order]
    begins = _first_of([one, two])
    rows = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(begins) else np.zeros(0, np.int64)
    return docs, at, one, two, docs == docs[rows], rows


def compact(docs, at, n, one, source, source_at):
    """Paths: spans that continue each other both in the document and in the source become one."""
    order = np.lexsort((at, docs))
    docs, at, n, one, source, source_at = (x[order] for x in (docs, at, n, one, source, source_at))
    begins = np.ones(len(docs), bool)
    if len(docs) > 1:
        step = n[:-1].astype(np.int64)
        begins[1:] = (docs[1:] != docs[:-1]) | (source[1:] != source[:-1])
        begins[1:] |= (np.diff(at.astype(np.int64)) != step) | (np.diff(source_at.astype(np.int64)) != step)
    firsts = np.flatnonzero(begins)
    if len(firsts):
        n, one = np.add.reduceat(n, firsts, dtype=np.uint32), np.add.reduceat(one, firsts)
    return docs[firsts], at[firsts], n, one, source[firsts], source_at[firsts]


def _pack_spans(count: int, docs, at, n, one, source, source_at) -> Iterator[pa.RecordBatch]:
    docs, at, n, one, source, source_at = compact(docs, at, n, one, source, source_at)
    yield from buckets(_NAMES, _doc_bucket(docs, count), [docs, at, n, one, np.zeros(0, np.uint32), source, source_at])


def _send_edges(count: int, width: int):
    def emit(docs, at, one, two) -> Iterator[pa.RecordBatch]:
        docs, at, one, two, source, rows = _settle(docs, at, one, two)
        later = ~source
        yield from _pack_spans(count, docs[later], at[later], np.ones(int(later.sum()), np.uint32), one[later], docs[rows[later]], at[rows[later]])
        send = np.flatnonzero(source)
        send = send[np.lexsort((at[send], docs[send]))]  # equal neighbours compress
        none = np.zeros(0, np.uint32)
        yield from buckets(_NAMES, (one[send] % U(count)).astype(np.int32), [docs[send], at[send], none, one[send], two[send], none, none])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = 0, []
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, _ = ids_of(part.column("id"))
                origin, copied = ids_of(part.column("original"))
                words = split_words(part.column("text"))
                hashes = words.hashes(False)
                anchors, start, at = window_anchors(hashes, words.first, width)
                window, _, _ = grams(hashes, words.first, width)
                whole = np.flatnonzero(copied & (np.diff(at) > 0))  # a copy repeats its original from end to end
                if len(whole):
                    sums = np.concatenate([np.zeros(1, U), np.cumsum(window)])
                    zero, n = np.zeros(len(whole), np.uint32), np.diff(at)[whole].astype(np.uint32)
                    yield from _pack_spans(count, ids[whole], zero, n, (sums[at[1:]] - sums[at[:-1]])[whole], origin[whole], zero)
                second, _, _ = grams(words.hashes(False, 1), words.first, width)
                hit = _member((anchors >> U(32)).astype(np.uint32), at, part.column("anchors").to_pylist())
                owner = np.repeat(np.arange(len(ids)), np.diff(at))
                hit &= ~copied[owner]
                docs = owner[hit]
                parts.append((ids[docs], (start[hit] - words.first[docs]).astype(np.uint32), window[hit], (second[hit] >> U(32)).astype(np.uint32)))
                held += len(docs)
                if held >= _FLUSH:
                    yield from emit(*map(np.concatenate, zip(*parts)))
                    held, parts = 0, []
        if held:
            yield from emit(*map(np.concatenate, zip(*parts)))

    return work


def _later_spans(count: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        docs, at, n, one, two, source, source_at = (column_bytes(table.column(c), k) for c, k in zip(_NAMES, _KINDS))
        if key[0].as_py() >= 0:
            docs, at, one, two, first, rows = _settle(docs, at, one, two)
            later = ~first
            docs, at, one, source, source_at = docs[later], at[later], one[later], docs[rows[later]], at[rows[later]]
            n = np.ones(len(docs), np.uint32)
        return pa.Table.from_batches(list(_pack_spans(count, docs, at, n, one, source, source_at)), _schema(_NAMES))

    return work


def _document_spans(key: tuple, table: pa.Table) -> pa.Table:
    """One row per document of a document bucket: its paths, packed."""
    cols = [column_bytes(table.column(c), k) for c, k in zip(_NAMES, _KINDS) if c != "two"]
    docs, *cols = compact(*cols)
    owners, at = sliced(docs, docs)
    packed = [pa.array([c[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary()) for c in cols]
    return pa.table([pa.array(owners, pa.int64()), *packed], names=["doc", "at", "n", "one", "source", "source_at"])


def _cut(width: int):
    """Removes each row's spans. A span only counts if the row's own windows at its place have the span's hash sum."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "source_id", "source_start")]))
    names, kinds = ["at", "n", "one", "source", "source_at"], [np.uint32, np.uint32, U, np.int64, np.uint32]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = split_words(part.column("text"))
                gone = np.zeros(len(words.starts) + 1, np.int64)
                packed = [part.column(c).to_pylist() for c in names]
                paths: list[list[dict]] = [[] for _ in range(len(part))]
                if any(packed[0]):
                    window, _, bounds = grams(words.hashes(False), words.first, width)
                    sums = np.concatenate([np.zeros(1, U), np.cumsum(window)])
                    for i, blobs in enumerate(zip(*packed)):
                        if not blobs[0]:
                            continue
                        at, n, one, source, source_at = (np.frombuffer(b, k) for b, k in zip(blobs, kinds))
                        at, n, source_at = at.astype(np.int64), n.astype(np.int64), source_at.astype(np.int64)
                        fits = at + n <= bounds[i + 1] - bounds[i]
                        at, n, one, source, source_at = at[fits], n[fits], one[fits], source[fits], source_at[fits]
                        true = sums[bounds[i] + at + n] - sums[bounds[i] + at] == one
                        at, n, source, source_at = at[true], n[true], source[true], source_at[true]
                        np.add.at(gone, words.first[i] + at, 1)
                        np.subtract.at(gone, words.first[i] + at + n + width - 1, 1)
                        paths[i] = [
                            {"start": a, "length": m + width - 1, "source_id": s, "source_start": b}
                            for a, m, s, b in zip(at.tolist(), n.tolist(), source.tolist(), source_at.tolist())
                        ]
                keep = np.cumsum(gone[:-1]) == 0
                data, bounds = joined(words, keep)
                kept_before = np.concatenate([[0], np.cumsum(keep)])[words.first]
                total = np.diff(words.first)
                text = pa.Array.from_buffers(pa.large_string(), len(part), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(total), pa.array(total - np.diff(kept_before)), text.cast(pa.string()), pa.array(paths, kind)],
                    names=["row", "n_words", "n_removed", "kept", "spans"],
                )

    return work


def repeated_paths(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per document that repeats an earlier one: its repeated paths, packed, with their sources."""
    count = partitions(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = map_arrow(texts, _send_anchors(count, width), _HITS)
    shared = group_arrow(sent, ["bucket"], _shared_anchors(count), _HITS)
    hits = group_arrow(shared, ["bucket"], _per_document(["anchors"], [np.uint32]), "doc long, anchors binary")
    # Whole copies are settled by a digest; only the smallest id of a text goes on as edges.
    digest = texts.filter("id IS NOT NULL AND text IS NOT NULL").select("id", F.md5("text").alias("digest"))
    groups = digest.groupBy("digest").agg(F.min("id").alias("original"), F.max("id").alias("_last")).filter("original <> _last").drop("_last")
    copies = digest.join(groups, "digest").filter("id > original").groupBy(F.col("id").alias("copy")).agg(F.min(F.struct("original", "digest")).alias("c"))
    # An id with two texts may be a copy twice: its second text then goes on as edges.
    wanted = hits.join(copies, F.col("doc") == F.col("copy"), "full").select(
        F.coalesce("doc", "copy").alias("doc"), "anchors", F.col("c.original").alias("original"), F.col("c.digest").alias("digest")
    )
    same = F.md5("text") == F.col("digest")
    # An outer join with a null-safe filter keeps the texts' side as remove_repeats joins it, so that their shuffle is shared.
    found = texts.join(wanted.hint("merge"), F.col("id") == F.col("doc"), "left").filter(F.col("id").eqNullSafe(F.col("doc")))
    found = found.select("id", "text", "anchors", F.when(same, F.col("original")).alias("original"))
    edges = map_arrow(found, _send_edges(count, width), _EDGES)
    later = group_arrow(edges, ["bucket"], _later_spans(count), _EDGES)
    return group_arrow(later, ["bucket"], _document_spans, "doc long, at binary, n binary, one binary, source binary, source_at binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, keep_columns: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (kept words joined by one space), spans (repeated paths and their sources).

    With ``keep_columns`` the row's own columns come first, and those four replace columns of the same names.
    """
    made = ["n_words", "n_removed", "kept", "spans"]
    own = [c for c in docs.columns if c not in made] if keep_columns else [id_col]
    id_type = docs.schema[id_col].dataType
    # Columns travel under their place; the id and the text travel once if the cast gives them back.
    place = {c: f"_{k}" for k, c in enumerate(own)}
    if isinstance(id_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        place |= {id_col: "id"} if id_col in place else {}
    if docs.schema[text_col].dataType == T.StringType() and text_col in place and text_col != id_col:
        place[text_col] = "text"
    carried = [F.col(f"`{c}`").alias(p) for c, p in place.items() if p not in ("id", "text")]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carried)
    later = repeated_paths(docs, id_col, text_col, width)
    row = F.struct(*[(F.col(p).cast(id_type) if p == "id" else F.col(p)).alias(c) for c, p in place.items()])
    rows = texts.join(later.hint("merge"), F.col("id") == F.col("doc"), "left").select(row.alias("row"), "text", "at", "n", "one", "source", "source_at")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType)])
    for name, kind in zip(made, ("long", "long", "string", SPANS)):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return map_arrow(rows, _cut(width), schema).select("row.*", *made)
