"""Helpers the operators share: saved tables, packed columns, hash buckets and connected components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.session import shared_folder

_saved: set[str] = set()
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's; others give memory back by themselves
_LARGE = 1 << 20
FILE_ROWS = 1 << 17


def folders() -> set[str]:
    """The folders of this module that exist now."""
    return set(_saved)


def forget(paths: set[str] | None = None) -> None:
    """Deletes these folders, or all: what was read from them must have been written on."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(_saved if paths is None else paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
        _saved.discard(path)


atexit.register(forget)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session's program ends."""
    path = shared_folder(spark, f"llm-{name}-{uuid.uuid4().hex}")
    _saved.add(path)
    return path


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write once below ``spark.checkpoint.dir`` and read back: cuts lineage, survives lost executors, removed at exit.

    ``rows``, if an upper bound is known, keeps a small table in few files.
    """
    path = new_folder(df.sparkSession, name)
    if rows is not None and rows // FILE_ROWS + 1 < partitions(df.sparkSession):
        df = df.coalesce(rows // FILE_ROWS + 1)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(df: DataFrame, size: int = 1 << 23) -> int:
    """Buckets for packed groups: one for each ``size`` bytes that the planner expects of ``df``, and no fewer than shuffle partitions."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = expected < 1 << 60  # else the planner has no idea
    return max(partitions(df.sparkSession), -(-expected // size) if known else 1)


def binary(arrays: list[bytes]) -> pa.Array:
    return pa.array(arrays, pa.binary())


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 and which of them are present."""
    column = column.cast(pa.int64())
    known = np.asarray(column.is_valid())
    return np.asarray(column.fill_null(0)), known


def column_bytes(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """All binary values of a column, one after another, as one array."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def sliced(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of equal neighbours in a sorted ``owner``: the distinct owners and where each begins, with the end."""
    if not len(owner):
        return owner, np.zeros(1, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[begins], np.append(begins, len(owner))


def buckets(names: list[str], bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, packed arrays): one per bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    arrays = [a[order] if len(a) else a for a in arrays]  # an empty one stays empty
    owners, at = sliced(order, bucket[order])
    if len(owners):
        columns = [binary([a[s:e].tobytes() if len(a) else b"" for s, e in zip(at, at[1:])]) for a in arrays]
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int32()), *columns], names=["bucket", *names])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the undirected ``edges`` (u, v).

    Large-star and small-star rounds on distinct edges: each round is a few keyed aggregations and joins, so a
    node with a third of all edges combines on the map side. Rounds end when no edge changes. Each is written once, and
    the one before it is deleted.
    """
    older: set[str] = set()

    def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
        nonlocal older
        before = folders()
        out = saved(df, "links", rows)
        forget(older)
        older = folders() - before
        return out

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            near = df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        both = near.join(low, "u")
        if large:
            out = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    current = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, rows = None, None
    while True:
        current = keep(star(star(current, True), False), rows)
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, rows = mark, 3 * mark[0]  # a round adds at most an edge for each it has and one for each of its nodes
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).union(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def spare_name(df: DataFrame) -> str:
    """A column name that clashes with none of the frame's, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return next(name for name in map("_held{}".format, range(len(taken) + 1)) if name not in taken)


def release() -> None:
    """Hands memory that a task no longer needs back to the system: idle Python workers live on beside busy ones."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` that releases what it held at the end of each task."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return df.mapInArrow(held, schema)


def group_arrow(df: DataFrame, keys: list[str], work: Callable, schema) -> DataFrame:
    """``applyInArrow`` on a key and its table that releases what a group held."""

    def held(key: tuple, table: pa.Table) -> pa.Table:
        out = work(key, table)
        if table.nbytes > _LARGE:
            del table
            release()
        return out

    return df.groupBy(*keys).applyInArrow(held, schema)
