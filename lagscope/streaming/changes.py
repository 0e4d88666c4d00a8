"""Streaming use of change events: handlers per kind, transactions, materialised tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lagscope.operators.changes import DELETE, latest_changes
from lagscope.operators.rollups import interval_seconds
from lagscope.schemas import CHANGE_KINDS

DONE = "gtid string, file string, changes long, first_pos long, last_pos long, closed boolean"
_OPEN = "file string, changes long, first_pos long, last_pos long"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def handle_changes(changes: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str,
                   available_now: bool = False):
    """Starts a query that hands the events of each kind in a batch to that kind's function; the batch's source is read once."""
    unknown = set(handlers) - set(CHANGE_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {', '.join(sorted(unknown))}")

    def on_batch(batch: DataFrame, number: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)  # a lost executor's part is read again
        try:
            for kind, handler in handlers.items():
                handler(batch.filter(F.col("kind") == kind), number)
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class _Transactions(StatefulProcessor):
    """A summary per open transaction as keyed state; one that ends, or whose time is over, comes out and is forgotten."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues):
        known = self.open.exists()
        file, changes, first, last = self.open.get() if known else (None, 0, None, None)
        closed = False
        for event in rows:
            if event.file is not None:
                file = event.file if file is None else max(file, event.file)
            if event.pos is not None:
                first = event.pos if first is None else min(first, event.pos)
                last = event.pos if last is None else max(last, event.pos)
            changes += event.kind == "row"
            closed = closed or event.kind == "xid"
        if closed:
            if known:
                self._forget()
            yield Row(gtid=key[0], file=file, changes=changes, first_pos=first, last_pos=last, closed=True)
            return
        self.open.update((file, changes, first, last))
        if self.timeout_ms is not None and not known:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.open.exists():
            file, changes, first, last = self.open.get()
            self._forget()
            yield Row(gtid=key[0], file=file, changes=changes, first_pos=first, last_pos=last, closed=False)

    def _forget(self) -> None:
        self.open.clear()
        for timer in list(self.handle.listTimers()) if self.timeout_ms is not None else []:
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def closed_transactions(changes: DataFrame, timeout: str | None = None) -> DataFrame:
    """A streaming table of transactions (``DONE``), each put out in the batch in which its end arrives.

    Spark's state store holds a summary per open transaction, not its events, so state does not grow with a transaction's
    size; a huge one passes its task event by event. With ``timeout`` (``"10 minutes"`` of processing time since its first
    event) one whose end has not come is put out with ``closed = false``; what comes later is put out as another part. The session
    needs the RocksDB state store, which ``stream_transactions`` sets.
    """
    file = F.col("file") if "file" in changes.columns else F.lit(None).cast("string")
    events = changes.filter(F.col("gtid").isNotNull()).select("gtid", file.alias("file"), "kind", F.col("pos").cast("long").alias("pos"))
    milliseconds = None if timeout is None else interval_seconds(timeout) * 1000
    return events.groupBy("gtid").transformWithState(_Transactions(milliseconds), DONE, "Append", "None" if timeout is None else "ProcessingTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards, a query keeps what it started with."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stream_transactions(changes: DataFrame, folder: str, timeout: str | None = None, available_now: bool = False, trigger: str | None = None):
    """Starts a query that writes ``closed_transactions`` to ``folder``/done, its state and position to ``folder``/checkpoint.

    A batch is written once, whatever is repeated: Spark's file sink keeps a log. Results without the checkpoint that they belong to are refused.
    """
    spark, folder = changes.sparkSession, folder.rstrip("/")
    if _exists(spark, f"{folder}/done/_spark_metadata") and not _exists(spark, f"{folder}/checkpoint"):
        raise ValueError(f"{folder} has the batches of another checkpoint")
    with rocksdb_state(spark):
        writer = closed_transactions(changes, timeout).writeStream.format("parquet").option("path", f"{folder}/done").option("checkpointLocation", f"{folder}/checkpoint")
        if available_now:
            writer = writer.trigger(availableNow=True)
        elif trigger:
            writer = writer.trigger(processingTime=trigger)
        return writer.start()


def finished_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions put out so far, each once: parts of one that was put out early are added up."""
    done = spark.read.schema(DONE).parquet(f"{folder.rstrip('/')}/done")
    return done.groupBy("gtid").agg(
        F.max("file").alias("file"), F.sum("changes").alias("changes"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.max("closed").alias("closed")
    )


def open_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions whose end has not come, read from the state of ``stream_transactions``."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{folder.rstrip('/')}/checkpoint")
    return state.select("key.gtid", "value.*")


def stream_table(rows: DataFrame, folder: str, keys, order, available_now: bool = False):
    """Starts a query that adds the last typed change per key of every batch to ``folder``/changes, a table partitioned by batch.

    ``rows`` has the table's columns, ``op`` and the order columns. A batch costs as much as the batch is large, whatever
    the size of the table; a repeated batch overwrites its own partition. ``current_table`` merges on read and
    ``compact_table`` folds the batches so far into one state.
    """
    folder = folder.rstrip("/")

    def on_batch(batch: DataFrame, number: int) -> None:
        out = latest_changes(batch, keys, order).withColumn("_batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{folder}/changes")

    writer = rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{folder}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _table_rows(spark: SparkSession, folder: str, keys, order) -> tuple[DataFrame, int]:
    """Last change per key, deletes among them, and the batch reached. Partitions that a fold covers are not read."""
    folder = folder.rstrip("/")
    changes, upto = spark.read.parquet(f"{folder}/changes"), -1
    rows = changes
    if _exists(spark, f"{folder}/state"):
        state = spark.read.parquet(f"{folder}/state")
        upto = state.agg(F.max("_upto")).first()[0]
        upto = -1 if upto is None else upto
        rows = changes.filter(F.col("_batch") > upto).drop("_batch").unionByName(state.filter(F.col("_upto") == upto).drop("_upto"))
    reached = changes.agg(F.max("_batch")).first()[0]
    return latest_changes(rows.drop("_batch"), keys, order), max(upto, -1 if reached is None else reached)


def current_table(spark: SparkSession, folder: str, keys, order) -> DataFrame:
    """The table after all batches: last change per key, deleted rows left out."""
    order = [order] if isinstance(order, str) else list(order)
    rows, _ = _table_rows(spark, folder, keys, order)
    return rows.filter(F.col("op") != DELETE).drop("op", *order)


def compact_table(spark: SparkSession, folder: str, keys, order) -> int:
    """Folds all batches so far into a partition of ``folder``/state; returns the batch it reaches.

    The state keeps the order columns and deleted keys, so changes that arrive late still merge rightly.
    """
    rows, upto = _table_rows(spark, folder, keys, order)
    out = rows.withColumn("_upto", F.lit(upto).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_upto").parquet(f"{folder.rstrip('/')}/state")
    return upto
