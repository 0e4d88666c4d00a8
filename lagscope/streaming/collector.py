"""Incremental collection: what changed since the last position, as points, then the position."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lagscope.operators.filters import after_id, newer_than
from lagscope.operators.points import PointSpec, split_rejects, to_line_protocol
from lagscope.operators.rollups import last_value_by
from lagscope.session import typed_time
from lagscope.streaming.positions import START_ID, START_TIME, WatermarkTable


@dataclass(frozen=True)
class Source:
    """One table to collect: how to read it, its position column and its point."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    position: str
    spec: PointSpec
    by_id: bool = False


def capture_changes(df: DataFrame, ts: str, last, upto=None) -> DataFrame:
    """Rows of a table updated in place whose time moved past ``last``; states append as history."""
    rows = newer_than(df, ts, last)
    return rows if upto is None else rows.filter(F.col(ts) <= typed_time(df, ts, upto))


def latest_state(states: DataFrame, key: str, ts: str, cols, tie: str | None = None) -> DataFrame:
    """The exact latest state per key of captured history."""
    return last_value_by(states, [ts, tie] if tie else [ts], cols, by=[key])


def collect_once(spark: SparkSession, sources: list[Source], positions: WatermarkTable, out: str,
                 overlap: timedelta | None = None, side_by_side: int = 4) -> dict[str, object]:
    """One run over all sources, ``side_by_side`` at a time; returns the new positions.

    A source is read once: its new rows are encoded and written, and the new position is the
    largest one among the rows just written, so rows that arrive meanwhile wait for the next run.
    A run writes the partition named after the position it starts from and saves the new positions
    last; a run that died is repeated into the same partition. With ``overlap`` the read starts
    earlier and ``dedupe_points`` removes what was written before. If a source fails, the others
    are still collected and their positions saved before its error is raised.
    """
    starts = {s.name: positions.get(s.name, START_ID if s.by_id else START_TIME) for s in sources}
    with ThreadPoolExecutor(max(1, side_by_side)) as pool:
        runs = {s.name: pool.submit(inheritable_thread_target(spark)(_collect), spark, s, starts[s.name], out, overlap) for s in sources}
    moved = {name: run.result() for name, run in runs.items() if run.exception() is None and run.result() is not None}
    if moved:
        positions.commit(moved)
    for run in runs.values():
        run.result()
    return moved


def _collect(spark: SparkSession, source: Source, last, out: str, overlap: timedelta | None):
    """Writes a source's new points; its new position, None if it did not move."""
    df = source.read(spark)
    if source.by_id:
        fresh, label = after_id(df, source.position, last), str(last)
    else:
        low = last - overlap if overlap and last != START_TIME else last
        fresh, label = capture_changes(df, source.position, low), f"{last:%Y%m%dT%H%M%S%f}"
    encoded = _encoded(fresh, source.spec, source.position)
    largest = Observation()
    # As text in the session's zone: a collected timestamp would be in the driver's.
    seen = encoded.observe(largest, F.max("position").cast("string").alias("top"))
    seen.withColumn("from", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("from").parquet(_folder(out, source.name))
    top = largest.get["top"]
    if top is None:
        return None
    top = int(top) if source.by_id else datetime.fromisoformat(top)
    return top if top > last else None


def _encoded(rows: DataFrame, spec: PointSpec, position: str) -> DataFrame:
    """Position, line and reject; a rejected row stays readable as JSON, since the position moves past it."""
    row = F.when(F.col("reject").isNotNull(), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    return to_line_protocol(rows, spec).select(F.col(position).alias("position"), "line", "reject", row.alias("row"))


def _folder(out: str, name: str) -> str:
    return f"{out.rstrip('/')}/{name}"


def collected_points(spark: SparkSession, out: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``(lines, rejects)`` of everything collected from a source so far."""
    try:
        rows = spark.read.parquet(_folder(out, name))
    except AnalysisException:  # no run has found any row
        rows = spark.createDataFrame([], "position string, line string, reject string, row string")
    lines, rejects = split_rejects(rows)
    return lines, rejects.select("position", "reject", "row")


def stream_points(rows: DataFrame, spec: PointSpec, out: str, available_now: bool = False):
    """Starts a query that writes the points of a stream of rows, read back by ``collected_points``.

    Encoding has no state, so the query only appends; Spark's checkpoint below ``out`` keeps the
    position and a repeated batch is written once.
    """
    encoded = _encoded(rows, spec, spec.time)
    out = out.rstrip("/")
    writer = encoded.writeStream.format("parquet").option("path", f"{out}/{spec.measurement}")
    writer = writer.option("checkpointLocation", f"{out}/checkpoint/{spec.measurement}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_collect(spark: SparkSession, tick: Callable[[datetime], None], checkpoint: str, trigger: str = "60 seconds"):
    """Calls ``tick`` on every trigger of a streaming query and returns the query."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def on_batch(_: DataFrame, __: int) -> None:
        tick(datetime.now())

    return (
        clock.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=trigger)
        .start()
    )
