"""Tables polled by position (a time or an id) as a streaming source.

How far a table was read is the offset of a Spark source, so the query's checkpoint is the position: what a batch reads is fixed
before it is read, a batch that died is read again, and a restart goes on where the last one ended. Rows are read by
tasks, in slices of the position; only the largest position is asked for on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lagscope.streaming.positions import START_ID, START_TIME

Position = int | datetime


@dataclass(frozen=True)
class DbTable:
    """A table behind a DB-API connection; ``connect`` runs on the driver and in every task. ``mark`` is the driver's parameter mark."""

    connect: Callable
    table: str
    position: str
    columns: tuple[str, ...]
    mark: str = "%s"

    def top(self, after: Position, until: Position | None) -> Position | None:
        bound = "" if until is None else f" AND {self.position} <= {self.mark}"
        return self._ask(f"SELECT MAX({self.position}) FROM {self.table} WHERE {self.position} > {self.mark}{bound}", after, *([] if until is None else [until]))

    def _ask(self, text: str, *values):
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(text, tuple(_bound(v) for v in values))
            return cursor.fetchone()[0]
        finally:
            connection.close()

    def slices(self, after: Position, upto: Position, parts: int) -> list[tuple]:
        """Equal steps of the position; every slice is a range of its own connection."""
        if isinstance(after, datetime):
            step = (upto - after) / parts
            cuts = [after + k * step for k in range(parts)]
        else:
            cuts = [after + (upto - after) * k // parts for k in range(parts)]
        return [(a, b) for a, b in zip(cuts, [*cuts[1:], upto]) if a < b]

    def rows(self, part: tuple) -> Iterator:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE {self.position} > {self.mark} AND {self.position} <= {self.mark}", tuple(map(_bound, part)))
            while found := cursor.fetchmany(10_000):
                yield from map(tuple, found)
        finally:
            connection.close()


@dataclass(frozen=True)
class ParquetTable:
    """A parquet file or folder that grows, by any path that Arrow opens in every task; row groups outside the range are not read."""

    path: str
    position: str
    columns: tuple[str, ...]

    def _data(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format="parquet")

    def _between(self, after: Position, upto: Position | None):
        import pyarrow.dataset as ds

        where = ds.field(self.position) > after
        return where if upto is None else where & (ds.field(self.position) <= upto)

    def top(self, after: Position, until: Position | None) -> Position | None:
        import pyarrow.compute as pc

        best = None
        for batch in self._data().to_batches(columns=[self.position], filter=self._between(after, until)):
            own = pc.max(batch.column(0)).as_py()
            best = own if best is None or (own is not None and own > best) else best
        return best

    def slices(self, after: Position, upto: Position, parts: int) -> list[tuple]:
        return [(f.path, after, upto) for f in self._data().get_fragments(filter=self._between(after, upto))]

    def rows(self, part: tuple) -> Iterator:
        import pyarrow.dataset as ds

        path, after, upto = part
        data = ds.dataset(path, format="parquet", filesystem=self._data().filesystem)
        yield from data.to_batches(columns=list(self.columns), filter=self._between(after, upto))


def _bound(value: Position):
    return value.isoformat(sep=" ") if isinstance(value, datetime) else value


class _Slice(InputPartition):
    def __init__(self, part: tuple):
        self.part = part


class _Reader(DataSourceStreamReader):
    def __init__(self, table, start: Position, until: Position | None, overlap: timedelta | None, parts: int):
        self.table, self.start, self.until, self.overlap, self.parts = table, start, until, overlap, parts
        self.reached: Position | None = None

    def _read(self, offset: dict) -> Position:
        return datetime.fromisoformat(offset["position"]) if isinstance(self.start, datetime) else int(offset["position"])

    def _offset(self, position: Position) -> dict:
        return {"position": position.isoformat(sep=" ") if isinstance(position, datetime) else str(position)}

    def initialOffset(self) -> dict:
        return self._offset(self.start)

    def latestOffset(self) -> dict:
        after = self.start if self.reached is None else self.reached
        top = self.table.top(after, self.until)
        if isinstance(self.start, datetime) and isinstance(top, str):
            top = datetime.fromisoformat(top)
        self.reached = after if top is None else max(after, top)
        return self._offset(self.reached)

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        after, upto = self._read(start), self._read(end)
        self.reached = upto if self.reached is None else max(self.reached, upto)
        if self.overlap is not None and after != self.start:
            after = after - self.overlap
        return [_Slice(part) for part in self.table.slices(after, upto, self.parts)]

    def read(self, partition: _Slice) -> Iterator:
        yield from self.table.rows(partition.part)

    def commit(self, end: dict) -> None:
        pass


def read_polled(spark: SparkSession, table, schema: T.StructType, by_id: bool = False, start: Position | None = None, until: Position | None = None,
                overlap: timedelta | None = None, parts: int = 4) -> DataFrame:
    """The rows of ``table`` strictly after ``start``, as a stream that goes on as the table grows.

    A row that is committed later with a position already passed is only seen with ``overlap``, which reads that much again in every
    batch; ``dedupe_points`` then removes repeats. ``until`` ends a backfill: rows behind it wait for a run with a later one.
    """
    first = start if start is not None else START_ID if by_id else START_TIME
    name = f"polled_{uuid.uuid4().hex}"

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return schema

        def streamReader(self, schema):
            return _Reader(table, first, until, overlap, parts)

    spark.dataSource.register(Polled)
    return spark.readStream.format(name).load()


def saved_positions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``batch``, ``position`` and ``done`` of a query over one polled table, from its checkpoint."""
    number = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)$", 1).try_cast("long").alias("batch")
    lines = spark.read.text(f"{checkpoint.rstrip('/')}/offsets").select(number, F.get_json_object("value", "$.position").alias("position"))
    done = spark.read.text(f"{checkpoint.rstrip('/')}/commits").select(number).distinct().withColumn("done", F.lit(True))
    return lines.filter("position IS NOT NULL").join(done, "batch", "left").select("batch", "position", F.coalesce("done", F.lit(False)).alias("done"))
