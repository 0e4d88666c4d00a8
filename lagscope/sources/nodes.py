"""Status of many nodes: one source with a task per few nodes, and a row for every node, reachable or not."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Nodes(InputPartition):
    def __init__(self, addresses: list[str]):
        self.addresses = addresses


class _Reader(DataSourceReader):
    def __init__(self, addresses: list[str], fetch: Callable[[str], Iterable[Mapping]], names: list[str], per_task: int):
        self.addresses, self.fetch, self.names, self.per_task = addresses, fetch, names, per_task

    def partitions(self) -> list[_Nodes]:
        return [_Nodes(self.addresses[k : k + self.per_task]) for k in range(0, len(self.addresses), self.per_task)] or [_Nodes([])]

    def read(self, partition: _Nodes) -> Iterator[tuple]:
        for address in partition.addresses:
            try:
                rows = [dict(row) for row in self.fetch(address)]
            except Exception as error:  # whatever a node answers, the other nodes' rows stand
                yield (address, False, f"{type(error).__name__}: {error}", *[None] * len(self.names))
                continue
            for row in rows:
                yield (address, True, None, *[row.get(name) for name in self.names])
            if not rows:  # a node that answers but replicates nothing
                yield (address, True, None, *[None] * len(self.names))


def read_nodes(spark: SparkSession, addresses: Sequence[str], fetch: Callable[[str], Iterable[Mapping]], schema: T.StructType, per_task: int = 1) -> DataFrame:
    """``address``, ``reachable``, ``error`` and the columns of ``schema``: the status rows that ``fetch(address)`` returns, in any task.

    The plan has one scan, however many nodes there are. A node whose ``fetch`` raises is a row with ``reachable = false`` and the
    error's text, as the health rules expect it, and not a failed job. Columns that a node does not have are NULL.
    """
    nodes, names = list(addresses), list(schema.names)
    if {"address", "reachable", "error"} & set(names):
        raise ValueError("address, reachable and error are made by the reader")
    head = [T.StructField("address", T.StringType()), T.StructField("reachable", T.BooleanType()), T.StructField("error", T.StringType())]
    whole, source = T.StructType([*head, *schema.fields]), f"nodes_{uuid.uuid4().hex}"

    class Nodes(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self):
            return whole

        def reader(self, schema):
            return _Reader(nodes, fetch, names, per_task)

    spark.dataSource.register(Nodes)
    return spark.read.format(source).load()
