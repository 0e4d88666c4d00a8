"""Hosts that stop reporting and return, as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagscope.operators.rollups import interval_seconds
from lagscope.session import as_col, typed_time

SILENT, RETURNED = "silent", "returned"


def silences(beats: DataFrame, host: str, ts: str, after: str, until, since=None, expected: DataFrame | None = None) -> DataFrame:
    """``(host, event, at)``: a host is ``silent`` once ``after`` has passed since its last beat without another, and ``returned`` at the next one.

    Only what is certain at ``until`` comes out. With ``expected``, a table of hosts, each of them counts as if it had reported at
    ``since``, so one that never reports is silent from ``since`` plus ``after``. Beats without a host or a time are left out.

    Beats that are less than ``after`` apart cannot have a silence between them: each span of that length keeps its first and last beat of a
    host, on the map side, and only these are put in order. So a host with a third of all beats is a few rows per span.
    """
    kind, length = beats.schema[ts].dataType, interval_seconds(after) * 1_000_000
    rows = beats.filter(F.col(ts) <= typed_time(beats, ts, until)).select(F.col(host).alias("host"), F.col(ts).alias("at"))
    if expected is not None:
        if since is None:
            raise ValueError("hosts are expected since some time")
        rows = rows.unionByName(expected.select(F.col(host).alias("host"), typed_time(beats, ts, since).alias("at")))
    us = F.unix_micros(as_col("at").cast("timestamp"))
    spans = rows.filter("host IS NOT NULL AND at IS NOT NULL").groupBy("host", F.floor(us / F.lit(length)).alias("_span")).agg(F.min(us).alias("_first"), F.max(us).alias("_last"))
    ahead = spans.withColumn("_next", F.lead("_first").over(Window.partitionBy("host").orderBy("_span")))
    end = F.unix_micros(F.lit(str(until)).cast(kind).cast("timestamp"))
    due = F.col("_last") + length
    gone = (F.col("_next").isNull() | (F.col("_next") > due)) & (due <= end)
    events = F.array_compact(F.array(
        F.struct(F.lit(SILENT).alias("event"), due.alias("us")),
        F.when(F.col("_next").isNotNull(), F.struct(F.lit(RETURNED).alias("event"), F.col("_next").alias("us"))),
    ))
    out = ahead.filter(gone).select("host", F.explode(events).alias("_e"))
    return out.select("host", "_e.event", F.timestamp_micros("_e.us").cast(kind).alias("at"))
