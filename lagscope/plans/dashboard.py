"""The dashboard's panels as plans over point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.functions.times import ns_to_s
from lagscope.operators.filters import between
from lagscope.operators.rollups import bucket_max, bucket_sum, fill_gaps, last_value_by, null_mode, order_by_time


def _series(rolled: DataFrame, interval: str, start, end, cols, nulls: str) -> DataFrame:
    filled = fill_gaps(rolled, "bucket", interval, start, end)
    return order_by_time(null_mode(filled, cols, nulls), "bucket")


def throughput(points: DataFrame, start, end, interval: str = "1 minute", nulls: str = "zero",
               ts: str = "time", col: str = "size") -> DataFrame:
    """Bytes per bucket over all sources."""
    rolled = bucket_sum(between(points, ts, start, end), ts, col, interval, alias="size")
    return _series(rolled, interval, start, end, "size", nulls)


def synced_rows(points: DataFrame, start, end, interval: str = "1 minute", nulls: str = "zero",
                ts: str = "time", col: str = "insert_count") -> DataFrame:
    """Inserted rows per bucket over all sources."""
    rolled = bucket_sum(between(points, ts, start, end), ts, col, interval, alias="insert_count")
    return _series(rolled, interval, start, end, "insert_count", nulls)


def cumulative_rows(points: DataFrame, start, end, interval: str = "1 minute", nulls: str = "zero",
                    ts: str = "time", tie: str = "id") -> DataFrame:
    """Last cumulative counts per bucket; the series names say max, the values are the last."""
    alias = {"update_count": "max_update_count", "insert_count": "max_insert_count", "delete_count": "max_delete_count"}
    rolled = last_value_by(between(points, ts, start, end), [ts, tie], list(alias), ts=ts, interval=interval, alias=alias)
    return _series(rolled, interval, start, end, list(alias.values()), nulls)


def max_delay(points: DataFrame, start, end, interval: str = "1 minute", nulls: str = "skip",
              ts: str = "time", col: str = "delay_time") -> DataFrame:
    """Largest delay in ms per bucket."""
    rolled = bucket_max(between(points, ts, start, end), ts, col, interval, alias="max_delay_time")
    return _series(rolled, interval, start, end, "max_delay_time", nulls)


def last_times(points: DataFrame, start, end, ts: str = "time", tie=(), cols=("last_sync_time", "last_position_time")) -> DataFrame:
    """Last sync and position time in seconds; the points hold nanoseconds."""
    last = last_value_by(between(points, ts, start, end), [ts, *tie], list(cols))
    return last.select(*[ns_to_s(c).alias(c) for c in cols])


def working_state(points: DataFrame, start, end, ts: str = "time", tie=(), by: str = "pipeline_id", state: str = "state") -> DataFrame:
    """Last state per source and the time it was seen."""
    rows = between(points, ts, start, end)
    seen = rows.withColumn("_seen", F.when(F.col(state).isNotNull(), F.col(ts)))
    out = last_value_by(seen, [ts, *tie], ["_seen", state], by=[by], alias={"_seen": ts})
    return out.filter(F.col(state).isNotNull())


def working_state_series(points: DataFrame, start, end, interval: str = "1 minute", nulls: str = "skip",
                         ts: str = "time", tie=(), state: str = "state") -> DataFrame:
    """Last state per bucket over all sources."""
    rolled = last_value_by(between(points, ts, start, end), [ts, *tie], [state], ts=ts, interval=interval)
    return _series(rolled, interval, start, end, state, nulls)
