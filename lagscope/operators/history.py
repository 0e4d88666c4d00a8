"""History of a table that is updated in place: snapshots as validity intervals, and the table as of any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagscope.session import typed_time


def validity_intervals(snapshots: DataFrame, keys, at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The rows of all snapshots, each once per stretch of consecutive snapshots that have it unchanged.

    ``at`` is the snapshot's time. A row holds from the first snapshot of its stretch to the first one that has it no longer, changed
    or deleted; ``end`` is NULL while the latest snapshot has it. A snapshot without any row leaves no trace. NULL keys and
    values are equal to themselves; rows that repeat inside a snapshot are one.
    """
    times = Window.orderBy(at)  # one row per snapshot
    known = snapshots.select(at).distinct().filter(F.col(at).isNotNull())
    calendar = known.select(F.col(at).alias("_at"), F.row_number().over(times).alias("_no"), F.lead(at).over(times).alias("_next"))
    columns = [c for c in snapshots.columns if c != at]
    keys = list(keys)
    rows = snapshots.distinct().join(calendar, F.col(at) == F.col("_at")).drop("_at")
    place = F.row_number().over(Window.partitionBy(*columns).orderBy("_no"))
    stretches = rows.withColumn("_stretch", F.col("_no") - place)
    out = stretches.groupBy(*columns, "_stretch").agg(F.min(at).alias(start), F.max_by("_next", "_no").alias(end))
    return out.select(*keys, *[c for c in columns if c not in keys], start, end)


def as_of(intervals: DataFrame, time, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The table as the latest snapshot up to ``time`` had it."""
    moment = typed_time(intervals, start, time)
    return intervals.filter((F.col(start) <= moment) & (F.col(end).isNull() | (F.col(end) > moment))).drop(start, end)


def deleted_rows(intervals: DataFrame, keys, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Stretches that ended without a successor of the same key: rows that were deleted, not changed."""
    keys = list(keys)
    begun = intervals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(start).alias("_begun")).distinct()
    same = F.col(end) == F.col("_begun")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return intervals.filter(F.col(end).isNotNull()).join(begun, same, "left_anti")
