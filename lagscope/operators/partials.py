"""Partial rollups: sums, maxima and last values per bucket that merge into coarser buckets without the points."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.operators.rollups import bucket, interval_seconds

# The bucket lengths in seconds that a dashboard steps through.
STEPS = [1, 2, 5, 10, 15, 20, 30, 60, 120, 300, 600, 900, 1200, 1800, 3600, 7200, 10800, 21600, 43200, 86400, 604800, 2592000, 31536000]
# A day starts at one day, a week at a week, 30 days at three weeks and a year at six weeks; other steps start half-way from the one before.
_LONG = {86400: 86400, 604800: 604800, 2592000: 1814400, 31536000: 3628800}
_STARTS = [_LONG.get(high, (low + high) / 2) for low, high in zip(STEPS, STEPS[1:])]


def choose_interval(start, end, points: int, least: str = "1 second") -> str:
    """The bucket length for a panel of about ``points`` points: the range over the points, at the nearest step, no shorter than ``least``
    and a multiple of it, so that buckets of ``least`` merge into it."""
    low, high = (datetime.fromisoformat(t) if isinstance(t, str) else t for t in (start, end))
    if points < 1:
        raise ValueError("a panel has at least one point")
    step = STEPS[bisect_right(_STARTS, (high - low).total_seconds() / points)]
    floor = interval_seconds(least)
    if step < floor:
        step = floor
    return f"{-(-step // floor) * floor} seconds"


@dataclass(frozen=True)
class RollupSpec:
    """What a rollup keeps of its points: per ``by`` and bucket of ``interval``, sums, maxima and last values in the order of ``time`` and ``tie``."""

    time: str
    interval: str = "1 minute"
    sums: tuple[str, ...] = ()
    maxes: tuple[str, ...] = ()
    lasts: tuple[str, ...] = ()
    tie: tuple[str, ...] = ()
    by: tuple[str, ...] = ()

    @property
    def values(self) -> list[str]:
        return ["points", *[f"sum_{c}" for c in self.sums], *[f"max_{c}" for c in self.maxes], *[f"last_{c}" for c in self.lasts]]


def partials(points: DataFrame, spec: RollupSpec) -> DataFrame:
    """One row per ``by`` and bucket. ``at_c`` says where ``last_c`` was seen. Points without a time share the bucket NULL.

    Everything combines on the map side, so a bucket with a third of the points is no larger in the shuffle than any other.
    """
    order = F.struct(spec.time, *spec.tie)
    seen = {c: F.when(F.col(c).isNotNull(), order) for c in spec.lasts}
    return points.groupBy(*spec.by, bucket(spec.time, spec.interval).alias("bucket")).agg(
        F.count("*").alias("points"),
        *[F.sum(c).alias(f"sum_{c}") for c in spec.sums],
        *[F.max(c).alias(f"max_{c}") for c in spec.maxes],
        *[F.max_by(F.col(c), seen[c]).alias(f"last_{c}") for c in spec.lasts],
        *[F.max(seen[c]).alias(f"at_{c}") for c in spec.lasts],
    )


def merge_partials(rows: DataFrame, spec: RollupSpec, interval: str | None = None) -> DataFrame:
    """Partial rows of the same or of shorter buckets as one row per bucket of ``interval``, again partial: minutes to hours, hours to days."""
    interval = interval or spec.interval
    if interval_seconds(interval) % interval_seconds(spec.interval):
        raise ValueError(f"{interval!r} is not a multiple of {spec.interval!r}")
    placed = rows.withColumn("bucket", bucket("bucket", interval))
    return placed.groupBy(*spec.by, "bucket").agg(
        F.sum("points").alias("points"),
        *[F.sum(f"sum_{c}").cast(rows.schema[f"sum_{c}"].dataType).alias(f"sum_{c}") for c in spec.sums],
        *[F.max(f"max_{c}").alias(f"max_{c}") for c in spec.maxes],
        *[F.max_by(f"last_{c}", f"at_{c}").alias(f"last_{c}") for c in spec.lasts],
        *[F.max(f"at_{c}").alias(f"at_{c}") for c in spec.lasts],
    )


def finished(rows: DataFrame, spec: RollupSpec) -> DataFrame:
    """Partial rows without what only merging needs."""
    return rows.select(*spec.by, "bucket", *spec.values)
