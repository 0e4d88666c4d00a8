"""Time functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from lagscope.session import as_col

# Unit texts of a duration and their length in milliseconds.
UNIT_MS = {
    "ns": "0.000001",
    "us": "0.001",
    "µs": "0.001",
    "μs": "0.001",
    "ms": "1",
    "s": "1000",
    "m": "60000",
    "h": "3600000",
}
_PART = r"(\d+\.?\d*|\.\d+)\s*(ns|us|µs|μs|ms|s|m|h)"


def parse_time(c: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp of a text in the session zone; NULL for other texts and the zero date."""
    return F.try_to_timestamp(as_col(c), F.lit(fmt))


def duration_ms(c: Column | str) -> Column:
    """Whole milliseconds of ``1.213 s`` or ``1m30s``; NULL for other texts."""
    col = as_col(c)
    whole = col.rlike(rf"^\s*[+-]?\s*({_PART}\s*)+$")

    def length(part: Column) -> Column:
        unit = F.regexp_extract(part, _PART, 2)
        factor = F.lit(None)
        for text, ms in UNIT_MS.items():
            factor = F.when(unit == text, F.lit(ms)).otherwise(factor)
        number = F.regexp_extract(part, _PART, 1).try_cast("decimal(18,9)")
        return (number * factor.cast("decimal(13,6)")).cast("decimal(38,9)")

    parts = F.regexp_extract_all(col, F.lit(_PART), F.lit(0))
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,9)"), lambda acc, p: (acc + length(p)).cast("decimal(38,9)"))
    ms = F.floor(total).cast("long")
    return F.when(whole, F.when(col.rlike(r"^\s*-"), -ms).otherwise(ms))


def epoch_ns(c: Column | str) -> Column:
    """Epoch nanoseconds; a timestamp without zone is read in the session zone."""
    return F.unix_micros(as_col(c).cast("timestamp")) * F.lit(1000)


def ns_to_s(c: Column | str) -> Column:
    return as_col(c) / F.lit(1000000000)


def compact_time(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyyMMddHHmmss")


def time_or(c: Column | str, now: Column) -> Column:
    """The time, or ``now`` where it is missing."""
    return F.coalesce(as_col(c), now)
