"""Time buckets, totals, last values, gap filling and positions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from lagscope.operators.filters import between
from lagscope.session import as_col, typed_time

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
MANAGER = "-1"  # fixed value: the id that log rows of the manager itself carry
_BLOCK = 10_000


def interval_seconds(interval: str) -> int:
    """Seconds of ``"5 minutes"``."""
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", interval)
    if not match or match.group(2) not in _UNITS:
        raise ValueError(f"not a fixed interval: {interval!r}")
    return int(match.group(1)) * _UNITS[match.group(2)]


def bucket(ts: Column | str, interval: str) -> Column:
    """Start of the epoch-aligned tumbling bucket; NULL without a time."""
    time = as_col(ts)
    some = F.coalesce(time, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))  # a window drops rows without a time
    return F.when(time.isNotNull(), F.window(some, interval)["start"])


def bucket_agg(df: DataFrame, ts: str, interval: str, aggs: dict[str, Column], by=(), name: str = "bucket") -> DataFrame:
    """Aggregates per bucket. Map-side combine leaves one row per task and bucket to shuffle,
    so a bucket that holds a third of the rows is no larger in the shuffle than any other."""
    grouped = df.groupBy(*by, F.window(F.col(ts), interval).alias("_w"))
    out = grouped.agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(*by, F.col("_w.start").alias(name), *aggs)


def bucket_sum(df: DataFrame, ts: str, col: str, interval: str, by=(), alias: str | None = None) -> DataFrame:
    return bucket_agg(df, ts, interval, {alias or f"sum_{col}": F.sum(col)}, by)


def bucket_max(df: DataFrame, ts: str, col: str, interval: str, by=(), alias: str | None = None) -> DataFrame:
    return bucket_agg(df, ts, interval, {alias or f"max_{col}": F.max(col)}, by)


def exceptions_per_minute(df: DataFrame, ts: str = "GMT_MODIFIED", id_col: str = "ID",
                          source_col: str = "PIPELINE_ID", source: str = MANAGER) -> DataFrame:
    """Exceptions of one source per minute."""
    rows = df.filter(F.col(source_col).cast("string") == source)
    return bucket_agg(rows, ts, "1 minute", {"exceptions": F.count(id_col)})


def change_totals(df: DataFrame, begin, end, ts: str = "GMT_MODIFIED", by: str = "PIPELINE_ID",
                  counts=("INSERT_COUNT", "UPDATE_COUNT", "DELETE_COUNT")) -> DataFrame:
    """Summed change counts per source in a closed interval; a NULL source is its own group."""
    return between(df, ts, begin, end).groupBy(by).agg(*[F.sum(c).alias(c) for c in counts])


def has_exception(df: DataFrame, begin, end, ts: str = "GMT_MODIFIED",
                  source_col: str = "PIPELINE_ID", source: str = MANAGER) -> DataFrame:
    """One row ``count = 1`` if the interval holds an exception of the source, else no row."""
    rows = between(df, ts, begin, end).filter(F.col(source_col).cast("string") == source)
    return rows.limit(1).select(F.lit(1).alias("count"))


def next_watermark(df: DataFrame, col: str, last) -> DataFrame:
    """The new position: the largest value seen, never before ``last``."""
    kind = df.schema[col].dataType
    floor = typed_time(df, col, last) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.lit(last).cast(kind)
    return df.agg(F.greatest(floor, F.max(col)).alias("position"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def last_value_by(df: DataFrame, order_by, cols, by=(), ts: str | None = None,
                  interval: str | None = None, alias: dict[str, str] | None = None) -> DataFrame:
    """Last non-NULL value of each column in the order of ``order_by`` (time, then a tie break).

    Overall, per ``by``, per time bucket, or per both. Each column ignores its own NULLs, in one
    pass, and ``max_by`` combines on the map side.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    alias = alias or {}
    order = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    aggs = {
        alias.get(c, c): F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order))
        for c in cols
    }
    if interval:
        return bucket_agg(df, ts or order_by[0], interval, aggs, by)
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(*[a.alias(n) for n, a in aggs.items()])


def explode_range(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """One row per whole number from ``low`` to ``high``.

    Two explodes, so that no row ever holds an array longer than one block.
    """
    starts = F.sequence(F.col(low), F.col(high), F.lit(_BLOCK).cast("long"))
    blocks = df.withColumn("_block", F.explode(starts))
    upto = F.least(F.col("_block") + (_BLOCK - 1), F.col(high))
    return blocks.withColumn(name, F.explode(F.sequence(F.col("_block"), upto))).drop("_block")


def _bucket_starts(start, end, seconds: int) -> tuple[datetime, int]:
    epoch = datetime(1970, 1, 1)
    low = datetime.fromisoformat(start) if isinstance(start, str) else start
    high = datetime.fromisoformat(end) if isinstance(end, str) else end
    first = (low - epoch) // timedelta(seconds=seconds)
    last = (high - epoch) // timedelta(seconds=seconds)
    return epoch + timedelta(seconds=first * seconds), max(0, last - first + 1)


def fill_gaps(df: DataFrame, bucket_col: str, interval: str, start, end, by=()) -> DataFrame:
    """Every bucket between ``start`` and ``end`` (both included), NULLs where nothing was seen.

    ``df`` has one row per bucket. With ``by`` every series that has a bucket in the range gets all
    of them: each row is spread over the buckets up to the next row of its series, so ``df`` is
    read once and nothing is joined. Without ``by`` the calendar is a distributed range of numbers
    joined with the buckets; both sides are unique per bucket.
    """
    seconds = interval_seconds(interval)
    first, n = _bucket_starts(start, end, seconds)
    origin = F.lit(first.isoformat(sep=" ")).cast(df.schema[bucket_col].dataType.typeName())

    def at(number: Column) -> Column:
        step = (number * F.lit(seconds)).cast("decimal(18,6)")
        return origin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), step)

    values = [c for c in df.columns if c not in (*by, bucket_col)]
    if not by:
        calendar = df.sparkSession.range(n).select(at(F.col("id")).alias("_at"))
        joined = calendar.join(df, F.col("_at") == F.col(bucket_col), "left")
        return joined.select(F.col("_at").alias(bucket_col), *values)

    gap = (F.col(bucket_col) - origin).cast(T.DayTimeIntervalType(3, 3)).cast("decimal(18,6)")
    rows = df.withColumn("_n", F.floor(gap / F.lit(seconds)).cast("long")).filter(F.col("_n").between(0, n - 1))
    series = Window.partitionBy(*by).orderBy("_n")
    spread = rows.withColumns({
        "_from": F.when(F.row_number().over(series) == 1, F.lit(0).cast("long")).otherwise(F.col("_n")),
        "_to": F.lead("_n", 1, n).over(series) - 1,
    })
    return explode_range(spread, "_from", "_to", "_i").select(
        *by, at(F.col("_i")).alias(bucket_col), *[F.when(F.col("_i") == F.col("_n"), F.col(c)).alias(c) for c in values]
    )


def null_mode(df: DataFrame, cols, mode: str = "keep") -> DataFrame:
    """How a panel shows empty buckets: ``zero``, ``skip`` (connect the points) or ``keep``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    if mode == "zero":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols})
    if mode == "skip":
        return df.dropna(how="all", subset=cols)
    if mode == "keep":
        return df
    raise ValueError(f"unknown mode {mode!r}")


def order_by_time(df: DataFrame, ts: str, *tie: str) -> DataFrame:
    """Points in ascending time; the tie columns make the order total."""
    return df.orderBy(ts, *tie)


def flatten_kv(df: DataFrame, key: str, value: str, names, by=()) -> DataFrame:
    """Key/value rows to one wide record per ``by``: declared keys only, missing ones NULL."""
    grouped = df.filter(F.col(key).isin(list(names))).groupBy(*by) if by else df.filter(F.col(key).isin(list(names))).groupBy()
    return grouped.agg(*[F.max(F.when(F.col(key) == n, F.col(value))).alias(n) for n in names])


def duplicate_identity(df: DataFrame, id_col: str, node_col: str) -> DataFrame:
    """Identities shared by several nodes: count, first and last node.

    Two aggregations of combining counts; a shared identity never becomes one large array. Use
    ``identity_members`` for the full list, one row per node.
    """
    pairs = df.filter(F.col(id_col).isNotNull()).select(id_col, node_col).distinct()
    return (
        pairs.groupBy(id_col)
        .agg(F.count(node_col).alias("nodes"), F.min(node_col).alias("first_node"), F.max(node_col).alias("last_node"))
        .filter("nodes > 1")
    )


def identity_members(df: DataFrame, id_col: str, node_col: str) -> DataFrame:
    """One row per (identity, node) of every shared identity.

    An identity is shared if its least and greatest node differ, which takes no distinct pairs; those are only made of what is shared.
    """
    known = df.filter(F.col(id_col).isNotNull())
    ends = known.groupBy(id_col).agg(F.min(node_col).alias("_low"), F.max(node_col).alias("_high"))
    shared = ends.filter("_low <> _high").select(id_col)
    return known.select(id_col, node_col).join(shared, id_col, "left_semi").distinct()
