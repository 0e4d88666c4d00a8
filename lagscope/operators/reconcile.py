"""Comparison of two replicas.

Both sides are stacked and aggregated once. Compared with a full outer join this shuffles a key
and a few numbers instead of whole rows, combines on the map side, treats NULL keys as equal and
gives right answers for repeated keys, however often one of them occurs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column


def _stack(a: DataFrame, b: DataFrame, cols: list[Column]) -> DataFrame:
    left = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    return left.unionAll(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))


def reconcile_counts(a: DataFrame, b: DataFrame, by=()) -> DataFrame:
    """Row counts on both sides per ``by`` and their difference."""
    stacked = _stack(a, b, [F.col(c) for c in by])
    grouped = stacked.groupBy(*by) if by else stacked.groupBy()
    counts = grouped.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("count_a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("count_b")
    )
    return counts.withColumns({
        "diff": F.col("count_a") - F.col("count_b"),
        "same": F.col("count_a") == F.col("count_b"),
    })


def _alike(a: DataFrame, b: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides' columns in the wider type that Spark finds for their union."""
    for c in cols:
        one, two = a.schema[c].dataType, b.schema[c].dataType
        if isinstance(one, T.StringType) != isinstance(two, T.StringType):
            raise ValueError(f"column {c!r} is {one.simpleString()} on one side and {two.simpleString()} on the other")
    wide = a.select(*cols).unionAll(b.select(*cols)).schema
    return tuple(df.select(*[F.col(c).cast(wide[c].dataType).alias(c) for c in cols]) for df in (a, b))


def _hashable(col: Column, kind: T.DataType) -> Column:
    """A map as its entries in order, since a map has no hash."""
    return F.array_sort(F.map_entries(col)) if isinstance(kind, T.MapType) else col


def _digest(df: DataFrame, cols: list[str]) -> Column:
    """64 bits of a row's columns and of which of them are NULL."""
    parts = [_hashable(F.col(c), df.schema[c].dataType) for c in cols] + [F.col(c).isNull() for c in cols]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def reconcile_rows(a: DataFrame, b: DataFrame, keys, cols=None) -> DataFrame:
    """Keys that are missing on one side or hold other rows: ``only_a``, ``only_b``, ``differs``.

    Columns whose types differ, such as int and bigint or decimals of other scales, are compared in the wider type of both; a
    text column only compares with a text column.

    Rows are compared by a 64-bit hash of the non-key columns and their NULL flags, summed per key
    in two halves, so repeated keys compare as bags of rows.
    """
    keys = list(keys)
    cols = list(cols) if cols is not None else [c for c in a.columns if c not in keys]
    a, b = _alike(a, b, [*keys, *cols])
    stacked = _stack(a, b, [*[F.col(k) for k in keys], _digest(a, cols).alias("_h")])
    sign = F.col("_a") - F.col("_b")
    low = F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("_h", 32)
    grouped = stacked.groupBy(*keys).agg(
        F.sum("_a").alias("count_a"),
        F.sum("_b").alias("count_b"),
        F.sum(low * sign).alias("_low"),
        F.sum(high * sign).alias("_high"),
    )
    status = (
        F.when(F.col("count_b") == 0, F.lit("only_a"))
        .when(F.col("count_a") == 0, F.lit("only_b"))
        .when(reduce(lambda x, y: x | y, [F.col("count_a") != F.col("count_b"), F.col("_low") != 0, F.col("_high") != 0]),
              F.lit("differs"))
    )
    return grouped.withColumn("status", status).filter("status IS NOT NULL").select(*keys, "status")


@dataclass(frozen=True)
class Ranges:
    """Closed ranges of the leading key, in order and apart, and whether rows without that key are meant too."""

    spans: tuple[tuple[int, int], ...]
    nulls: bool = False

    def of(self, key: str) -> Column:
        """A filter of bare comparisons, so that a scan skips what lies between the ranges."""
        tests = [F.col(key).between(low, high) for low, high in self.spans] + ([F.col(key).isNull()] if self.nulls else [])
        return reduce(lambda x, y: x | y, tests, F.lit(False)) if tests else F.lit(False)

    @property
    def length(self) -> int:
        return sum(high - low + 1 for low, high in self.spans)


def _narrowed(spans: list[tuple[int, int]], most: int) -> tuple[tuple[int, int], ...]:
    """Neighbours become one; then the narrowest gaps are closed until ``most`` spans are left, which reads more but loses nothing."""
    joined: list[list[int]] = []
    for low, high in sorted(spans):
        if joined and low <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    gaps = sorted(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1], reverse=True)
    cuts = [0, *sorted(gaps[: most - 1]), len(joined)]
    return tuple((joined[i][0], joined[j - 1][1]) for i, j in zip(cuts, cuts[1:]) if i < j)


def _unlike_ranges(a: DataFrame, b: DataFrame, key: str, digest: Column, within: Ranges, width: int) -> tuple[list[tuple[int, int]], bool, int, int]:
    """One level of the tree: ranges of ``width`` keys whose digests differ, whether the NULLs' do, rows in those and rows read."""
    meant = within.of(key)
    stacked = _stack(a.filter(meant), b.filter(meant), [F.col(key).cast("long").alias("_k"), digest.alias("_h")])
    sign = F.col("_a") - F.col("_b")
    # Thirds of the hash: their sums stay within a long for 2^41 rows of one range.
    thirds = [F.shiftrightunsigned("_h", 22 * i).bitwiseAND(F.lit((1 << 22) - 1)) * sign for i in range(3)]
    sums = stacked.groupBy(F.expr(f"_k div {width}L").alias("_part")).agg(F.sum(sign).alias("_more"), F.count("*").alias("_rows"), *[F.sum(t).alias(f"_t{i}") for i, t in enumerate(thirds)])
    unlike = (F.col("_more") != 0) | (F.col("_t0") != 0) | (F.col("_t1") != 0) | (F.col("_t2") != 0)
    # At most one row per range, whose number the caller bounds.
    found = sums.select("_part", "_rows", unlike.alias("_unlike")).collect()
    # Division drops the fraction, so the part of zero reaches to both sides.
    parts = [r._part for r in found if r._unlike and r._part is not None]
    spans = [(p * width - (width - 1) * (p <= 0), p * width + (width - 1) * (p >= 0)) for p in parts]
    return spans, any(r._unlike and r._part is None for r in found), sum(r._rows for r in found if r._unlike), sum(r._rows for r in found)


def unlike_ranges(a: DataFrame, b: DataFrame, keys, cols=None, fanout: int = 4096, leaf_rows: int = 1_000_000, most: int = 256) -> Ranges:
    """Ranges of the leading key (a whole number) that hold all rows in which two replicas differ, by a tree of digests.

    A level cuts the ranges that are left into about ``fanout`` parts and compares one digest per part and side: only these numbers are
    shuffled, and only what differed one level above is read. It ends with ``leaf_rows`` rows or fewer in ranges that differ, with
    single keys, or when a level leaves more than half of what it read, since a further one would then cost more than it saves.
    ``most`` bounds the ranges of a level, so that the filter stays short.
    """
    keys = list(keys)
    cols = list(cols) if cols is not None else [c for c in a.columns if c not in keys]
    a, b = _alike(a, b, [*keys, *cols])
    key = keys[0]
    if not isinstance(a.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"the leading key {key!r} is not a whole number")
    ends = [df.agg(F.min(key), F.max(key)).first() for df in (a, b)]
    known = [e for e in ends if e[0] is not None]
    left = Ranges(((min(e[0] for e in known), max(e[1] for e in known)),) if known else (), True)
    digest = _digest(a, [*keys, *cols])
    while True:
        width = max(1, -(-left.length // max(fanout, 4)))
        spans, nulls, unlike, seen = _unlike_ranges(a, b, key, digest, left, width)
        held = [(max(low, l), min(high, h)) for low, high in spans for l, h in left.spans if low <= h and l <= high]
        left = Ranges(_narrowed(held, most), nulls)
        if not left.spans or width == 1 or unlike <= leaf_rows or 2 * unlike > seen:
            return left


def reconcile_ranges(a: DataFrame, b: DataFrame, keys, cols=None, fanout: int = 4096, leaf_rows: int = 1_000_000, most: int = 256) -> DataFrame:
    """The rows of ``reconcile_rows``, read only where ``unlike_ranges`` finds a difference: for replicas that mostly agree.

    Both sides must hold still meanwhile, as they are read once per level. Rows without the leading key are a range of their own.
    """
    keys = list(keys)
    left = unlike_ranges(a, b, keys, cols, fanout, leaf_rows, most)
    meant = left.of(keys[0])
    return reconcile_rows(a.filter(meant), b.filter(meant), keys, cols)
