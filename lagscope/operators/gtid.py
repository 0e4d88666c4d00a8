"""Sets of transaction ids as tables of intervals: ``source:1-5:8,other:3`` is three rows (source, first, last).

A set may belong to keys (a server, a time), so one table holds the sets of all servers. Single transactions are intervals
of one. Every operation is a few aggregations and one ordered pass per key; no set is ever expanded into its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagscope.session import as_col

_SPAN = 1_000_000
# The pieces are matched possessively: else Java's regex recurses once per piece, and a source with some thousands of them overflows its stack.
_PART = r"^([^:,\s]+)((?::\d+(?:-\d+)?)++)$"


def gtid_intervals(df: DataFrame, text_col: str = "gtid_set", keys=()) -> DataFrame:
    """``keys`` with source, first, last and reject: the intervals of every set, merged, sources in lower case.

    A part that is not ``source:first-last:…`` with whole numbers from 1, first not after last, is a row with its text in ``reject`` and NULL
    elsewhere. A NULL or empty set has no rows.
    """
    keys = list(keys)
    part = F.explode(F.split(F.regexp_replace(as_col(text_col), r"\s+", ""), ",")).alias("_part")
    parts = df.select(*keys, part).filter("_part <> ''")
    pieces = F.split(F.expr(f"substring(regexp_extract(_part, r'{_PART}', 2), 2)"), ":")
    good = F.filter(F.transform(pieces, _interval), lambda i: F.coalesce((i["first"] >= 1) & (i["last"] >= i["first"]), F.lit(False)))
    # A part's text goes once to its reject, not to each of its pieces: a part of n pieces would be copied n times.
    read = parts.select(*keys, "_part", F.lower(F.regexp_extract("_part", _PART, 1)).alias("source"), F.size(pieces).alias("_n"), good.alias("_good"))
    merged = merge_intervals(read.select(*keys, "source", F.inline("_good")), [*keys, "source"])
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("source", "string"), ("first", "long"), ("last", "long"))]
    rejects = read.filter(F.size("_good") < F.col("_n")).select(*keys, *none, F.col("_part").alias("reject")).distinct()
    return merged.withColumn("reject", F.lit(None).cast("string")).unionByName(rejects)


def _interval(piece: Column) -> Column:
    """``first-last`` or ``first`` as a struct of both."""
    ends = F.split(piece, "-")
    return F.struct(ends[0].try_cast("long").alias("first"), F.coalesce(F.try_element_at(ends, F.lit(2)), ends[0]).try_cast("long").alias("last"))


def executed_intervals(changes: DataFrame, gtid: str = "gtid", keys=()) -> DataFrame:
    """The executed set as intervals, from one transaction id ``source:number`` per event. Rows without a readable one are left out."""
    number = F.regexp_extract(gtid, r":(\d+)$", 1).try_cast("long")
    rows = changes.select(*keys, F.lower(F.regexp_extract(gtid, r"^(.*):\d+$", 1)).alias("source"), number.alias("first"), number.alias("last"))
    return merge_intervals(rows.filter("first IS NOT NULL").distinct(), [*keys, "source"])


def merge_intervals(df: DataFrame, keys) -> DataFrame:
    """Disjoint intervals of each key, with gaps between them: overlapping and adjacent ones become one.

    Intervals are merged within slots of a million numbers before they meet per key, so a key that holds a third of
    all rows arrives as what its slots have left.
    """
    keys = list(keys)
    slots = df.withColumn("_slot", F.floor(F.col("first") / _SPAN))
    return _islands(_islands(slots, [*keys, "_slot"]).drop("_slot"), keys)


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("first", "last")
    reached = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.select(*keys, "first", "last", F.coalesce((F.col("first") > reached + 1).cast("int"), F.lit(1)).alias("_new"))
    numbered = starts.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def _swept(a: DataFrame, b: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Intervals on which ``keep`` holds of ``_a`` and ``_b``, the number of intervals of either side that cover them."""

    def edges(df: DataFrame, side: str) -> DataFrame:
        other = "_b" if side == "_a" else "_a"
        edge = F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("step")))).alias("_e")
        rows = df.select(*keys, edge)
        return rows.select(*keys, F.col("_e.at").alias("_at"), F.col("_e.step").alias(side), F.lit(0).alias(other)).select(*keys, "_at", "_a", "_b")

    points = edges(a, "_a").union(edges(b, "_b")).groupBy(*keys, "_at").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    by = Window.partitionBy(*keys).orderBy("_at")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    pieces = points.select(*keys, F.col("_at").alias("first"), (F.lead("_at").over(by) - 1).alias("last"), F.sum("_a").over(so_far).alias("_a"), F.sum("_b").over(so_far).alias("_b"))
    return _islands(pieces.filter(keep).select(*keys, "first", "last"), keys)


def subtract_intervals(a: DataFrame, b: DataFrame, keys=("source",)) -> DataFrame:
    """What is in ``a`` and not in ``b``: the transactions that a replica with the set ``b`` lacks."""
    return _swept(a, b, list(keys), (F.col("_a") > 0) & (F.col("_b") == 0))


def intersect_intervals(a: DataFrame, b: DataFrame, keys=("source",)) -> DataFrame:
    return _swept(a, b, list(keys), (F.col("_a") > 0) & (F.col("_b") > 0))


def union_intervals(a: DataFrame, b: DataFrame, keys=("source",)) -> DataFrame:
    keys = list(keys)
    return merge_intervals(a.select(*keys, "first", "last").union(b.select(*keys, "first", "last")), keys)


def contains_intervals(a: DataFrame, b: DataFrame, keys=("source",), by=()) -> DataFrame:
    """Per ``by`` (one row without): ``contained``, whether ``b``'s set lies in ``a``'s, and ``missing``, how many of its transactions do not.

    Both sides have all ``keys`` and ``by``; what ``b`` does not name has no row.
    """
    by = list(by)
    keys = [*by, *[k for k in keys if k not in by]]
    lacking = subtract_intervals(b, a, keys).groupBy(*by).agg(F.sum(F.col("last") - F.col("first") + 1).alias("missing"))
    if not by:
        return lacking.select((F.coalesce("missing", F.lit(0)) == 0).alias("contained"), F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))
    named = b.select(*by).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    found = named.join(lacking.select(*[F.col(k).alias(f"_{k}") for k in by], "missing"), same, "left")
    return found.select(*by, F.col("missing").isNull().alias("contained"), F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))


def gtid_text(intervals: DataFrame, keys=()) -> DataFrame:
    """``keys`` with ``gtid_set``: the sets as text, sources and intervals in order. For sets that fit a row, as servers print them;
    a larger one takes a further key, such as a range of ``first``, and is a row of text for each."""
    keys = list(keys)
    piece = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    sources = intervals.groupBy(*keys, "source").agg(F.array_sort(F.collect_list(F.struct("first", piece.alias("text")))).alias("_p"))
    named = sources.select(*keys, F.concat_ws(":", "source", F.array_join(F.transform("_p", lambda p: p["text"]), ":")).alias("_t"))
    return named.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_t")), ",").alias("gtid_set"))
