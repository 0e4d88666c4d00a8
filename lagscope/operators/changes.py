"""Change streams as tables: transactions, loop removal, materialised tables, change counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagscope.operators.ordered import number_by_position
from lagscope.operators.rollups import bucket_agg, explode_range
from lagscope.sources.changes import log_number

INSERT, UPDATE, DELETE = "I", "U", "D"
MARK_SCHEMA = "retl"  # fixed value: the schema of that table
MARK_TABLE = "retl_mark"  # fixed value: the table whose rows mark a synchronised transaction


def transaction_summary(changes: DataFrame, txn: str = "gtid", pos: str = "pos", kind: str = "kind") -> DataFrame:
    """One row per transaction: changes, first and last position, and whether its end was seen.

    With ``file`` in an envelope also the log file; a transaction never spans two.
    """
    file = [F.max("file").alias("file")] if "file" in changes.columns else []
    return changes.filter(F.col(txn).isNotNull()).groupBy(txn).agg(
        *file,
        F.count_if(F.col(kind) == "row").alias("changes"),
        F.min(pos).alias("first_pos"),
        F.max(pos).alias("last_pos"),
        F.coalesce(F.max(F.col(kind) == "xid"), F.lit(False)).alias("closed"),
    )


def transaction_rows(changes: DataFrame, txn: str = "gtid", pos: str = "pos", kind: str = "kind",
                     name: str = "seq") -> DataFrame:
    """Row changes with their 1-based place in the transaction; a huge transaction is spread."""
    rows = changes.filter((F.col(kind) == "row") & F.col(txn).isNotNull())
    return number_by_position(rows, pos, [txn], name, by_has_nulls=False)


def group_transactions(changes: DataFrame, cols=None, txn: str = "gtid", pos: str = "pos",
                       kind: str = "kind", chunk_rows: int = 10_000) -> DataFrame:
    """Transactions with their changes in order, as arrays of at most ``chunk_rows``.

    A transaction of usual size is one row with ``chunk`` 0. A larger one continues in chunks 1,
    2, …, so no task ever holds more than one chunk; nothing is dropped.
    """
    cols = list(cols) if cols is not None else [c for c in changes.columns if c not in (txn, kind, "file", "reject")]
    cols = [pos, *[c for c in cols if c != pos]]
    rows = transaction_rows(changes, txn, pos, kind, "_seq")
    rows = rows.withColumn("chunk", F.floor((F.col("_seq") - 1) / chunk_rows).cast("long"))
    item = F.struct(F.col("_seq").alias("seq"), *[F.col(c) for c in cols])

    items = F.collect_list(item)
    if any("map<" in changes.schema[c].dataType.simpleString() for c in cols):  # maps have no order of their own
        items = F.array_sort(items, lambda x, y: (x["seq"] - y["seq"]).cast("int"))
    else:
        items = F.sort_array(items)
    chunks = rows.groupBy(txn, "chunk").agg(items.alias("rows"))
    # The summary is spread over the chunks, so the chunks stay where they are.
    last = F.greatest(F.ceil(F.col("changes") / chunk_rows) - 1, F.lit(0)).cast("long")
    summary = transaction_summary(changes, txn, pos, kind).withColumns({"_zero": F.lit(0).cast("long"), "_last": last})
    parts = explode_range(summary, "_zero", "_last", "chunk").drop("_zero", "_last")
    # A transaction without row changes keeps its summary and has no rows.
    joined = parts.join(chunks, [txn, "chunk"], "left")
    rest = [c for c in summary.columns if c not in (txn, "_zero", "_last")]
    empty = F.array().cast(chunks.schema["rows"].dataType)
    return joined.select(txn, "chunk", F.coalesce("rows", empty).alias("rows"), *rest)


def drop_looped(changes: DataFrame, channel_id, txn: str = "gtid", table: str = "table",
                mark_table: str = MARK_TABLE, channel_col: str = "channel_id") -> DataFrame:
    """Changes to apply on this channel.

    A transaction that carries this channel's mark came from here and is left out. One with
    another channel's mark is kept without its mark rows; one without a mark is kept whole. In an
    envelope with schemas a mark is a row of the mark schema, and its channel is read from the row. A
    transaction of any size only meets its own key once: AQE splits it on the changes' side.
    """
    is_mark = F.col(table) == mark_table
    if "schema" in changes.columns:
        is_mark = is_mark & (F.col("schema") == MARK_SCHEMA)
    channel = F.col(channel_col) if channel_col in changes.columns else F.coalesce(F.col("after")[channel_col], F.col("before")[channel_col])
    own = changes.filter(is_mark & (channel == F.lit(channel_id).cast(changes.select(channel.alias("c")).schema["c"].dataType))).select(txn).distinct()
    return changes.filter(~F.coalesce(is_mark, F.lit(False))).join(own, txn, "left_anti").select(*changes.columns)


def rows_of(changes: DataFrame, schema: T.StructType, keys, extra=("op", "pos", "gtid", "ts")) -> DataFrame:
    """Row events of an envelope as typed columns; a deleted row keeps its key from ``before``.

    An update that changes the key is two rows: a delete of the old key, then the update of the new one. ``log`` in ``extra``
    is the number of the log file: with it, order by ``["log", "pos"]`` wherever changes come from more than one file.
    """
    if "log" in extra and "log" not in changes.columns:
        changes = changes.withColumn("log", log_number("file"))

    def image(gone: bool) -> list:
        side = F.col("before") if gone else F.col("after")
        return [(side[f.name] if f.name in keys or not gone else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields]

    others = [F.col(c) for c in extra if c != "op"]
    old = F.struct(F.lit(DELETE).alias("op"), *others, *image(True))
    new = F.struct(F.col("op"), *others, *image(False))
    moved = F.lit(False)
    for k in keys:
        moved = moved | ~F.col("before")[k].eqNullSafe(F.col("after")[k])
    known = F.col("before").isNotNull()
    for k in keys:
        known = known & F.col("before")[k].isNotNull()
    moved = (F.col("op") == UPDATE) & known & moved
    events = F.when(F.col("op") == DELETE, F.array(old)).when(moved, F.array(old, new)).otherwise(F.array(new))
    rows = changes.filter(F.col("kind") == "row").select(F.explode(events).alias("_e"))
    return rows.select(*[F.col(f"_e.{c}") for c in extra], *[F.col(f"_e.{f.name}") for f in schema.fields])


def latest_changes(changes: DataFrame, keys, order, op: str = "op") -> DataFrame:
    """The last change of every key; combined on the map side, so a hot key costs nothing extra."""
    order = [order] if isinstance(order, str) else list(order)
    keys = list(keys)
    rest = [c for c in changes.columns if c not in keys]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_last"))
    return last.select(*keys, "_last.*")


def apply_changes(base: DataFrame, changes: DataFrame, keys, order, op: str = "op") -> DataFrame:
    """The table after the changes: the last change per key wins, a delete removes the row.

    Only the last change per key meets ``base``. If those fit the broadcast limit, ``base`` is
    not shuffled at all; the keys to take out of it are aggregated alone, without the rows.
    """
    keys = list(keys)
    last = latest_changes(changes, keys, order, op)
    kept = base.join(last.select(*keys), keys, "left_anti").select(*base.columns)
    return kept.unionByName(last.filter(F.col(op) != DELETE).select(*base.columns))


def change_stats(changes: DataFrame, by, interval: str, ts: str = "ts", op: str = "op") -> DataFrame:
    """Insert, update and delete counts with first and last time, per ``by`` and bucket."""
    return bucket_agg(
        changes,
        ts,
        interval,
        {
            "insert_count": F.count_if(F.col(op) == INSERT),
            "update_count": F.count_if(F.col(op) == UPDATE),
            "delete_count": F.count_if(F.col(op) == DELETE),
            "start_time": F.min(ts),
            "end_time": F.max(ts),
        },
        list(by),
    )
