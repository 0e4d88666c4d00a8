"""Change streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import CHANGES, ENVELOPE, STATS, check, changes, envelope, read, stats
from lagscope.operators import changes as ops
from lagscope.operators import gtid, rings
from lagscope.operators.partials import RollupSpec
from lagscope.schemas import CHANGE_KINDS
from lagscope.session import temporary_folder
from lagscope.sources import changes as change_source
from lagscope.streaming import changes as streams
from lagscope.streaming import rollups as kept


def _scratch(spark, name):
    return temporary_folder(spark, name)


def _log_files(spark, sf):
    """A folder with the events as JSON lines."""
    folder = _scratch(spark, "logs")
    envelope(spark, sf).write.text(folder)
    return folder


class _streaming:
    """Lets the shared table functions read a table as a stream."""

    def __init__(self, spark):
        self.read = self
        self._spark = spark

    def parquet(self, path):
        schema = self._spark.read.parquet(path).schema
        folder, name = path.rsplit("/", 1)
        return self._spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


@check("src3_read_changes", f"""SELECT kind, op, "table", count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, max(ts) AS last_ts FROM {CHANGES} GROUP BY 1, 2, 3""")
def src3(spark, sf):
    rows = changes(spark, sf)
    body = F.to_json(F.struct("kind", "op", "table", F.col("key").cast("string").alias("key"), "pos", "gtid", F.col("ts").cast("timestamp").alias("ts")),
                     {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    decoded = change_source.decode_changes(rows.select(body.alias("value")))
    return decoded.groupBy("kind", "op", "table").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))


@check("src3_changes_of_kind", f"SELECT pos, gtid FROM {CHANGES} WHERE kind = 'xid'")
def src3_kind(spark, sf):
    return change_source.of_kind(changes(spark, sf), "xid").select("pos", "gtid")


@check("joi4_drop_looped", f"""SELECT pos, gtid, op, key, value FROM {CHANGES} c WHERE "table" <> 'retl_mark'
 AND NOT EXISTS (SELECT 1 FROM {CHANGES} m WHERE m.gtid = c.gtid AND m."table" = 'retl_mark' AND m.channel_id = 1)""")
def joi4(spark, sf):
    return ops.drop_looped(changes(spark, sf), 1).select("pos", "gtid", "op", "key", "value")


@check("str8_transaction_summary", f"""SELECT gtid, count(*) FILTER (kind = 'row') AS changes, min(pos) AS first_pos, max(pos) AS last_pos, bool_or(kind = 'xid') AS closed FROM {CHANGES} GROUP BY 1""")
def str8_summary(spark, sf):
    return ops.transaction_summary(changes(spark, sf))


@check("str8_group_transactions", f"""SELECT gtid, cast(0 AS BIGINT) AS chunk, coalesce(string_agg(cast(pos AS VARCHAR) || op, ',' ORDER BY pos) FILTER (kind = 'row'), '') AS rows,
 count(*) FILTER (kind = 'row') AS changes, bool_or(kind = 'xid') AS closed FROM {CHANGES} GROUP BY 1""")
def str8(spark, sf):
    out = ops.group_transactions(changes(spark, sf), ["pos", "op"])
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["pos"].cast("string"), r["op"])), ",")
    return out.select("gtid", "chunk", text.alias("rows"), "changes", "closed")


@check("str8_large_transactions", f"""SELECT op, (seq - 1) // 1000 AS chunk, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM
 (SELECT op, pos, row_number() OVER (PARTITION BY op ORDER BY pos) AS seq FROM {CHANGES} WHERE kind = 'row') GROUP BY 1, 2""")
def str8_large(spark, sf):
    """A few transactions that hold most of the rows come out in bounded chunks."""
    out = ops.group_transactions(changes(spark, sf), ["pos"], txn="op", chunk_rows=1000)
    return out.select("op", "chunk", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0))["pos"].alias("first_pos"),
                      F.element_at("rows", -1)["pos"].alias("last_pos"))


@check("str8_stream_transactions", f"""SELECT gtid, count(*) FILTER (kind = 'row') AS changes, min(pos) AS first_pos, max(pos) AS last_pos, true AS closed
 FROM {CHANGES} GROUP BY 1 HAVING bool_or(kind = 'xid')""")
def str8_stream(spark, sf):
    folder = _scratch(spark, "transactions")
    query = streams.stream_transactions(changes(_streaming(spark), sf), folder, available_now=True)
    query.awaitTermination()
    return streams.finished_transactions(spark, folder).drop("file")


_BASE = "(SELECT c_custkey AS key, c_acctbal AS value FROM customer)"
_LAST = f"(SELECT key, arg_max(op, pos) AS op, arg_max(value, pos) AS value FROM {CHANGES} WHERE kind = 'row' GROUP BY key)"


@check("str9_apply_changes", f"""SELECT key, value FROM {_BASE} WHERE key NOT IN (SELECT key FROM {_LAST}) UNION ALL SELECT key, value FROM {_LAST} WHERE op <> 'D'""")
def str9(spark, sf):
    base = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    rows = change_source.of_kind(changes(spark, sf), "row").select("key", "value", "op", "pos")
    return ops.apply_changes(base, rows, ["key"], "pos")


@check("str9_stream_table", f"SELECT key, value FROM {_LAST} WHERE op <> 'D'")
def str9_stream(spark, sf):
    folder = _scratch(spark, "table")
    rows = changes(_streaming(spark), sf).filter("kind = 'row'").select("key", "value", "op", "pos")
    streams.stream_table(rows, folder, ["key"], "pos", available_now=True).awaitTermination()
    streams.compact_table(spark, folder, ["key"], "pos")
    return streams.current_table(spark, folder, ["key"], "pos")


@check("str10_change_stats", f"""SELECT key, date_trunc('day', ts) AS bucket, count(*) FILTER (op = 'I') AS insert_count, count(*) FILTER (op = 'U') AS update_count,
 count(*) FILTER (op = 'D') AS delete_count, min(ts) AS start_time, max(ts) AS end_time FROM {CHANGES} GROUP BY 1, 2""")
def str10(spark, sf):
    return ops.change_stats(changes(spark, sf), ["key"], "1 day")


@check("src3_read_log_files", f"""SELECT kind, file, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, cast(0 AS BIGINT) AS torn FROM {ENVELOPE} GROUP BY 1, 2
 UNION ALL SELECT NULL, NULL, count(*), NULL, NULL, cast(sum(event_id) AS BIGINT) FROM events WHERE event_id % 97 = 4""")
def src3_files(spark, sf):
    """Files of events, the torn lines among them counted as rejects."""
    events = change_source.read_changes(spark, _log_files(spark, sf), streaming=False)
    number = F.coalesce(F.regexp_extract("reject", "([0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    return events.groupBy("kind", "file").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum(number).alias("torn"))


@check("joi4_drop_looped_log_files", f"""SELECT file, pos, gtid FROM {ENVELOPE} c WHERE NOT mark AND NOT EXISTS
 (SELECT 1 FROM {ENVELOPE} m WHERE m.gtid = c.gtid AND m.mark AND m.channel = 1)""")
def joi4_files(spark, sf):
    events = change_source.read_changes(spark, _log_files(spark, sf), streaming=False).filter("reject IS NULL")
    return ops.drop_looped(events, 1).select("file", "pos", "gtid")


_ACCOUNT = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType())])
_STEPS = f"""(SELECT n, 'D' AS op, key AS id, NULL AS value FROM {ENVELOPE} WHERE kind = 'row' AND (op = 'D' OR moved <> key)
 UNION ALL SELECT n, op, moved, value FROM {ENVELOPE} WHERE kind = 'row' AND op <> 'D')"""
_END = f"(SELECT id, op, value FROM {_STEPS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)"


@check("str9_apply_log_files", f"""SELECT id, value FROM (SELECT c_custkey AS id, c_acctbal AS value FROM customer) WHERE id NOT IN (SELECT id FROM {_END})
 UNION ALL SELECT id, value FROM {_END} WHERE op <> 'D'""")
def str9_files(spark, sf):
    events = change_source.read_changes(spark, _log_files(spark, sf), streaming=False)
    base = read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").alias("value"))
    return ops.apply_changes(base, ops.rows_of(events, _ACCOUNT, ["id"], ("op", "log", "pos")), ["id"], ["log", "pos"])


@check("str9_stream_log_files", f"SELECT id, value FROM {_END} WHERE op <> 'D'")
def str9_stream_files(spark, sf):
    folder, order = _scratch(spark, "table"), ["log", "pos"]
    rows = ops.rows_of(change_source.read_changes(spark, _log_files(spark, sf)), _ACCOUNT, ["id"], ("op", "log", "pos"))
    streams.stream_table(rows, folder, ["id"], order, available_now=True).awaitTermination()
    streams.compact_table(spark, folder, ["id"], order)
    return streams.current_table(spark, folder, ["id"], order)


@check("str8_stream_log_files", f"""SELECT gtid, max(file) AS file, count(*) FILTER (kind = 'row') AS changes, min(pos) AS first_pos, max(pos) AS last_pos, true AS closed
 FROM {ENVELOPE} GROUP BY 1 HAVING bool_or(kind = 'xid')""")
def str8_stream_files(spark, sf):
    folder = _scratch(spark, "transactions")
    streams.stream_transactions(change_source.read_changes(spark, _log_files(spark, sf)), folder, available_now=True).awaitTermination()
    return streams.finished_transactions(spark, folder)


_KINDS = ", ".join(f"'{k}'" for k in CHANGE_KINDS)


@check("udf3_handle_changes", f"SELECT list_extract([{_KINDS}], cast(event_id % 7 + 1 AS BIGINT)) AS kind, count(*) AS n, max(event_id) AS last_pos FROM events GROUP BY 1")
def udf3(spark, sf):
    """Each kind's own function gets that kind's events."""
    folder = _scratch(spark, "handled")

    def save(kind):
        return lambda batch, number: batch.select("kind", "pos").write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")

    events = changes(_streaming(spark), sf).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in CHANGE_KINDS]), (F.col("pos") % 7 + 1).cast("int")))
    streams.handle_changes(events, {k: save(k) for k in CHANGE_KINDS}, f"{folder}/checkpoint", available_now=True).awaitTermination()
    seen = spark.read.schema("kind string, pos long").option("recursiveFileLookup", "true").parquet(*[f"{folder}/{k}" for k in CHANGE_KINDS])
    return seen.groupBy("kind").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


# Transaction ids of three sources, and a replica that lacks runs of them and has some of its own.
_GTIDS = "(SELECT concat('SRC-', cast(event_id % 3 AS VARCHAR(9))) AS source, event_id // 3 + 1 AS n, event_id FROM events)"
_REPLICA = f"(SELECT * FROM {_GTIDS} WHERE (event_id // 40) % 7 <> 3 AND event_id % 101 <> 5)"


def _gtids(spark, sf, replica=False):
    n = F.col("event_id")
    rows = read(spark, sf, "events").select(F.concat(F.lit("SRC-"), (n % 3).cast("string"), F.lit(":"), (F.floor(n / 3) + 1).cast("string")).alias("gtid"), "event_id")
    return rows.filter((F.floor(n / 40) % 7 != 3) & (n % 101 != 5)) if replica else rows


def _islands_sql(numbers):
    return f"""SELECT lower(source) AS source, min(n) AS first, max(n) AS last FROM (SELECT source, n, n - row_number() OVER (PARTITION BY source ORDER BY n) AS g
 FROM (SELECT DISTINCT source, n FROM {numbers})) GROUP BY source, g"""


@check("agg3_gtid_executed", _islands_sql(_REPLICA))
def gtid_executed(spark, sf):
    """The executed set of a replica, printed as text and read back; a row of text holds the intervals that begin in a million numbers."""
    parts = gtid.executed_intervals(_gtids(spark, sf, replica=True)).withColumn("part", F.floor(F.col("first") / 1_000_000))
    return gtid.gtid_intervals(gtid.gtid_text(parts, ["part"]), keys=["part"]).filter("reject IS NULL").drop("part", "reject")


@check("str8_gtid_missing", _islands_sql(f"(SELECT source, n FROM {_GTIDS} EXCEPT SELECT source, n FROM {_REPLICA})"))
def gtid_missing(spark, sf):
    """The transactions that the replica lacks."""
    return gtid.subtract_intervals(gtid.executed_intervals(_gtids(spark, sf)), gtid.executed_intervals(_gtids(spark, sf, replica=True)))


@check("src3_gtid_contained", f"""SELECT a.server, a.lacking = 0 AS contained, a.lacking AS missing FROM (SELECT event_type AS server,
 count(*) FILTER (WHERE event_id NOT IN (SELECT event_id FROM {_REPLICA})) AS lacking FROM events GROUP BY 1) a""")
def gtid_contained(spark, sf):
    """Per server, whether the replica has everything that the server executed."""
    kinds = read(spark, sf, "events").select("event_id", F.col("event_type").alias("server"))
    own = gtid.executed_intervals(_gtids(spark, sf).join(kinds, "event_id"), keys=["server"])
    replica = gtid.executed_intervals(_gtids(spark, sf, replica=True).join(kinds, "event_id"), keys=["server"])
    return gtid.contains_intervals(replica, own, by=["server"])


_CHANNELS = "(SELECT DISTINCT s_nationkey AS source, (s_nationkey * 3 + s_suppkey % 4) % 25 AS target FROM supplier WHERE s_suppkey % 3 = 0)"


@check("joi4_channels_in_rings", f"""WITH RECURSIVE e AS (SELECT source AS u, target AS v FROM {_CHANNELS} WHERE source <> target),
w AS (SELECT u, v, v AS node, 1 AS length FROM e UNION SELECT w.u, w.v, e.v, w.length + 1 FROM w JOIN e ON e.u = w.node
 WHERE NOT (w.node = w.v AND e.v = w.u) AND w.length < 25 AND w.node <> w.u)
SELECT u AS source, v AS target, cast(min(length) AS BIGINT) AS ring FROM w WHERE node = u GROUP BY 1, 2""")
def channels_in_rings(spark, sf):
    """Channels between nations, made of the suppliers."""
    nation, n = F.col("s_nationkey").cast("long"), F.col("s_suppkey")
    channels = read(spark, sf, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("source"), ((nation * 3 + n % 4) % 25).alias("target"))
    return rings.channels_in_rings(channels.select("source", F.col("target").cast(channels.schema["target"].dataType)))


_SPEC = RollupSpec("GMT_MODIFIED", "1 minute", sums=("SIZE",), maxes=("DELAY_TIME",), lasts=("INSERT_COUNT",), tie=("ID",), by=("TYPE",))


def _rollup(spark, sf, spec):
    """The events as a stream of points, rolled up per minute and folded once."""
    folder = _scratch(spark, "rollup")
    kept.stream_rollup(stats(_streaming(spark), sf), spec, folder, available_now=True).awaitTermination()
    kept.fold_rollup(spark, spec, folder)
    return folder


@check("agg5_kept_rollup", f"""SELECT type, date_trunc('hour', gmt_modified) AS bucket, count(*) AS points, cast(sum(size) AS BIGINT) AS sum_size,
 max(delay_time) AS max_delay_time, cast(arg_max(insert_count, (gmt_modified, id)) AS BIGINT) AS last_insert_count FROM {STATS} GROUP BY 1, 2""")
def agg5_kept(spark, sf):
    rows = kept.kept_rollup(spark, _SPEC, _rollup(spark, sf, _SPEC), "1 hour")
    return rows.toDF(*[c.lower() for c in rows.columns])


@check("str5_panel_from_rollup", f"""SELECT c.bucket, s.points, s.sum_size FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS bucket) c
 LEFT JOIN (SELECT date_trunc('hour', gmt_modified) AS bucket, count(*) AS points, cast(sum(size) AS BIGINT) AS sum_size FROM {STATS} GROUP BY 1) s USING (bucket)""")
def str5_panel(spark, sf):
    spec = RollupSpec("GMT_MODIFIED", "1 minute", sums=("SIZE",))
    rows = kept.panel(spark, spec, _rollup(spark, sf, spec), "2024-01-01 00:00:00", "2024-01-30 23:59:59", 700)
    return rows.toDF(*[c.lower() for c in rows.columns])
