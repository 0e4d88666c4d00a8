"""Filters, aggregates, buckets, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import LOGS, STATS, check, logs, read, stat_sql, stat_table, stats
from lagscope.operators import filters, ordered, rollups
from lagscope.plans import dashboard, named
from lagscope.schemas import STAT_COLUMNS, STAT_TABLES, struct_of
from lagscope.session import temporary_folder
from lagscope.sources import stats as stat_sources

FROM, TO = "2024-01-05 00:00:00", "2024-01-25 12:00:00"
DAY1, DAY30 = "2024-01-01 00:00:00", "2024-01-30 23:59:59"


def _calendar(unit: str, start: str, end: str) -> str:
    return f"(SELECT unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 {unit})) AS bucket)"


@check("prd1_project", f"SELECT gmt_modified AS time, cast(pipeline_id AS VARCHAR) AS pipeline_id, delay_time, id FROM {STATS}")
def prd1(spark, sf):
    from lagscope.operators.points import project, stat_specs

    return project(stats(spark, sf), stat_specs()["DELAY_STAT"])


@check("prd2_newer_than", f"SELECT id, gmt_modified FROM {STATS} WHERE gmt_modified > TIMESTAMP '2024-01-15 00:00:00'")
def prd2(spark, sf):
    return filters.newer_than(stats(spark, sf), "GMT_MODIFIED", "2024-01-15 00:00:00").select(
        F.col("ID").alias("id"), F.col("GMT_MODIFIED").alias("gmt_modified"))


@check("prd3_after_id", f"SELECT id, type FROM {LOGS} WHERE id > 5000")
def prd3(spark, sf):
    return filters.after_id(logs(spark, sf), "ID", 5000).select(F.col("ID").alias("id"), F.col("TYPE").alias("type"))


@check("prd4_between", f"SELECT id, gmt_modified FROM {STATS} WHERE gmt_modified BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'")
def prd4(spark, sf):
    return filters.between(stats(spark, sf), "GMT_MODIFIED", FROM, TO).select(
        F.col("ID").alias("id"), F.col("GMT_MODIFIED").alias("gmt_modified"))


@check("prd10_time_range", f"SELECT id, gmt_modified FROM {STATS} WHERE gmt_modified BETWEEN TIMESTAMP '2024-01-28 23:00:00' AND TIMESTAMP '2024-01-29 23:00:00'")
def prd10(spark, sf):
    return filters.time_range(stats(spark, sf), "GMT_MODIFIED", "2024-01-29 23:00:00").select(
        F.col("ID").alias("id"), F.col("GMT_MODIFIED").alias("gmt_modified"))


@check("agg1_change_totals", f"""SELECT pipeline_id, cast(sum(insert_count) AS BIGINT) AS insert_count,
 cast(sum(update_count) AS BIGINT) AS update_count, cast(sum(delete_count) AS BIGINT) AS delete_count FROM {STATS}
 WHERE gmt_modified BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' GROUP BY pipeline_id""")
def agg1(spark, sf):
    out = rollups.change_totals(stats(spark, sf), FROM, TO)
    return out.select(*[F.col(c).alias(c.lower()) for c in out.columns])


@check("agg2_has_exception", f"""SELECT 1 AS count WHERE EXISTS (SELECT 1 FROM {LOGS} WHERE pipeline_id = '-1'
 AND gmt_modified BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}')""")
def agg2(spark, sf):
    return rollups.has_exception(logs(spark, sf), FROM, TO)


@check("prd5_manager_sentinel", f"SELECT id, gmt_modified FROM {LOGS} WHERE pipeline_id = '-1'")
def prd5(spark, sf):
    return logs(spark, sf).filter(F.col("PIPELINE_ID") == rollups.MANAGER).select(
        F.col("ID").alias("id"), F.col("GMT_MODIFIED").alias("gmt_modified"))


@check("agg3_next_watermark_time", f"SELECT greatest(TIMESTAMP '2024-01-15 00:00:00', max(gmt_modified)) AS position FROM {STATS} WHERE gmt_modified > TIMESTAMP '2024-01-15 00:00:00'")
def agg3_time(spark, sf):
    fresh = filters.newer_than(stats(spark, sf), "GMT_MODIFIED", "2024-01-15 00:00:00")
    return rollups.next_watermark(fresh, "GMT_MODIFIED", "2024-01-15 00:00:00")


@check("agg3_next_watermark_id", f"SELECT greatest(cast(5000 AS BIGINT), max(id)) AS position FROM {LOGS} WHERE id > 5000")
def agg3_id(spark, sf):
    return rollups.next_watermark(filters.after_id(logs(spark, sf), "ID", 5000), "ID", 5000)


@check("agg4_exceptions_per_minute", f"SELECT date_trunc('minute', gmt_modified) AS bucket, count(id) AS exceptions FROM {LOGS} WHERE pipeline_id = '-1' GROUP BY 1")
def agg4(spark, sf):
    return rollups.exceptions_per_minute(logs(spark, sf))


@check("agg5_bucket_sum", f"SELECT date_trunc('hour', gmt_modified) AS bucket, cast(sum(size) AS BIGINT) AS size FROM {STATS} GROUP BY 1")
def agg5(spark, sf):
    return rollups.bucket_sum(stats(spark, sf), "GMT_MODIFIED", "SIZE", "1 hour", alias="size")


@check("agg6_synced_rows", f"SELECT date_trunc('hour', gmt_modified) AS bucket, cast(sum(insert_count) AS BIGINT) AS insert_count FROM {STATS} GROUP BY 1")
def agg6(spark, sf):
    return rollups.bucket_sum(stats(spark, sf), "GMT_MODIFIED", "INSERT_COUNT", "1 hour", alias="insert_count")


@check("agg7_bucket_max", f"SELECT time_bucket(INTERVAL 15 MINUTE, gmt_modified) AS bucket, max(delay_time) AS max_delay_time FROM {STATS} GROUP BY 1")
def agg7(spark, sf):
    return rollups.bucket_max(stats(spark, sf), "GMT_MODIFIED", "DELAY_TIME", "15 minutes", alias="max_delay_time")


def _nullable(spark, sf):
    return stats(spark, sf).withColumn("DELAY_TIME", F.when(F.col("TYPE") != "error", F.col("DELAY_TIME")))


_NULLABLE = f"(SELECT * REPLACE (CASE WHEN type <> 'error' THEN delay_time END AS delay_time) FROM {STATS})"


@check("agg8_last_per_bucket", f"""SELECT date_trunc('hour', gmt_modified) AS bucket,
 arg_max(delay_time, id) FILTER (delay_time IS NOT NULL) AS max_delay_time, arg_max(size, id) AS max_size FROM {_NULLABLE} GROUP BY 1""")
def agg8_bucket(spark, sf):
    return rollups.last_value_by(_nullable(spark, sf), ["GMT_MODIFIED", "ID"], ["DELAY_TIME", "SIZE"], interval="1 hour",
                                 alias={"DELAY_TIME": "max_delay_time", "SIZE": "max_size"})


@check("agg8_last_overall", f"SELECT arg_max(delay_time, id) FILTER (delay_time IS NOT NULL) AS delay_time, arg_max(type, id) AS type FROM {_NULLABLE}")
def agg8_overall(spark, sf):
    return rollups.last_value_by(_nullable(spark, sf), ["GMT_MODIFIED", "ID"], ["DELAY_TIME", "TYPE"],
                                 alias={"DELAY_TIME": "delay_time", "TYPE": "type"})


@check("agg8_last_by_source", f"SELECT pipeline_id, arg_max(type, id) AS state FROM {STATS} GROUP BY pipeline_id")
def agg8_source(spark, sf):
    out = rollups.last_value_by(stats(spark, sf), ["GMT_MODIFIED", "ID"], ["TYPE"], by=["PIPELINE_ID"], alias={"TYPE": "state"})
    return out.withColumnRenamed("PIPELINE_ID", "pipeline_id")


@check("agg9_flatten_kv", """SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click,
 max(CASE WHEN event_type = 'signup' THEN value END) AS signup, cast(NULL AS DOUBLE) AS missing FROM events
 WHERE event_type IN ('click','signup','missing') GROUP BY user_id""")
def agg9(spark, sf):
    return rollups.flatten_kv(read(spark, sf, "events"), "event_type", "value", ["click", "signup", "missing"], by=["user_id"])


@check("agg11_count", "SELECT count(*) AS count FROM lineitem")
def agg11(spark, sf):
    return rollups.row_count(read(spark, sf, "lineitem"))


@check("agg12_duplicate_identity", """SELECT c_nationkey, count(DISTINCT c_custkey) AS nodes, min(c_custkey) AS first_node,
 max(c_custkey) AS last_node FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_custkey) > 1""")
def agg12(spark, sf):
    return rollups.duplicate_identity(read(spark, sf, "customer"), "c_nationkey", "c_custkey")


@check("agg12_identity_members", """SELECT DISTINCT o_totalprice, o_custkey FROM orders WHERE o_totalprice IN
 (SELECT o_totalprice FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1)""")
def agg12_members(spark, sf):
    return rollups.identity_members(read(spark, sf, "orders"), "o_totalprice", "o_custkey")


@check("str4_bucket", f"SELECT id, time_bucket(INTERVAL 5 MINUTE, gmt_modified) AS bucket FROM {STATS}")
def str4(spark, sf):
    return stats(spark, sf).select(F.col("ID").alias("id"), rollups.bucket("GMT_MODIFIED", "5 minutes").alias("bucket"))


@check("str5_fill_gaps", f"""SELECT c.bucket, s.size FROM {_calendar('MINUTE', DAY1, '2024-01-30 23:59:00')} c LEFT JOIN
 (SELECT date_trunc('minute', gmt_modified) AS bucket, cast(sum(size) AS BIGINT) AS size FROM {STATS} GROUP BY 1) s USING (bucket)""")
def str5(spark, sf):
    sums = rollups.bucket_sum(stats(spark, sf), "GMT_MODIFIED", "SIZE", "1 minute", alias="size")
    return rollups.fill_gaps(sums, "bucket", "1 minute", DAY1, DAY30)


@check("str5_fill_gaps_by_source", f"""SELECT p.pipeline_id, c.bucket, s.size FROM (SELECT DISTINCT pipeline_id FROM {STATS}) p
 CROSS JOIN {_calendar('HOUR', DAY1, '2024-01-30 23:00:00')} c LEFT JOIN
 (SELECT pipeline_id, date_trunc('hour', gmt_modified) AS bucket, cast(sum(size) AS BIGINT) AS size FROM {STATS} GROUP BY 1, 2) s
 ON s.pipeline_id = p.pipeline_id AND s.bucket = c.bucket""")
def str5_by(spark, sf):
    sums = rollups.bucket_sum(stats(spark, sf), "GMT_MODIFIED", "SIZE", "1 hour", by=["PIPELINE_ID"], alias="size")
    out = rollups.fill_gaps(sums, "bucket", "1 hour", DAY1, DAY30, by=["PIPELINE_ID"])
    return out.withColumnRenamed("PIPELINE_ID", "pipeline_id")


def _minute_sums(spark, sf):
    sums = rollups.bucket_sum(stats(spark, sf), "GMT_MODIFIED", "SIZE", "1 minute", alias="size")
    return rollups.fill_gaps(sums, "bucket", "1 minute", DAY1, DAY30)


@check("str6_null_as_zero", f"""SELECT c.bucket, coalesce(s.size, 0) AS size FROM {_calendar('MINUTE', DAY1, '2024-01-30 23:59:00')} c LEFT JOIN
 (SELECT date_trunc('minute', gmt_modified) AS bucket, cast(sum(size) AS BIGINT) AS size FROM {STATS} GROUP BY 1) s USING (bucket)""")
def str6_zero(spark, sf):
    return rollups.null_mode(_minute_sums(spark, sf), "size", "zero")


@check("str6_connected", f"SELECT date_trunc('minute', gmt_modified) AS bucket, cast(sum(size) AS BIGINT) AS size FROM {STATS} GROUP BY 1")
def str6_skip(spark, sf):
    return rollups.null_mode(_minute_sums(spark, sf), "size", "skip")


@check("srt1_order_by_time", f"SELECT gmt_modified, id, size FROM {STATS} ORDER BY gmt_modified, id")
def srt1(spark, sf):
    rows = stats(spark, sf).select(F.col("GMT_MODIFIED").alias("gmt_modified"), F.col("ID").alias("id"), F.col("SIZE").alias("size"))
    return rollups.order_by_time(rows, "gmt_modified", "id")


@check("srt2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def srt2(spark, sf):
    return ordered.head(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_totalprice", "o_orderkey"])


_HOURS = f"{_calendar('HOUR', '2024-01-05 00:00:00', '2024-01-25 12:00:00')}"
_IN_RANGE = f"(SELECT * FROM {STATS} WHERE gmt_modified BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}')"


def _points(spark, sf):
    return stats(spark, sf).select(
        F.col("GMT_MODIFIED").alias("time"), F.col("ID").alias("id"), F.col("PIPELINE_ID").alias("pipeline_id"),
        F.col("SIZE").alias("size"), F.col("INSERT_COUNT").alias("insert_count"), F.col("UPDATE_COUNT").alias("update_count"),
        F.col("DELETE_COUNT").alias("delete_count"), F.col("DELAY_TIME").alias("delay_time"), F.col("TYPE").alias("state"),
        (F.col("ID") * 1000000000).alias("last_sync_time"), (F.col("SIZE") * 1000000000).alias("last_position_time"))


@check("panel_throughput", f"SELECT c.bucket, coalesce(cast(sum(s.size) AS BIGINT), 0) AS size FROM {_HOURS} c LEFT JOIN {_IN_RANGE} s ON date_trunc('hour', s.gmt_modified) = c.bucket GROUP BY 1")
def panel_throughput(spark, sf):
    return dashboard.throughput(_points(spark, sf), FROM, TO, "1 hour")


@check("panel_synced_rows", f"SELECT c.bucket, coalesce(cast(sum(s.insert_count) AS BIGINT), 0) AS insert_count FROM {_HOURS} c LEFT JOIN {_IN_RANGE} s ON date_trunc('hour', s.gmt_modified) = c.bucket GROUP BY 1")
def panel_synced(spark, sf):
    return dashboard.synced_rows(_points(spark, sf), FROM, TO, "1 hour")


@check("panel_cumulative_rows", f"""SELECT c.bucket, coalesce(cast(arg_max(s.update_count, s.id) AS BIGINT), 0) AS max_update_count,
 coalesce(cast(arg_max(s.insert_count, s.id) AS BIGINT), 0) AS max_insert_count,
 coalesce(cast(arg_max(s.delete_count, s.id) AS BIGINT), 0) AS max_delete_count
 FROM {_HOURS} c LEFT JOIN {_IN_RANGE} s ON date_trunc('hour', s.gmt_modified) = c.bucket GROUP BY 1""")
def panel_cumulative(spark, sf):
    return dashboard.cumulative_rows(_points(spark, sf), FROM, TO, "1 hour")


@check("panel_max_delay", f"SELECT date_trunc('hour', gmt_modified) AS bucket, max(delay_time) AS max_delay_time FROM {_IN_RANGE} GROUP BY 1")
def panel_delay(spark, sf):
    return dashboard.max_delay(_points(spark, sf), FROM, TO, "1 hour")


@check("panel_last_times", f"SELECT cast(arg_max(id, id) AS DOUBLE) AS last_sync_time, cast(arg_max(size, id) AS DOUBLE) AS last_position_time FROM {_IN_RANGE}")
def panel_times(spark, sf):
    return dashboard.last_times(_points(spark, sf), FROM, TO, tie=["id"])


@check("panel_working_state", f"SELECT pipeline_id, max(gmt_modified) AS time, arg_max(type, id) AS state FROM {_IN_RANGE} GROUP BY 1")
def panel_state(spark, sf):
    return dashboard.working_state(_points(spark, sf), FROM, TO, tie=["id"])


@check("panel_working_state_series", f"SELECT date_trunc('hour', gmt_modified) AS bucket, arg_max(type, id) AS state FROM {_IN_RANGE} GROUP BY 1")
def panel_state_series(spark, sf):
    return dashboard.working_state_series(_points(spark, sf), FROM, TO, "1 hour", tie=["id"])


@check("udf1_named_query", f"""SELECT pipeline_id, cast(sum(insert_count) AS BIGINT) AS insert_count, cast(sum(update_count) AS BIGINT) AS update_count,
 cast(sum(delete_count) AS BIGINT) AS delete_count FROM {_IN_RANGE} GROUP BY 1""")
def udf1(spark, sf):
    return named.NamedQueries(spark).run("history_totals", {"table_history_stat": stats(spark, sf)}, begin=FROM, end=TO)


_NAMED = {"new_delays": "DELAY_STAT", "new_log_records": "LOG_RECORD", "new_throughput": "THROUGHPUT_STAT", "changed_totals": "TABLE_STAT", "new_history": "TABLE_HISTORY_STAT"}


def _check_named(query: str, table: str) -> None:
    by_id = table == "LOG_RECORD"
    columns = [c.lower() for c in STAT_COLUMNS[table]]
    past = "id > 100" if by_id else f"gmt_modified > TIMESTAMP '{FROM}'"

    @check(f"udf1_{query}", f"SELECT {', '.join(f'{c} AS "{c}"' for c in columns)} FROM {stat_sql(table)} WHERE {past}")
    def run(spark, sf):
        return named.NamedQueries(spark).run(query, {table.lower(): stat_table(spark, sf, table)}, last=100 if by_id else FROM)

    times = [c for c in STAT_COLUMNS[table] if STAT_TABLES[table].find(f"{c} timestamp") >= 0]

    @check(f"src1_read_{table.lower()}", f"SELECT * FROM {stat_sql(table)}")
    def read_it(spark, sf):
        """The table as its owner stores it, written and read through its reader."""
        folder = temporary_folder(spark, "stat")
        rows = stat_table(spark, sf, table)
        kinds = {f.name: f.dataType for f in struct_of(STAT_TABLES[table]).fields}
        rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in rows.columns]).write.parquet(f"{folder}/{table}")
        out = stat_sources.read_stat(spark, folder, table)
        plain = {c: F.col(c).cast("timestamp_ntz") for c in times}
        return out.withColumns(plain | ({"ID": F.col("ID").cast("long")} if table == "TABLE_HISTORY_STAT" else {}))


for _query, _table in _NAMED.items():
    _check_named(_query, _table)


@check("udf1_manager_exception", f"SELECT 1 AS count FROM {stat_sql('LOG_RECORD')} WHERE pipeline_id = '-1' AND gmt_modified BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' LIMIT 1")
def udf1_exception(spark, sf):
    return named.NamedQueries(spark).run("manager_exception", {"log_record": stat_table(spark, sf, "LOG_RECORD")}, begin=FROM, end=TO)


@check("udf2_check_query", """SELECT cast(row_number() OVER (ORDER BY c_mktsegment DESC) AS INTEGER) AS "#", c_mktsegment, cast(n AS VARCHAR) AS n FROM
 (SELECT coalesce(c_mktsegment, 'NULL') AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 1 LIMIT 100)""")
def udf2(spark, sf):
    read(spark, sf, "customer").createOrReplaceTempView("lagscope_customer")
    return named.check_query(spark, "SELECT c_mktsegment, count(*) AS n FROM lagscope_customer GROUP BY c_mktsegment ORDER BY c_mktsegment DESC")
