"""Registration of checked queries and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.schemas import STAT_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Registers a query and the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def stats(spark: SparkSession, sf: str) -> DataFrame:
    """The events as rows of a statistics table."""
    kind = F.col("event_type")
    return read(spark, sf, "events").select(
        F.col("event_id").alias("ID"),
        F.col("ts").alias("GMT_MODIFIED"),
        F.col("user_id").alias("PIPELINE_ID"),
        kind.alias("TYPE"),
        F.col("value").alias("DELAY_TIME"),
        F.round(F.col("value") * 100).cast("long").alias("SIZE"),
        (kind == "signup").cast("long").alias("INSERT_COUNT"),
        kind.isin("click", "view", "purchase").cast("long").alias("UPDATE_COUNT"),
        (kind == "error").cast("long").alias("DELETE_COUNT"),
    )


STATS = """(SELECT event_id AS id, ts AS gmt_modified, user_id AS pipeline_id, event_type AS type, value AS delay_time,
 cast(round(value * 100) AS BIGINT) AS size,
 CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS insert_count,
 CASE WHEN event_type IN ('click','view','purchase') THEN 1 ELSE 0 END AS update_count,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS delete_count FROM events)"""


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """The events as log records; errors are the manager's."""
    return stats(spark, sf).withColumn(
        "PIPELINE_ID", F.when(F.col("TYPE") == "error", F.lit("-1")).otherwise(F.col("PIPELINE_ID").cast("string"))
    )


LOGS = f"(SELECT * REPLACE (CASE WHEN type = 'error' THEN '-1' ELSE cast(pipeline_id AS VARCHAR) END AS pipeline_id) FROM {STATS})"


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a change stream: four events make a transaction, views are its marks."""
    kind = F.col("event_type")
    return read(spark, sf, "events").select(
        F.when(F.col("event_id") % 4 == 3, F.lit("xid")).otherwise(F.lit("row")).alias("kind"),
        F.when(kind == "signup", F.lit("I")).when(kind == "error", F.lit("D")).otherwise(F.lit("U")).alias("op"),
        F.when(kind == "view", F.lit("retl_mark")).otherwise(F.lit("account")).alias("table"),
        F.col("user_id").alias("key"),
        F.col("value"),
        F.when(F.col("user_id") < 75, F.lit(1)).otherwise(F.lit(2)).alias("channel_id"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("t-"), F.floor(F.col("event_id") / 4).cast("string")).alias("gtid"),
        F.col("ts"),
    )


CHANGES = """(SELECT CASE WHEN event_id % 4 = 3 THEN 'xid' ELSE 'row' END AS kind,
 CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
 CASE WHEN event_type = 'view' THEN 'retl_mark' ELSE 'account' END AS "table",
 user_id AS key, value, CASE WHEN user_id < 75 THEN 1 ELSE 2 END AS channel_id,
 event_id AS pos, 't-' || cast(event_id // 4 AS VARCHAR) AS gtid, ts FROM events)"""


#: A statistics table's columns, made of the events; the same text is Spark SQL and DuckDB SQL.
_STAT = {
    "ID": "event_id", "DELAY_TIME": "cast(round(value * 100) AS BIGINT)", "PIPELINE_ID": "user_id", "GMT_CREATE": "ts", "GMT_MODIFIED": "ts",
    "NID": "concat('n', cast(user_id % 7 AS VARCHAR(9)))", "CHANNEL_ID": "cast(user_id % 5 AS VARCHAR(9))", "TITLE": "event_type",
    "MESSAGE": "concat(event_type, ' of ', cast(user_id AS VARCHAR(19)))", "INSERT_COUNT": "cast(event_id % 3 AS BIGINT)",
    "UPDATE_COUNT": "cast(event_id % 5 AS BIGINT)", "DELETE_COUNT": "cast(event_id % 2 AS BIGINT)", "START_TIME": "ts", "END_TIME": "ts",
    "TYPE": "event_type", "NUMBER": "cast(event_id % 11 AS BIGINT)", "SIZE": "cast(round(value * 100) AS BIGINT)",
}


def _stat_columns(table: str) -> list[str]:
    made = _STAT | ({"PIPELINE_ID": "CASE WHEN event_type = 'error' THEN '-1' ELSE cast(user_id AS VARCHAR(19)) END"} if table == "LOG_RECORD" else {})
    return [f"{made[c]} AS {c}" for c in STAT_COLUMNS[table]]


def stat_table(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """The events as a statistics table of the given name, with the columns its collector reads."""
    return read(spark, sf, "events").selectExpr(*_stat_columns(table))


def stat_sql(table: str) -> str:
    return f"(SELECT {', '.join(_stat_columns(table))} FROM events)"


def envelope(spark: SparkSession, sf: str) -> DataFrame:
    """The events as JSON change events: positions restart with every file, some updates move the key, some lines are torn."""
    n, kind = F.col("event_id"), F.col("event_type")
    op = F.when(kind == "signup", F.lit("I")).when(kind == "error", F.lit("D")).otherwise(F.lit("U"))
    key = F.col("user_id")
    moved = F.when((op == "U") & (n % 10 == 0), key + 1000).otherwise(key)
    mark = kind == "view"
    side = lambda k: F.create_map(F.lit("id"), k.cast("string"), F.lit("value"), F.col("value").cast("string"), F.lit("channel_id"), (key % 2).cast("string"))
    event = F.struct(
        F.when(n % 4 == 3, F.lit("xid")).otherwise(F.lit("row")).alias("kind"), op.alias("op"),
        F.when(mark, F.lit("retl")).otherwise(F.lit("shop")).alias("schema"), F.when(mark, F.lit("retl_mark")).otherwise(F.lit("account")).alias("table"),
        F.when(op != "I", side(key)).alias("before"), F.when(op != "D", side(moved)).alias("after"),
        F.concat(F.lit("bin."), (F.floor(n / 4000) + 8).cast("string")).alias("file"), (n % 4000).alias("pos"),
        F.concat(F.lit("t-"), F.floor(n / 4).cast("string")).alias("gtid"),
    )
    return read(spark, sf, "events").select(F.when(n % 97 == 4, F.concat(F.lit("{torn "), n.cast("string"))).otherwise(F.to_json(event)).alias("value"))


#: The readable events of ``envelope``.
ENVELOPE = """(SELECT event_id AS n, CASE WHEN event_id % 4 = 3 THEN 'xid' ELSE 'row' END AS kind,
 CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, event_type = 'view' AS mark, user_id AS key,
 CASE WHEN event_type NOT IN ('signup', 'error') AND event_id % 10 = 0 THEN user_id + 1000 ELSE user_id END AS moved, value, user_id % 2 AS channel,
 'bin.' || cast(event_id // 4000 + 8 AS VARCHAR) AS file, event_id % 4000 AS pos, 't-' || cast(event_id // 4 AS VARCHAR) AS gtid
 FROM events WHERE event_id % 97 <> 4)"""


def status(spark: SparkSession, sf: str) -> DataFrame:
    """The suppliers as node status rows."""
    nation, money = F.col("s_nationkey"), F.col("s_acctbal")
    return read(spark, sf, "supplier").select(
        F.concat(F.col("s_name"), F.lit(":3306")).alias("address"),
        F.lit("Waiting").alias("Slave_IO_State"),
        F.concat(F.lit("master-"), nation).alias("Master_Host"),
        F.lit("Reading").alias("Slave_SQL_Running_State"),
        F.when(nation < 12, F.lit("Yes")).when(nation < 18, F.lit("YES")).when(nation < 22, F.lit("Connecting")).alias("Slave_IO_Running"),
        F.when(nation % 5 == 4, F.lit("No")).otherwise(F.lit("Yes")).alias("Slave_SQL_Running"),
        F.when(money < 0, F.lit("NULL")).when(money < 9000, F.floor(money / 50).cast("string")).alias("Seconds_Behind_Master"),
        F.when(nation == 7, F.lit("timed out")).otherwise(F.lit("")).alias("Last_IO_Error"),
        F.when(nation == 3, F.lit(1062)).when(nation != 2, F.lit(0)).alias("Last_Errno"),
        F.when(nation == 3, F.lit("Duplicate entry")).otherwise(F.lit("")).alias("Last_Error"),
        (nation != 5).alias("reachable"),
    )


STATUS = """(SELECT s_name || ':3306' AS address, 'Waiting' AS io_state, 'master-' || s_nationkey AS master_host,
 'Reading' AS sql_state,
 CASE WHEN s_nationkey < 12 THEN 'Yes' WHEN s_nationkey < 18 THEN 'YES' WHEN s_nationkey < 22 THEN 'Connecting' ELSE '' END AS io_run,
 CASE WHEN s_nationkey % 5 = 4 THEN 'No' ELSE 'Yes' END AS sql_run,
 CASE WHEN s_acctbal < 0 THEN 'NULL' WHEN s_acctbal < 9000 THEN cast(cast(floor(s_acctbal / 50) AS BIGINT) AS VARCHAR) ELSE '' END AS lag,
 CASE WHEN s_nationkey = 7 THEN 'timed out' ELSE '' END AS io_error,
 CASE WHEN s_nationkey = 3 THEN '1062' WHEN s_nationkey <> 2 THEN '0' ELSE '' END AS errno,
 CASE WHEN s_nationkey = 3 THEN 'Duplicate' ELSE '' END AS last_error,
 s_nationkey <> 5 AS reachable FROM supplier)"""
