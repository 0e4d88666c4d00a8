"""Health rules, previews, ditto marks, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import STATUS, check, read, status
from lagscope.functions import scalars
from lagscope.operators import health, ordered, reconcile
from lagscope.sources import nodes

_ERRORS = f"""list_filter([
 CASE WHEN NOT reachable THEN 'Can''t connect to MySQL (Check Pass)' END,
 CASE WHEN errno <> '0' THEN 'Error when processing relay log (Last_Errno = ' || errno || ')' END,
 CASE WHEN errno <> '0' THEN '(Last_Error = ' || last_error || ')' END,
 CASE WHEN io_run <> 'Yes' THEN 'I/O thread for reading the master''s binary log is not running (Slave_IO_Running)' END,
 CASE WHEN sql_run <> 'Yes' THEN 'SQL thread for executing events in the relay log is not running (Slave_SQL_Running)' END,
 CASE WHEN lag = 'NULL' THEN 'The Slave is reporting ''NULL'' (Seconds_Behind_Master)'
      WHEN try_cast(lag AS DOUBLE) > 60 THEN 'The Slave is at least 60 seconds behind the master (Seconds_Behind_Master)' END
 ], lambda x: x IS NOT NULL)"""


@check("hlt1_replication_errors", f"SELECT address, array_to_string(e, '|') AS errors, cast(len(e) AS INTEGER) AS n_errors, len(e) = 0 AS ok FROM (SELECT address, {_ERRORS} AS e FROM {STATUS})")
def hlt1(spark, sf):
    return health.replication_errors(status(spark, sf)).select("address", F.array_join("errors", "|").alias("errors"), "n_errors", "ok")


def _node(path):
    """Answers with the status of one node, a row of a parquet file; nodes of nation 5 do not answer."""

    def fetch(address):
        import pyarrow.dataset as ds

        name = address.removesuffix(":3306")
        row = ds.dataset(path, format="parquet").to_table(columns=["s_nationkey", "s_acctbal"], filter=ds.field("s_name") == name).to_pylist()[0]
        if row["s_nationkey"] == 5:
            raise ConnectionError("no route")
        return [{"Slave_IO_Running": "Yes" if row["s_nationkey"] < 12 else "No", "Seconds_Behind_Master": None if row["s_acctbal"] < 0 else str(int(row["s_acctbal"] // 50))}]

    return fetch


@check("src5_unreachable_nodes", """SELECT s_name || ':3306' AS address, s_nationkey <> 5 AS reachable, CASE WHEN s_nationkey = 5 THEN 'ConnectionError: no route' END AS error,
 CASE WHEN s_nationkey <> 5 THEN CASE WHEN s_nationkey < 12 THEN 'Yes' ELSE 'No' END END AS io_running,
 CASE WHEN s_nationkey <> 5 AND s_acctbal >= 0 THEN cast(cast(floor(s_acctbal / 50) AS BIGINT) AS VARCHAR) END AS lag FROM supplier""")
def src5_nodes(spark, sf):
    """Every supplier is a node that is asked on its own."""
    addresses = [r.address for r in read(spark, sf, "supplier").select(F.concat("s_name", F.lit(":3306")).alias("address")).collect()]  # the list of nodes
    schema = T.StructType.fromDDL("Slave_IO_Running string, Seconds_Behind_Master string")
    found = nodes.read_nodes(spark, addresses, _node(f"{sf}/supplier.parquet"), schema, per_task=8)
    return found.select("address", "reachable", "error", F.col("Slave_IO_Running").alias("io_running"), F.col("Seconds_Behind_Master").alias("lag"))


@check("agg10_error_counts", f"SELECT cast(len(e) AS INTEGER) AS n_errors, count(*) AS nodes FROM (SELECT {_ERRORS} AS e FROM {STATUS}) GROUP BY 1")
def agg10(spark, sf):
    return health.replication_errors(status(spark, sf)).groupBy("n_errors").agg(F.count("*").alias("nodes"))


_BAD = "NOT (io_error = '' AND lower(io_run) = 'yes' AND lower(sql_run) = 'yes')"


@check("hlt2_cluster_status", f"""SELECT address, 'Address:' || address || chr(10) || 'SlaveIoRunning:' || io_run || chr(10) || 'SlaveSQLRunning:' || sql_run || chr(10)
 || 'LastIOError:' || io_error || chr(10) AS problem FROM {STATUS} WHERE {_BAD}""")
def hlt2(spark, sf):
    return health.cluster_status(status(spark, sf))


_MENDED = f"(SELECT * REPLACE ('' AS io_error, 'YES' AS io_run, 'yes' AS sql_run) FROM {STATUS})"


@check("hlt2_cluster_ok", f"""SELECT address, 'bad' AS problem FROM {_MENDED} WHERE {_BAD}
 UNION ALL SELECT cast(NULL AS VARCHAR), 'OK' WHERE (SELECT count(*) FROM {_MENDED} WHERE {_BAD}) = 0""")
def hlt2_ok(spark, sf):
    """All nodes after both threads run again, in whatever case they say so."""
    mended = {"Last_IO_Error": F.lit(""), "Slave_IO_Running": F.lit("YES"), "Slave_SQL_Running": F.lit("yes")}
    return health.cluster_status(status(spark, sf).withColumns(mended))


@check("snk7_health_json", f"""SELECT address, '{{"Address":"' || address || '","SlaveIOState":"' || io_state || '","MasterHost":"' || master_host || '","SlaveSQLRunningState":"' || sql_state
 || '","SlaveIoRunning":"' || io_run || '","SlaveSQLRunning":"' || sql_run || '","SecondsBehindMaster":"' || lag || '","LastIOError":"' || io_error || '"}}' AS json FROM {STATUS}""")
def snk7(spark, sf):
    return health.health_report(status(spark, sf), "json")


@check("snk7_health_table", f"""SELECT row_number() OVER (ORDER BY address) AS "#", address AS "Address", io_state AS "Slave IO State", master_host AS "Master Host",
 sql_state AS "Slave SQL Running State", io_run AS "Slave Io Running", sql_run AS "Slave SQL Running", lag AS "Seconds Behind Master", io_error AS "Last IO Error" FROM {STATUS}""")
def snk7_table(spark, sf):
    return health.health_report(status(spark, sf), "table")


@check("snk6_preview", """SELECT cast(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS "#", cast(o_orderkey AS VARCHAR) AS o_orderkey, cast(o_totalprice AS VARCHAR) AS o_totalprice,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'NULL' ELSE o_orderpriority END AS o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)""")
def snk6(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"))
    return ordered.preview(rows, "o_orderkey")


@check("win1_ditto", """SELECT o_orderkey, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER w THEN '"' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderpriority <> '' AND o_orderpriority = lag(o_orderpriority) OVER w THEN '"' ELSE o_orderpriority END AS o_orderpriority
 FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders) WINDOW w AS (ORDER BY o_orderkey)""")
def win1(spark, sf):
    low = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.col("o_orderpriority"))
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", low.alias("o_orderpriority"))
    return ordered.ditto(rows, ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@check("win2_row_number", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_number FROM events")
def win2(spark, sf):
    return ordered.number_rows(read(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@check("win2_row_number_by_group", "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_number FROM lineitem")
def win2_by(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = read(spark, sf, "lineitem").select("l_returnflag", *keys)
    return ordered.number_rows(rows, keys, by=["l_returnflag"]).drop("l_suppkey", "l_extendedprice")


@check("joi2_reconcile_counts", """SELECT l_orderkey, count(*) AS count_a, count(*) FILTER (l_returnflag <> 'N') AS count_b,
 count(*) FILTER (l_returnflag = 'N') AS diff, count(*) FILTER (l_returnflag = 'N') = 0 AS same FROM lineitem GROUP BY 1""")
def joi2(spark, sf):
    a = read(spark, sf, "lineitem")
    return reconcile.reconcile_counts(a, a.filter(F.col("l_returnflag") != "N"), ["l_orderkey"])


@check("joi2_reconcile_total", "SELECT count(*) AS count_a, (SELECT count(*) FROM lineitem) AS count_b, count(*) - (SELECT count(*) FROM lineitem) AS diff, count(*) = (SELECT count(*) FROM lineitem) AS same FROM orders")
def joi2_total(spark, sf):
    return reconcile.reconcile_counts(read(spark, sf, "orders").select("o_orderkey"), read(spark, sf, "lineitem").select("l_orderkey"))


@check("joi3_reconcile_rows", """WITH b AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_custkey,
 CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)
 SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b' ELSE 'differs' END AS status
 FROM orders a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey
 WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def joi3(spark, sf):
    a = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    b = a.select(
        F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        "o_custkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("o_totalprice"))
    return reconcile.reconcile_rows(a, b, ["o_orderkey"], ["o_custkey", "o_totalprice"])


@check("joi3_reconcile_ranges", """WITH b AS (SELECT CASE WHEN o_orderkey // 50 % 97 = 5 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
 CASE WHEN o_orderkey // 50 % 97 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders)
 SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b' ELSE 'differs' END AS status
 FROM orders a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey
 WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def joi3_ranges(spark, sf):
    a = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    part = F.floor(F.col("o_orderkey") / 50) % 97
    b = a.select(
        F.when(part == 5, F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        "o_custkey", F.when(part == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return reconcile.reconcile_ranges(a, b, ["o_orderkey"], leaf_rows=1000)


@check("mth1_id_origin", "SELECT o_orderkey, (o_orderkey - 1 + 2) % 2 + 1 AS origin, (o_orderkey - 1 + 3) % 3 + 1 AS origin3 FROM orders")
def mth1(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", scalars.id_origin("o_orderkey", 2).alias("origin"), scalars.id_origin("o_orderkey", 3).alias("origin3"))
