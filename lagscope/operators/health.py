"""Replication health rules over node status rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from lagscope.functions.scalars import json_of
from lagscope.functions.text import camel_name_to_words
from lagscope.operators.ordered import number_rows

# The texts of the node rules.
UNREACHABLE = "Can't connect to MySQL (Check Pass)"
ERRNO = "Error when processing relay log (Last_Errno = %s)"
ERRTEXT = "(Last_Error = %s)"
IO_STOPPED = "I/O thread for reading the master's binary log is not running (Slave_IO_Running)"
SQL_STOPPED = "SQL thread for executing events in the relay log is not running (Slave_SQL_Running)"
LAG_NULL = "The Slave is reporting 'NULL' (Seconds_Behind_Master)"
LAG_HIGH = "The Slave is at least %s seconds behind the master (Seconds_Behind_Master)"

# Fields of one cluster status row, in display order.
STATUS_FIELDS = {
    "Address": "address",
    "SlaveIOState": "Slave_IO_State",
    "MasterHost": "Master_Host",
    "SlaveSQLRunningState": "Slave_SQL_Running_State",
    "SlaveIoRunning": "Slave_IO_Running",
    "SlaveSQLRunning": "Slave_SQL_Running",
    "SecondsBehindMaster": "Seconds_Behind_Master",
    "LastIOError": "Last_IO_Error",
}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _optional(df: DataFrame, name: str) -> Column:
    return _text(name) if name in df.columns else F.lit("")


def replication_errors(status: DataFrame, max_lag: float = 60, lexical_lag: bool = False,
                       null_lag_fails: bool = False) -> DataFrame:
    """Adds ``errors``, ``n_errors`` and ``ok`` to every status row; row by row, no shuffle.

    A missing error number or thread state fails, a missing lag does not. The lag is compared as a
    number; ``lexical_lag`` compares it as text, as a shell would. A status read over JDBC gives
    SQL NULL where the text form says ``NULL``: ``null_lag_fails`` counts that as well.
    """
    errno = _text("Last_Errno")
    first_word = F.regexp_extract(_optional(status, "Last_Error"), r"^\s*(\S+)", 1)
    lag = _text("Seconds_Behind_Master")
    high = (lag > str(int(max_lag))) if lexical_lag else lag.try_cast("double") > F.lit(float(max_lag))
    lag_null = lag == "NULL"
    if null_lag_fails:
        lag_null = lag_null | F.col("Seconds_Behind_Master").isNull()
    reachable = F.col("reachable") if "reachable" in status.columns else F.lit(True)
    checks = [
        F.when(~F.coalesce(reachable, F.lit(False)), F.lit(UNREACHABLE)),
        F.when(errno != "0", F.format_string(ERRNO, errno)),
        F.when(errno != "0", F.format_string(ERRTEXT, first_word)),
        F.when(_text("Slave_IO_Running") != "Yes", F.lit(IO_STOPPED)),
        F.when(_text("Slave_SQL_Running") != "Yes", F.lit(SQL_STOPPED)),
        F.when(lag_null, F.lit(LAG_NULL)).when(high, F.lit(LAG_HIGH % f"{max_lag:g}")),
    ]
    out = status.withColumn("errors", F.array_compact(F.array(*checks)))
    return out.withColumns({"n_errors": F.size("errors"), "ok": F.size("errors") == 0})


def is_healthy() -> Column:
    """No I/O error and both threads running, ignoring case."""
    return (
        (_text("Last_IO_Error") == "")
        & (F.lower(_text("Slave_IO_Running")) == "yes")
        & (F.lower(_text("Slave_SQL_Running")) == "yes")
    )


def cluster_status(status: DataFrame) -> DataFrame:
    """One text block per bad node; the single row ``OK`` if there is none. Looking for the first bad node stops each task there."""
    bad = status.filter(~is_healthy()).select(
        "address",
        F.format_string(
            "Address:%s\nSlaveIoRunning:%s\nSlaveSQLRunning:%s\nLastIOError:%s\n",
            F.col("address"), _text("Slave_IO_Running"), _text("Slave_SQL_Running"), _text("Last_IO_Error"),
        ).alias("problem"),
    )
    fine = status.filter(~is_healthy()).limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("address"), F.lit("OK").alias("problem")
    )
    return bad.unionByName(fine)


def health_report(status: DataFrame, fmt: str = "") -> DataFrame:
    """Cluster status as ``json`` (one record per node), ``table`` or, by default, problem text."""
    record = [_text(c).alias(n) for n, c in STATUS_FIELDS.items()]
    if fmt == "json":
        return status.select("address", json_of(F.struct(*record)).alias("json"))
    if fmt == "table":
        rows = number_rows(status.select(*record), ["Address", *[n for n in STATUS_FIELDS if n != "Address"]], name="#")
        return rows.select("#", *[F.col(n).alias(camel_name_to_words(n)) for n in STATUS_FIELDS])
    return cluster_status(status)
