"""Declared schemas of the input tables and records."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the five statistics tables, as their owner declares them.
STAT_TABLES = {
    "DELAY_STAT": "ID long, DELAY_TIME long, DELAY_NUMBER long, PIPELINE_ID long, GMT_CREATE timestamp, GMT_MODIFIED timestamp",
    "LOG_RECORD": "ID long, NID string, CHANNEL_ID string, PIPELINE_ID string, TITLE string, MESSAGE string, GMT_CREATE timestamp, GMT_MODIFIED timestamp",
    "TABLE_HISTORY_STAT": "ID decimal(20,0), FILE_SIZE long, FILE_COUNT long, INSERT_COUNT long, UPDATE_COUNT long, DELETE_COUNT long, DATA_MEDIA_PAIR_ID long, PIPELINE_ID long, START_TIME timestamp, END_TIME timestamp, GMT_CREATE timestamp, GMT_MODIFIED timestamp",
    "TABLE_STAT": "ID long, FILE_SIZE long, FILE_COUNT long, INSERT_COUNT long, UPDATE_COUNT long, DELETE_COUNT long, DATA_MEDIA_PAIR_ID long, PIPELINE_ID long, GMT_CREATE timestamp, GMT_MODIFIED timestamp",
    "THROUGHPUT_STAT": "ID long, TYPE string, NUMBER long, SIZE long, PIPELINE_ID long, START_TIME timestamp, END_TIME timestamp, GMT_CREATE timestamp, GMT_MODIFIED timestamp",
}

# The columns each collector reads.
STAT_COLUMNS = {
    "DELAY_STAT": ("ID", "DELAY_TIME", "PIPELINE_ID", "GMT_CREATE", "GMT_MODIFIED"),
    "LOG_RECORD": ("ID", "NID", "CHANNEL_ID", "PIPELINE_ID", "TITLE", "MESSAGE", "GMT_MODIFIED"),
    "TABLE_HISTORY_STAT": ("ID", "INSERT_COUNT", "UPDATE_COUNT", "DELETE_COUNT", "PIPELINE_ID", "START_TIME", "END_TIME", "GMT_CREATE", "GMT_MODIFIED"),
    "TABLE_STAT": ("ID", "INSERT_COUNT", "UPDATE_COUNT", "DELETE_COUNT", "PIPELINE_ID", "GMT_CREATE", "GMT_MODIFIED"),
    "THROUGHPUT_STAT": ("ID", "TYPE", "NUMBER", "SIZE", "PIPELINE_ID", "START_TIME", "END_TIME", "GMT_CREATE", "GMT_MODIFIED"),
}

# Which column carries the position of each collector.
STAT_POSITION = {
    "DELAY_STAT": "GMT_MODIFIED",
    "TABLE_HISTORY_STAT": "GMT_MODIFIED",
    "TABLE_STAT": "GMT_MODIFIED",
    "THROUGHPUT_STAT": "GMT_MODIFIED",
    "LOG_RECORD": "ID",
}

# Columns of a node status row and of a server variables row.
NODE_STATUS = (
    "Slave_IO_State string, Master_Host string, Master_User string, Master_Port int, "
    "Slave_SQL_Running_State string, Auto_Position boolean, Slave_IO_Running string, "
    "Slave_SQL_Running string, Master_Server_Id string, Seconds_Behind_Master string, "
    "Last_IO_Error string, Last_Errno int, Last_Error string"
)
VARIABLES = "Variable_name string, Value string"

# Server variables kept in the wide record.
VARIABLE_NAMES = (
    "server_id", "log_bin", "sql_log_bin", "gtid_mode", "gtid_next", "slave_skip_errors",
    "binlog_format", "master_info_repository", "relay_log_info_repository", "innodb_version",
    "server_uuid",
)

# Table catalogue columns and the schemas that belong to the server itself.
CATALOGUE = (
    "TABLE_SCHEMA string, TABLE_NAME string, TABLE_ROWS int, CREATE_TIME string, "
    "UPDATE_TIME string, TABLE_COMMENT string"
)
SYSTEM_SCHEMAS = ("performance_schema", "information_schema", "mysql", "sys")

# Change envelope: one row per event of a replication log.
CHANGE_KINDS = ("rotate", "table_changed", "ddl", "row", "xid", "gtid", "pos_synced")
CHANGE = (
    "kind string, op string, schema string, table string, key string, "
    "before map<string,string>, after map<string,string>, file string, pos long, next_file string, "
    "ddl string, force boolean, gtid string, gtid_set string, ts timestamp"
)
CHANGE_READ = CHANGE + ", reject string"  # as read: an event that cannot be read is its own text, and nothing else

GAUGE = (
    "ipPort string, keys array<string>, time string, category string, "
    "values array<struct<metricType:string,name:string,val:bigint>>"
)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
