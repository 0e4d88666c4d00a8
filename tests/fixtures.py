"""Small hand-written statistics tables (one day of 2020) with known answers."""

from lagscope.schemas import STAT_TABLES, struct_of

DAY = "2020-04-20 "


def _at(text):
    from datetime import datetime

    return datetime.fromisoformat(DAY + text)


def _table(spark, name, rows):
    """Rows as dictionaries; columns not given are NULL or, for ID, decimals where declared."""
    from decimal import Decimal

    schema = struct_of(STAT_TABLES[name])
    data = []
    for row in rows:
        values = []
        for f in schema.fields:
            v = row.get(f.name)
            values.append(Decimal(v) if f.name == "ID" and f.dataType.typeName() == "decimal" else v)
        data.append(tuple(values))
    return spark.createDataFrame(data, schema)


def history(spark):
    rows = [
        (1, 1000, 3, "02:49:50", "02:49:55", "02:49:57"),
        (3, 10000, 1, "02:50:01", "02:50:21", "02:50:57"),
        (5, 9000, 3, "02:49:51", "02:50:11", "02:50:57"),
        (7, 100, 1, "06:15:22", "06:15:23", "06:15:35"),
    ]
    return _table(spark, "TABLE_HISTORY_STAT", [
        dict(ID=i, INSERT_COUNT=n, UPDATE_COUNT=0, DELETE_COUNT=0, PIPELINE_ID=p, START_TIME=_at(a), END_TIME=_at(b), GMT_MODIFIED=_at(c))
        for i, n, p, a, b, c in rows])


def table_stat(spark):
    rows = [(1, 10000, 3, "02:50:11"), (3, 10100, 1, "06:15:23")]
    return _table(spark, "TABLE_STAT", [
        dict(ID=i, INSERT_COUNT=n, UPDATE_COUNT=0, DELETE_COUNT=0, PIPELINE_ID=p, GMT_MODIFIED=_at(c)) for i, n, p, c in rows])


def throughput(spark):
    rows = [(1, 1000, 511328, 3, "02:49:57"), (3, 10000, 5111872, 1, "02:50:57"), (5, 9000, 4601240, 3, "02:50:57"), (7, 100, 51176, 1, "06:15:35")]
    return _table(spark, "THROUGHPUT_STAT", [
        dict(ID=i, TYPE="ROW", NUMBER=n, SIZE=s, PIPELINE_ID=p, GMT_MODIFIED=_at(c)) for i, n, s, p, c in rows])


def delays(spark):
    rows = [(1, 1772, 1, "02:49:57"), (3, 6204, 3, "02:49:57"), (5, 14246, 1, "02:50:57"), (7, 13376, 3, "02:50:57"),
            (9, 296, 1, "02:51:57"), (11, 548, 1, "04:13:11"), (13, 713, 1, "04:20:11")]
    return _table(spark, "DELAY_STAT", [dict(ID=i, DELAY_TIME=d, PIPELINE_ID=p, GMT_MODIFIED=_at(c)) for i, d, p, c in rows])


def log_records(spark):
    rows = [(1, "3", "POSITIONTIMEOUT", "04:19:11"), (3, "-1", "EXCEPTION", "04:19:24"), (5, "-1", "EXCEPTION", "04:19:50"),
            (7, "3", "EXCEPTION", "04:19:55"), (9, "-1", "EXCEPTION", "10:54:44")]
    return _table(spark, "LOG_RECORD", [
        dict(ID=i, PIPELINE_ID=p, TITLE=t, MESSAGE="first line\nsecond, 'quoted' line", GMT_MODIFIED=_at(c)) for i, p, t, c in rows])
