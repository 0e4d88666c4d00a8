"""Incremental and interval filters; each keeps the column bare so the scan can prune."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.schemas import SYSTEM_SCHEMAS
from lagscope.functions.text import equals_any_ci
from lagscope.session import typed_time


def newer_than(df: DataFrame, ts_col: str, last) -> DataFrame:
    """Rows strictly after the saved time."""
    return df.filter(F.col(ts_col) > typed_time(df, ts_col, last))


def after_id(df: DataFrame, id_col: str, last: int) -> DataFrame:
    """Rows strictly after the saved id."""
    return df.filter(F.col(id_col) > F.lit(last))


def between(df: DataFrame, ts_col: str, begin, end) -> DataFrame:
    """Rows of a closed interval."""
    return df.filter(F.col(ts_col).between(typed_time(df, ts_col, begin), typed_time(df, ts_col, end)))


def time_range(df: DataFrame, ts_col: str, now, span: timedelta = timedelta(hours=24)) -> DataFrame:
    """A dashboard's range: from ``span`` before ``now`` up to ``now``."""
    end = datetime.fromisoformat(now) if isinstance(now, str) else now
    return between(df, ts_col, end - span, end)


def user_tables(df: DataFrame, exclude=(), schema_col: str = "TABLE_SCHEMA") -> DataFrame:
    """Catalogue rows outside the system schemas and the caller's list."""
    return df.filter(~F.col(schema_col).isin([*SYSTEM_SCHEMAS, *exclude]))


def user_schemas(df: DataFrame, schema_col: str = "Database") -> DataFrame:
    """Schema names other than the system ones, ignoring case."""
    return df.filter(~equals_any_ci(schema_col, SYSTEM_SCHEMAS))
