"""Flags, JSON text, key paths and row origin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from lagscope.session import as_col

# Fixed value: state text of a working replication channel on the status page.
WORKING = "工作中"


def flag_equals(c: Column | str, value: str = WORKING) -> Column:
    """1 where the text equals ``value``, else 0 (also for NULL)."""
    return F.when(as_col(c) == value, F.lit(1)).otherwise(F.lit(0))


def json_of(struct: Column | str, pretty: bool = False) -> Column:
    return F.to_json(as_col(struct), {"pretty": "true"} if pretty else {})


def key_path(*parts: Column | str) -> Column:
    """Array of text keys; plain Python strings are literals."""
    return F.array(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def id_origin(c: Column | str, n: int) -> Column:
    """Offset (1..n) of the master that made an auto-increment id stepping by ``n``."""
    return F.pmod(as_col(c) - 1, F.lit(n)) + 1
