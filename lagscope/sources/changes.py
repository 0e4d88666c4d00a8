"""Row-change streams in one envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from lagscope.schemas import CHANGE, CHANGE_KINDS, struct_of
from lagscope.session import as_col


def decode_changes(df: DataFrame, value: Column | str = "value", strict: bool = False) -> DataFrame:
    """Envelope columns of JSON messages, for example the ``value`` of a Kafka record.

    A message that is not JSON, has a field of another type, or no known kind is a row with its text in ``reject`` and
    NULL elsewhere; ``strict`` fails on it instead. An empty (NULL) message is rejected as empty text.
    """
    raw = as_col(value).cast("string")
    body = F.from_json(raw, struct_of(CHANGE + ", _corrupt string"), {"columnNameOfCorruptRecord": "_corrupt"})
    read = df.select(raw.alias("_raw"), body.alias("_c"))
    bad = F.col("_c._corrupt").isNotNull() | ~F.coalesce(F.col("_c.kind").isin(*CHANGE_KINDS), F.lit(False))
    text = F.coalesce("_raw", F.lit(""))
    if strict:
        failed = F.raise_error(F.concat(F.lit("unreadable change event: "), text)).cast("boolean")
        read = read.filter(F.when(bad, failed).otherwise(True))
    fields = [F.when(~bad, F.col(f"_c.{f.name}")).alias(f.name) for f in struct_of(CHANGE).fields]
    return read.select(*fields, F.when(bad, text).alias("reject"))


def read_changes(spark: SparkSession, source, streaming: bool = True, strict: bool = False) -> DataFrame:
    """Change events from a folder of JSON lines, or from Kafka options with ``subscribe``; see ``decode_changes``."""
    reader = spark.readStream if streaming else spark.read
    if isinstance(source, dict):
        return decode_changes(reader.format("kafka").options(**source).load(), strict=strict)
    return decode_changes(reader.text(source), strict=strict)


def log_number(file: Column | str = "file") -> Column:
    """The number at the end of a log file's name. Positions restart with every file, so events are in order of (number, position)."""
    return F.regexp_extract(as_col(file), r"(\d+)$", 1).try_cast("long")


def of_kind(changes: DataFrame, kind: str) -> DataFrame:
    """Events of one kind."""
    if kind not in CHANGE_KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(CHANGE_KINDS)}")
    return changes.filter(F.col("kind") == kind)
