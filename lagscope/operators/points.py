"""Time-series points: projection to point columns, line text, rejects, replacement of equal points."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from lagscope.functions.text import MAX_STRING_BYTES, escape_key, field_literal, snake
from lagscope.functions.times import epoch_ns, time_or
from lagscope.operators.rollups import last_value_by


@dataclass(frozen=True)
class PointSpec:
    """Which columns of a table are the time, the tags and the fields of a point.

    ``tags`` and ``fields`` map a column to its point name, in the order they are written.
    """

    measurement: str
    time: str
    tags: dict[str, str] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, measurement: str, time: str, tags=(), fields=()) -> PointSpec:
        """Columns without an explicit name get the snake-case form of their own."""

        def named(cols):
            return dict(cols) if isinstance(cols, dict) else {c: snake(c) for c in cols}

        return cls(measurement, time, named(tags), named(fields))


def stat_specs(prefix: str = "") -> dict[str, PointSpec]:
    """Points of the five statistics tables and the status page; ``prefix`` leads each measurement."""
    counts = ("INSERT_COUNT", "UPDATE_COUNT", "DELETE_COUNT")
    span = ("START_TIME", "END_TIME")
    fields = {
        "DELAY_STAT": ("delay_stat", ("DELAY_TIME", "ID")),
        "LOG_RECORD": ("log_record", ("ID", "TITLE")),
        "TABLE_HISTORY_STAT": ("history_stat", (*counts, *span, "ID")),
        "TABLE_STAT": ("table_stat", (*counts, "ID")),
        "THROUGHPUT_STAT": ("throughput_stat", ("TYPE", "NUMBER", "SIZE", *span, "ID")),
    }
    specs = {
        table: PointSpec.of(prefix + name, "GMT_MODIFIED", ("PIPELINE_ID",), cols)
        for table, (name, cols) in fields.items()
    }
    specs["STATUS_PAGE"] = PointSpec.of(
        prefix + "pipeline", "time", ("pipeline_id",), ("state", "delay_time", "last_sync_time", "last_position_time")
    )
    return specs


def project(df: DataFrame, spec: PointSpec) -> DataFrame:
    """Only the point's columns, under the point's names; tags become text."""
    return df.select(
        F.col(spec.time).alias("time"),
        *[F.col(c).cast("string").alias(n) for c, n in spec.tags.items()],
        *[F.col(c).alias(n) for c, n in spec.fields.items()],
    )


def _pairs(cols: list[Column]) -> Column:
    return F.concat_ws(",", *cols)


def to_line_protocol(df: DataFrame, spec: PointSpec, now: Column | None = None) -> DataFrame:
    """Adds ``line`` (the point's text, NULL if rejected) and ``reject`` (the reason, NULL if fine).

    NULL tags and fields are left out of the line. Everything is a JVM expression, so the scan,
    the encoding and the write are one stage without a shuffle.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    tags = [
        F.concat(F.lit(_escaped(name) + "="), escape_key(F.col(c).cast("string")))
        for c, name in spec.tags.items()
    ]
    literals = {c: field_literal(F.col(c), types[c]) for c in spec.fields}
    unsupported = [c for c, text in literals.items() if text is None]
    fields = [
        F.concat(F.lit(_escaped(name) + "="), literals[c])
        for c, name in spec.fields.items()
        if literals[c] is not None
    ]
    reason = F.lit(None).cast("string")
    if unsupported:
        reason = F.lit(f"unsupported type: {', '.join(unsupported)}")
    else:
        for c in spec.fields:
            if isinstance(types[c], (T.StringType, T.BinaryType)):
                long = F.octet_length(c) > MAX_STRING_BYTES
                reason = F.when(long, F.lit(f"string too long: {c}")).otherwise(reason)
        reason = F.when(_all_null(spec.fields), F.lit("no fields")).otherwise(reason)
    stamp = F.col(spec.time)
    if now is not None:
        stamp = time_or(stamp, now)
    head = _pairs([F.lit(spec.measurement), *tags])
    line = F.concat_ws(" ", head, _pairs(fields), epoch_ns(stamp).cast("string"))
    return df.withColumn("reject", reason).withColumn("line", F.when(F.col("reject").isNull(), line))


def _escaped(name: str) -> str:
    for mark in (",", "=", " "):
        name = name.replace(mark, "\\" + mark)
    return name


def _all_null(cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNull()
    return out


def split_rejects(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lines, rejects)`` of an encoded table; one bad row does not stop the others."""
    lines = encoded.filter(F.col("reject").isNull()).select("line")
    return lines, encoded.filter(F.col("reject").isNotNull()).drop("line")


def dedupe_points(df: DataFrame, spec: PointSpec, order_by: list[str]) -> DataFrame:
    """One point per (tags, time): each field keeps its last non-NULL value in ``order_by``.

    ``max_by`` combines on the map side, so a point repeated very often costs no extra shuffle.
    """
    return last_value_by(df, order_by, list(spec.fields), by=[*spec.tags, spec.time])
