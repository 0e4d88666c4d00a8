"""Gauge records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from lagscope.functions.scalars import WORKING, flag_equals, key_path
from lagscope.functions.times import compact_time
from lagscope.operators.rollups import MANAGER, bucket_agg, change_totals, fill_gaps, has_exception

# Metric types and key words of a gauge record.
GAUGES, COUNTERS, HEALTH_CHECK = "Gauges", "Counters", "HealthCheck"
SELF, ALIVE, EXCEPTION, CHANNEL = "self", "alive", "exception", "pipeline"
COUNT_KEYS = {"INSERT_COUNT": "insertCount", "UPDATE_COUNT": "updateCount", "DELETE_COUNT": "deleteCount"}


def _gauges(df: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """One (keys, val) row per pair and input row."""
    items = F.array(*[F.struct(keys.alias("keys"), val.cast("long").alias("val")) for keys, val in pairs])
    return df.select(F.explode(items).alias("_g")).select("_g.keys", "_g.val")


def beat_gauges(runs: DataFrame, host_col: str) -> DataFrame:
    """One alive gauge per row of a table of collector runs."""
    return _gauges(runs, [(key_path(SELF, F.col(host_col), ALIVE), F.lit(1))])


def heartbeat(spark, host: str) -> DataFrame:
    """The single gauge that says the collector ran."""
    return beat_gauges(spark.range(1).select(F.lit(host).alias("host")), "host")


def state_gauges(page_rows: DataFrame, root: str, id_col: str = "pipeline_id", state: str = "state",
                 delay: str = "delay_time", working: str = WORKING) -> DataFrame:
    """Working state (1 or 0) and delay in whole ms of every status page row."""
    source = F.col(id_col)
    return _gauges(page_rows, [
        (key_path(root, CHANNEL, source, "state"), flag_equals(state, working)),
        (key_path(root, CHANNEL, source, "delayTime"), F.coalesce(F.col(delay), F.lit(0))),
    ])


def collect_gauges(log: DataFrame, history: DataFrame, begin, end, root: str, host: str,
                   emit_zero: bool = False) -> DataFrame:
    """Alive, exception and per-source change counts of one interval.

    The exception gauge appears only when there is one, or always (0 or 1) with ``emit_zero``.
    """
    alive = heartbeat(log.sparkSession, host)
    seen = has_exception(log, begin, end, source=MANAGER)
    if emit_zero:
        seen = seen.agg(F.count("*").cast("int").alias("count"))
    exception = _gauges(seen, [(key_path(root, EXCEPTION), F.col("count"))])
    totals = change_totals(history, begin, end, counts=tuple(COUNT_KEYS))
    counts = _gauges(totals, [
        (key_path(root, CHANNEL, F.col("PIPELINE_ID"), key), F.coalesce(F.col(c), F.lit(0)))
        for c, key in COUNT_KEYS.items()
    ])
    return alive.unionByName(exception).unionByName(counts)


def to_gauge_records(gauges: DataFrame, category: str, host: str, time: Column) -> DataFrame:
    """The nested gauge record of every (keys, val) row."""
    value = F.struct(F.lit(GAUGES).alias("metricType"), F.lit("V").alias("name"), F.col("val"))
    return gauges.select(
        F.lit(host).alias("ipPort"),
        "keys",
        compact_time(time).alias("time"),
        F.lit(category).alias("category"),
        F.array(value).alias("values"),
    )


def to_gauge_json(gauges: DataFrame, category: str, host: str, time: Column) -> DataFrame:
    """Gauge records as JSON text, column ``json``."""
    records = to_gauge_records(gauges, category, host, time)
    return records.select(F.to_json(F.struct(*records.columns)).alias("json"))


def missing_heartbeats(beats: DataFrame, ts: str, interval: str, start, end) -> DataFrame:
    """Buckets of the range without a heartbeat."""
    seen = bucket_agg(beats, ts, interval, {"beats": F.count("*")})
    return fill_gaps(seen, "bucket", interval, start, end).filter("beats IS NULL").select("bucket")
