"""Rollups that are kept and extended by new points only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagscope.operators.filters import between
from lagscope.operators.partials import RollupSpec, choose_interval, finished, merge_partials, partials
from lagscope.operators.rollups import fill_gaps
from lagscope.streaming.changes import _exists


def stream_rollup(points: DataFrame, spec: RollupSpec, folder: str, available_now: bool = False):
    """Starts a query that adds the partial rows of every batch to ``folder``/parts, a table partitioned by batch.

    Spark's checkpoint below ``folder`` knows which points were read, so a run reads new points only, and late points simply are partial rows
    of an older bucket. A repeated batch overwrites its own partition. The columns of the partial rows are kept beside them, so a rollup
    of nothing is an empty table.
    """
    folder, spark = folder.rstrip("/"), points.sparkSession
    if not _exists(spark, f"{folder}/columns/_SUCCESS"):
        kind = partials(spark.createDataFrame([], points.schema), spec).schema
        spark.createDataFrame([(kind.json(),)], "columns string").coalesce(1).write.mode("overwrite").text(f"{folder}/columns")

    def on_batch(batch: DataFrame, number: int) -> None:
        out = partials(batch, spec).withColumn("_batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{folder}/parts")

    writer = points.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _kept(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Partial rows of all batches and the last batch among them; what a fold covers is read from the fold."""
    kind = T.StructType.fromJson(json.loads(spark.read.text(f"{folder}/columns").first()[0]))
    batched = T.StructType([*kind.fields, T.StructField("_batch", T.LongType())])
    parts = spark.read.schema(batched).parquet(f"{folder}/parts") if _exists(spark, f"{folder}/parts") else spark.createDataFrame([], batched)
    rows, upto = parts, -1
    if _exists(spark, f"{folder}/folded"):
        folded = spark.read.parquet(f"{folder}/folded")
        upto = folded.agg(F.max("_upto")).first()[0]
        rows = parts.filter(F.col("_batch") > upto).drop("_batch").unionByName(folded.filter(F.col("_upto") == upto).drop("_upto"))
    reached = parts.agg(F.max("_batch")).first()[0]
    return rows.drop("_batch"), max(upto, -1 if reached is None else reached)


def kept_rollup(spark: SparkSession, spec: RollupSpec, folder: str, interval: str | None = None, start=None, end=None) -> DataFrame:
    """The rollup so far at ``interval``, a multiple of the kept one; with ``start`` and ``end`` only buckets that begin in between are read."""
    rows, _ = _kept(spark, folder.rstrip("/"))
    if start is not None:
        rows = between(rows, "bucket", start, end)
    return finished(merge_partials(rows, spec, interval), spec)


def fold_rollup(spark: SparkSession, spec: RollupSpec, folder: str) -> int:
    """Folds all batches so far into one partial row per bucket; returns the batch it reaches. Later points still merge."""
    folder = folder.rstrip("/")
    rows, upto = _kept(spark, folder)
    if upto < 0:  # no point yet
        return upto
    out = merge_partials(rows, spec).withColumn("_upto", F.lit(upto).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_upto").parquet(f"{folder}/folded")
    return upto


def panel(spark: SparkSession, spec: RollupSpec, folder: str, start, end, points: int) -> DataFrame:
    """A panel of about ``points`` buckets between two times, from kept rows alone; buckets without a point are NULL."""
    interval = choose_interval(start, end, points, spec.interval)
    rows = kept_rollup(spark, spec, folder, interval, start, end)
    return fill_gaps(rows, "bucket", interval, start, end, list(spec.by))
