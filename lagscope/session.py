"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

# Settings the library relies on; a cluster session may set them itself.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``partitions`` is for local runs only."""
    builder = SparkSession.builder.appName("lagscope")
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}
_temporary: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below ``spark.checkpoint.dir``, the storage every executor can reach.

    Only a local session without that setting gets a folder of its own machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to storage shared by all executors")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="lagscope-")
        base = _local_folders[context.applicationId]
    return f"{base.rstrip('/')}/{name}"


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for data that is removed when the session's program ends."""
    path = f"{shared_folder(spark, name)}-{uuid.uuid4().hex}"
    _temporary.add(path)
    return path


def remove_temporary(spark: SparkSession | None = None) -> None:
    """Removes all temporary folders; called at exit, or by a long program when it no longer reads from them."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(_temporary):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
        _temporary.discard(path)


atexit.register(remove_temporary)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def typed_time(df: DataFrame, ts_col: str, value) -> Column:
    """A literal of the same timestamp type as ``ts_col``, so the filter reaches the scan."""
    kind = df.schema[ts_col].dataType.typeName()
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast(kind)
