"""Named SQL with named parameters, and the user's own check query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.operators.ordered import preview
from lagscope.schemas import STAT_COLUMNS, STAT_POSITION

# Fixed value: the check query used when none is given.
DEFAULT_CHECK = "select current_date()"


def _newer(table: str) -> str:
    """The collector's columns of the rows past a position."""
    return f"SELECT {', '.join(STAT_COLUMNS[table]).lower()} FROM {table.lower()} WHERE {STAT_POSITION[table].lower()} > :last"


# The collectors' and gauges' queries over views named like the tables.
COLLECT_QUERIES = {
    "new_delays": _newer("DELAY_STAT"),
    "new_log_records": _newer("LOG_RECORD"),
    "new_throughput": _newer("THROUGHPUT_STAT"),
    "changed_totals": _newer("TABLE_STAT"),
    "new_history": _newer("TABLE_HISTORY_STAT"),
    "manager_exception": "SELECT 1 AS count FROM log_record WHERE pipeline_id = '-1' AND gmt_modified BETWEEN :begin AND :end LIMIT 1",
    "history_totals": (
        "SELECT pipeline_id, sum(insert_count) AS insert_count, sum(update_count) AS update_count, "
        "sum(delete_count) AS delete_count FROM table_history_stat "
        "WHERE gmt_modified BETWEEN :begin AND :end GROUP BY pipeline_id"
    ),
}


class NamedQueries:
    """Queries by name; parameters are bound by Spark, never pasted into the text."""

    def __init__(self, spark: SparkSession, texts: dict[str, str] | None = None):
        self.spark, self.texts = spark, dict(texts if texts is not None else COLLECT_QUERIES)

    def register(self, name: str, text: str) -> None:
        self.texts[name] = text

    def run(self, name: str, views: dict[str, DataFrame] | None = None, **args) -> DataFrame:
        """Runs a query over the given views, or over the session's tables."""
        for view, df in (views or {}).items():
            df.createOrReplaceTempView(view)
        return self.spark.sql(self.texts[name], args=args)


def check_query(spark: SparkSession, text: str = DEFAULT_CHECK, order_by=None, n: int = 100) -> DataFrame:
    """Preview of a user's query: at most ``n`` numbered rows as text, in the query's own order unless ``order_by`` is given."""
    result = spark.sql(text)
    if order_by:
        return preview(result, order_by, n)
    first = result.limit(n)  # one task with at most n rows, which it numbers as they come
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) for c in first.columns]
    return first.coalesce(1).select((F.monotonically_increasing_id() + 1).cast("int").alias("#"), *cells)
