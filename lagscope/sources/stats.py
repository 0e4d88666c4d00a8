"""Statistics tables, node status, variables, catalogue, texts and number rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagscope.operators.filters import user_schemas, user_tables
from lagscope.schemas import STAT_COLUMNS, STAT_TABLES, struct_of


def jdbc_options(source: dict, table: str, partition_column: str | None = None) -> dict[str, str]:
    """Reader options of one table, read in ranges of its key.

    A table with a key needs ``lowerBound`` (for example the last position), ``upperBound`` and ``numPartitions``; ``"single": True``
    in the source asks for one connection instead. Zero dates of a MySQL server are NULL.
    """
    options = {str(k): str(v) for k, v in source.get("options", {}).items()}
    options.setdefault("fetchsize", "10000")
    options["dbtable"] = table
    if options.get("url", "").startswith("jdbc:mysql:"):
        options.setdefault("zeroDateTimeBehavior", "CONVERT_TO_NULL")
    missing = {"lowerBound", "upperBound", "numPartitions"} - options.keys()
    if partition_column and not missing:
        options["partitionColumn"] = partition_column
    elif partition_column and not source.get("single"):
        raise ValueError(f"{table} would be read by one task: give {', '.join(sorted(missing))}, or single=True")
    return options


def read_table(spark: SparkSession, source, table: str, schema: T.StructType | None = None,
               partition_column: str | None = None) -> DataFrame:
    """A table over JDBC (``{"format": "jdbc", "options": {...}}``) or below a folder of files."""
    if isinstance(source, dict) and source.get("format") == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(source, table, partition_column)).load()
    if isinstance(source, str):
        source = {"format": "parquet", "path": source}
    reader = spark.read.format(source.get("format", "parquet"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**source.get("options", {})).load(f"{source['path'].rstrip('/')}/{table}")


def read_stat(spark: SparkSession, source, table: str) -> DataFrame:
    """The collector's columns of one statistics table; ids of masters are read in parallel ranges."""
    table = table.upper()
    df = read_table(spark, source, table, struct_of(STAT_TABLES[table]), "ID")
    return df.select(*STAT_COLUMNS[table])


def read_node_status(dfs_by_node: dict[str, DataFrame]) -> DataFrame:
    """Status rows of all nodes, each tagged with its node's address."""
    tagged = [df.withColumn("address", F.lit(node)) for node, df in dfs_by_node.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_variables(df: DataFrame, name: str = "Variable_name", value: str = "Value") -> DataFrame:
    """Server variables as (name, value) text rows."""
    return df.select(F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))


def list_tables(catalogue: DataFrame, exclude=()) -> DataFrame:
    """Tables outside the system schemas and the caller's list."""
    return user_tables(catalogue, exclude)


def list_schemas(databases: DataFrame, col: str = "Database") -> DataFrame:
    """Schemas other than the system ones."""
    return user_schemas(databases.select(col), col)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def gen_rows(spark: SparkSession, n, value: str = "a") -> DataFrame:
    """Rows (key, value) for 1..n, made in parallel."""
    return spark.range(1, n + 1).select(F.col("id").alias("key"), F.col("id").alias(value))
