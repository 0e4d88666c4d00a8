"""Full copies of a set of tables to several targets."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Tables a full copy leaves out.
EXCLUDED_TABLES = ("mysql.help_topic", "mysql.help_keyword", "mysql.help_relation", "mysql.help_category")


def fan_out_copy(tables: dict[str, DataFrame], targets, exclude=EXCLUDED_TABLES, fmt: str = "parquet") -> dict[str, list[str]]:
    """Writes every table to every target; returns the paths per table.

    The source is scanned once per table, for the first target; the others are copied from there,
    so all targets hold the same rows even if the source moves on meanwhile.
    """
    targets = list(targets)
    written: dict[str, list[str]] = {}
    for name, df in tables.items():
        if name in exclude or not targets:
            continue
        paths = [f"{target.rstrip('/')}/{name}" for target in targets]
        df.write.mode("overwrite").format(fmt).save(paths[0])
        first = df.sparkSession.read.schema(df.schema).format(fmt).load(paths[0])
        for path in paths[1:]:
            first.write.mode("overwrite").format(fmt).save(path)
        written[name] = paths
    return written
