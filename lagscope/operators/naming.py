"""Free backup names for tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.functions.text import is_backup_name


def unused(candidates: DataFrame, used: DataFrame, keys) -> DataFrame:
    """Candidates that are not among the used names. A name used by a third of the rows is one row per task before it is shuffled."""
    return candidates.join(used.select(*keys).distinct(), list(keys), "left_anti")


def smallest_free_suffix(names: DataFrame, name: str = "name", by=(), stem: str = "_bak") -> DataFrame:
    """For every plain name the smallest n >= 1 so that ``name + stem + n`` is not taken.

    The answer is 1 or one above a taken suffix, so those are the only candidates. One scan, two
    combining aggregations and no join; no suffix list is gathered, so a name with very many
    backups is as cheap as the same number of names.
    """
    by = list(by)
    shape = "^(.+)" + re.escape(stem) + "([1-9][0-9]{0,17})$"
    taken = F.regexp_extract(name, shape, 2).try_cast("long")

    def item(n, used: bool, plain: bool):
        return F.struct(n.cast("long").alias("n"), F.lit(used).alias("used"), F.lit(plain).alias("plain"))

    backup = is_backup_name(name, stem)
    items = F.when(~backup, F.array(item(F.lit(1), False, True))).otherwise(
        F.array(item(taken, True, False), item(taken + 1, False, False))
    )
    base = F.when(~backup, F.col(name)).otherwise(F.regexp_extract(name, shape, 1))
    rows = names.filter(~backup | taken.isNotNull()).select(*by, base.alias(name), F.explode(items).alias("_i"))
    marks = rows.groupBy(*by, name, F.col("_i.n").alias("_n")).agg(
        F.max("_i.used").alias("_used"), F.max("_i.plain").alias("_plain")
    )
    smallest = marks.groupBy(*by, name).agg(
        F.min(F.when(~F.col("_used"), F.col("_n"))).alias("suffix"), F.max("_plain").alias("_plain")
    )
    free = F.concat(F.col(name), F.lit(stem), F.col("suffix").cast("string"))
    return smallest.filter("_plain").drop("_plain").withColumn("free_name", free)
