"""Rings in the graph of replication channels: changes that come back by another way than they went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.session import temporary_folder


def channels_in_rings(channels: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """The channels (source, target) that lie on a ring of three nodes or more, with ``ring``, the fewest channels of such a ring.

    A pair of channels there and back is no ring; the loop marks of its two ends stop it, while a ring passes them by.
    From the target of every channel a frontier of reached nodes goes on, one join a round, without the channel straight
    back; a channel whose source is reached is on a ring. A node is reached once per channel, so rounds end; their number is the longest
    of the shortest ways. Channels from a node to itself and channels with a NULL end are left out, repeated ones are one.
    """
    spark = channels.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = temporary_folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = kept(channels.select(F.col(source).alias("u"), F.col(target).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "channels")
    steps = edges.select(F.col("u").alias("_from"), F.col("v").alias("_to"))
    reached = edges.select("u", "v", F.col("v").alias("node"))
    frontier, found, length = reached, None, 1
    while not frontier.isEmpty():
        length += 1
        onward = frontier.join(steps, F.col("node") == F.col("_from")).filter("NOT (node = v AND _to = u)").select("u", "v", F.col("_to").alias("node")).distinct()
        fresh = kept(onward.join(reached, ["u", "v", "node"], "left_anti"), "frontier")
        closed = fresh.filter("node = u").select("u", "v", F.lit(length).cast("long").alias("ring"))
        found = closed if found is None else found.unionByName(closed)
        # a channel that has found its shortest ring needs no further way
        frontier = kept(fresh.join(closed.select("u", "v"), ["u", "v"], "left_anti"), "frontier")
        reached = reached.unionByName(frontier)
    rings = found if found is not None else edges.select("u", "v", F.lit(0).cast("long").alias("ring")).filter("1 = 0")
    return rings.select(F.col("u").alias(source), F.col("v").alias(target), "ring")
