"""Shards from a weighted hash tree of regions, racks and shards, in DataFrame functions only.

A row descends the tree by its key alone: at each level every child draws ``-ln(u) / weight`` with u hashed from key and
child, and the smallest draw wins; an inner node weighs what its shards weigh. So a child gets its share of the rows,
and a changed weight moves rows only into or out of the subtree that holds it. A shard that is added as a region of
its own takes rows only into itself; within an old region it would also stir the rows that this region gains.

Slots number the rows of a shard from 0 without gaps, in key order. The rows (not their texts) are dealt by ranges of shard, key, checksum
and place in the input, which are quantiles of the data, and written once in that order; then a row's slot is its place in its range plus the
rows of the shard in the ranges before. So no task sorts a whole shard, however sparse the keys are or however often one of them occurs.

Nulls: a row without key is hashed as the empty text and comes first in its shard. A null text has size 1 and the
checksum of nothing. Repeated keys share a shard and get neighbouring slots, by checksum. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import saved

Tree = dict[str, dict[str, dict[int, float]]]  # region -> rack -> shard -> weight
_RANGE = 33  # fixed value: the bits of an increasing id below its partition's number


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Equal weights: ``per_rack`` shards a rack, ``racks`` racks a region."""
    tree: Tree = {}
    for s in range(shards):
        region, rack = s // (per_rack * racks), s // per_rack
        tree.setdefault(f"g{region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region and a rack of its own."""
    return {**tree, f"g+{shard}": {f"k+{shard}": {shard: weight}}}


def draw(key: Column, node: str, weight: float) -> Column:
    """52 bits of the MD5 of node and key as u in (0, 1), then -ln(u) / weight."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(node + "|"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _smallest(draws: list[tuple[Column, Column]]) -> Column:
    """The value of the smallest draw; the first of equal ones."""
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (d, v) in enumerate(draws)]))["v"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a text key."""
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(draw(key, f"{region}/{rack}/{s}", w), F.lit(s)) for s, w in shards.items()]
            inner.append((draw(key, f"{region}/{rack}", sum(shards.values())), _smallest(leaves)))
        weight = sum(w for shards in racks.values() for w in shards.values())
        regions.append((draw(key, region, weight), _smallest(inner)))
    return _smallest(regions)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    tree = tree or even_tree(shards)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    placed = rows.select(
        "*", F.lit("key").alias("law"), place(key, tree).cast("int").alias("shard"), place(key, grown(tree, shards)).cast("int").alias("grown_shard")
    )
    return numbered(placed).select(F.col("_id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def numbered(placed: DataFrame) -> DataFrame:
    """Rows with ``shard``, ``_id`` and ``text_crc32`` get a ``slot``: 0, 1, 2 ... in each shard, in the order of id and checksum, nulls first."""
    order = ["shard", "_id", "text_crc32", "_place"]
    dealt = placed.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    table = saved(dealt.drop("_place").withColumn("_at", F.monotonically_increasing_id()), "shards")
    within = F.shiftright("_at", _RANGE).alias("_range")
    sizes = table.groupBy("shard", within).agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task, and one more per shard: small whatever the input.
    starts = sizes.select(F.col("shard").alias("_s"), "_range", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = (F.col("shard") == F.col("_s")) & (F.shiftright("_at", _RANGE) == F.col("_range"))
    return table.join(F.broadcast(starts), same).withColumn("slot", F.col("_at") + F.col("_shift"))
