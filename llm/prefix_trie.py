"""Trie of the common beginnings of conversations, built as burst tries.

Conversations are ordered by turn (null first; equal turns by the first letters of role and text, then by a digest of both).
A null role or text is empty. With ``share`` set, conversation c is rebuilt from the first h turns of conversation ``c - c % 20``
and its own turns after its first h, h = unsigned crc32(decimal c) % 4; ``%`` keeps the sign as in SQL.

1. A turn's id is a 128-bit hash of depth, role and text; the exclusive or of the ids along a path names its node, so a node's
   name is known without its ancestors. Long conversations are cut into slabs of ``slab`` turns, and each slab
   starts at the node in which the one before it ends. Equal slabs of a node become one suffix with its number of members.
2. All suffixes below one head are a container. A container of more than ``burst`` turns bursts by next turn id: each child node
   becomes a head with its own container, and so on until none is oversized. Equal suffixes are one, so copies do not count.
3. Containers are dealt to shards. A shard sorts its containers and sweeps them into nodes: a node is pushed where a suffix
   leaves the one before it and popped, with its subtree complete, where a later one leaves it.
4. Burst heads, and slabs from the last to the first, add up what their containers found below them. Rounds follow the depth
   of oversized containers and the slabs of the longest conversation.
5. Ids that end in a node are sorted over all tasks and hashed as a stream of packed chunks.

Nulls: rows without conversation id are left out. Repeated rows are turns of their own. An empty table gives an empty result, without
root. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagscope.operators.ordered import number_rows
from llm.common import binary, folders, forget, group_arrow, map_arrow, partitions, saved

SLAB, BURST = 1024, 1 << 18
_WORD = r"[^\x20\x09-\x0D]+"
_ID = 16
_ROOT = b"\0" * _ID
_CHUNK = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()
_SUFFIX = "slab int, start binary, ending binary, ended boolean, rep long, path binary, words array<long>"
_NODE = "node binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def _share(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("long")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Own turns: conv, n (from 1), key (digest of role and text), words of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.left(role, F.lit(32)).alias("role"), F.left(text, F.lit(64)).alias("begin"),
        F.unhex(F.md5(F.concat_ws(":", F.char_length(role), role, text))).alias("key"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    return number_rows(rows, ["turn", "role", "begin", "key"], by="conv", name="n").select("conv", "n", "key", "words")


def rebuilt_turns(own: DataFrame, share: bool) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, key, words, length) of the rebuilt conversations, and every conversation with its length."""
    convs = own.groupBy("conv").agg(F.max("n").alias("own"))
    if not share:
        lengths = convs.withColumn("length", F.col("own"))
        return own.join(lengths, "conv").select("conv", F.col("n").alias("depth"), "key", "words", "length"), lengths.select("conv", "length")
    first = own.filter("conv % 20 = 0 AND n <= 3")
    lent = first.groupBy(F.col("conv").alias("_lender")).agg(F.max("n").alias("_lent"))
    info = convs.withColumn("lender", F.col("conv") - F.col("conv") % 20).withColumn("h", F.when(F.col("conv") == F.col("lender"), 0).otherwise(_share(F.col("conv"))))
    info = info.join(lent, F.col("lender") == F.col("_lender"), "left").withColumn("taken", F.least("h", F.coalesce("_lent", F.lit(0))))
    info = info.select("conv", "lender", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    kept = own.join(info, "conv").filter("n > h").select("conv", (F.col("n") - F.col("h") + F.col("taken")).alias("depth"), "key", "words", "length")
    begin = first.select(F.col("conv").alias("_from"), F.col("n").alias("depth"), "key", "words")
    taken = info.filter("taken > 0").join(begin, F.col("lender") == F.col("_from")).filter("depth <= taken").select("conv", "depth", "key", "words", "length")
    return kept.unionByName(taken), info.select("conv", "length")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the nodes along each slab."""
    for batch in batches:
        turns = batch.column("turns")
        at = np.asarray(turns.offsets).astype(np.int64) - turns.offsets[0].as_py()
        flat = turns.flatten()
        ids = np.stack([np.asarray(flat.field("x")), np.asarray(flat.field("y"))], 1) if len(flat) else np.zeros((0, 2), np.int64)
        base = np.stack([np.asarray(batch.column("bx")), np.asarray(batch.column("by"))], 1)
        paths = [np.bitwise_xor.accumulate(ids[s:e], axis=0) ^ b for s, e, b in zip(at, at[1:], base)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("slab"), binary([b.tobytes() for b in base]), binary([p[-1].tobytes() for p in paths]), batch.column("ended"), batch.column("conv"),
                binary([p.tobytes() for p in paths]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat.field("words")),
            ],
            names=["slab", "start", "ending", "ended", "rep", "path", "words"],
        )


def suffixes(turns: DataFrame, lengths: DataFrame, slab: int, slabs: int) -> DataFrame:
    """One row per conversation and slab; a conversation without turns ends at the root."""
    number = F.floor((F.col("depth") - 1) / slab).cast("int")
    named = turns.select(
        "conv", "depth", "words", "length", number.alias("slab"), F.xxhash64(F.lit(1), "depth", "key").alias("x"), F.xxhash64(F.lit(2), "depth", "key", F.hex("key")).alias("y")
    )
    cut = named.groupBy("conv", "slab").agg(
        F.sort_array(F.collect_list(F.struct("depth", "x", "y", "words"))).alias("turns"), F.max("length").alias("length"), F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty")
    )
    earlier = Window.partitionBy("conv").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    base = [F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)) if slabs > 1 else F.lit(0).cast("long") for c in ("tx", "ty")]
    rows = cut.select("conv", "slab", "turns", base[0].alias("bx"), base[1].alias("by"), (F.ceil(F.col("length") / slab) - 1 == F.col("slab")).alias("ended"))
    none = lengths.filter("length = 0").select(
        F.lit(0).alias("slab"), F.lit(bytearray(_ROOT)).alias("start"), F.lit(bytearray(_ROOT)).alias("ending"), F.lit(True).alias("ended"), F.col("conv").alias("rep"),
        F.lit(bytearray(b"")).alias("path"), F.expr("cast(array() AS array<long>)").alias("words"),
    )
    return map_arrow(rows, _paths, _SUFFIX).unionByName(none)


def _sweep_container(depth: int, least: int | None, rows: list[tuple], out: list[list]) -> list:
    """Appends the container's nodes to ``out``; returns what lies below the head: [kids, leaves, saved]. ``least``: a member of the head."""
    base = len(out)
    top = [None, 0, least, None, 0, 0, 0, 0]  # the head: only its members' smallest id and what is below it count
    stack, above = [(top, 0)], b""
    parents: list[int] = []

    def pop() -> None:
        node, words = stack.pop()
        if not node[5]:
            node[6] = 1
        node[7] += (node[4] - 1) * words
        parent = stack[-1][0]
        parent[4] += node[4]
        parent[6] += node[6]
        parent[7] += node[7]
        parent[2] = node[2] if parent[2] is None else min(parent[2], node[2])

    places = [-1]
    for path, words, n, rep, below in rows:
        size = len(path) // _ID
        same = 0
        while same < size and path[same * _ID : same * _ID + _ID] == above[same * _ID : same * _ID + _ID]:
            same += 1
        while len(stack) > same + 1:
            pop()
            places.pop()
        for k in range(same, size):
            node = [path[k * _ID : k * _ID + _ID], depth + k + 1, None, None, 0, 0, 0, 0]
            stack[-1][0][5] += 1
            parents.append(places[-1])
            places.append(len(out) - base)
            stack.append((node, words[k]))
            out.append(node)
        last = stack[-1][0]
        last[4] += n
        last[2] = rep if last[2] is None else min(last[2], rep)
        for k, more in enumerate(below):
            last[5 + k] += more
        above = path
    while len(stack) > 1:
        pop()
    for node, parent in zip(out[base:], parents):
        node[3] = top[2] if parent < 0 else out[base + parent][2]
    return [top[5], top[6], top[7]]


def _sweep(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by([("head", "ascending"), ("path", "ascending")])
    columns = [table.column(c).to_pylist() for c in ("head", "depth", "path", "words", "n", "rep", "kids", "leaves", "saved", "least")]
    out: list[list] = []
    heads: list[list] = []
    row = 0
    while row < len(columns[0]):
        stop = row
        while stop < len(columns[0]) and columns[0][stop] == columns[0][row]:
            stop += 1
        head, depth = columns[0][row], columns[1][row]
        rows = [(columns[2][i], columns[3][i], columns[4][i], columns[5][i], (columns[6][i], columns[7][i], columns[8][i])) for i in range(row, stop)]
        heads.append([head, None, None, None, None, *_sweep_container(depth, columns[9][row], rows, out)])
        row = stop
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, *heads), [pa.binary(), *[pa.int64()] * 7])], names=_NAMES)


def _containers(entries: DataFrame, before: DataFrame | None, below: DataFrame | None, start: int, burst: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the heads of one slab's suffixes, and the heads' sums (node, kids, leaves, saved).

    ``before`` has the suffixes of the slab before, some of which end in these heads for good; ``below`` has the sums of the next slab's
    heads, in which the unfinished suffixes end.
    """
    zero = F.lit(0).cast("long")
    if below is None:
        current = entries.withColumns({"kids": zero, "leaves": zero, "saved": zero})
    else:
        sums = below.select(F.col("node").alias("_node"), "kids", "leaves", "saved")
        current = entries.join(sums, (F.col("ending") == F.col("_node")) & ~F.col("ended"), "left").na.fill(0, ["kids", "leaves", "saved"])
    if before is None:
        current = current.withColumn("least", F.lit(None).cast("long"))
    else:
        current = current.join(before.groupBy(F.col("ending").alias("_end")).agg(F.min("rep").alias("least")), F.col("start") == F.col("_end"))
    left = F.octet_length("path") / _ID
    current = current.select(F.col("start").alias("head"), F.lit(start).cast("long").alias("depth"), "path", "words", "n", "rep", "kids", "leaves", "saved", "least")
    final, levels, stops = [], [], []
    while True:
        sizes = current.groupBy("head").agg(F.sum(left).alias("size"), F.count("*").alias("_k")).filter(f"size > {burst} AND _k > 1").select(F.col("head").alias("_big"))
        marked = saved(current.join(sizes, F.col("head") == F.col("_big"), "left"), "containers")
        rest, big = marked.filter("_big IS NULL").drop("_big"), marked.filter("_big IS NOT NULL").drop("_big")
        final.append(rest)
        if big.isEmpty():
            break
        stops.append(big.filter(left == 0).select(F.col("head").alias("node"), "kids", "leaves", "saved"))
        least = big.groupBy(F.col("head").alias("_h")).agg(F.min(F.least("rep", "least")).alias("parent_conv_id"))
        onward = big.filter(left > 0).withColumn("next", F.expr(f"substring(path, 1, {_ID})"))
        heads = onward.groupBy("head", "next").agg(F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.first(F.col("words")[0]).alias("_words"), F.first("depth").alias("_depth"))
        heads = heads.join(least, F.col("head") == F.col("_h")).select(
            F.col("next").alias("node"), (F.col("_depth") + 1).alias("depth"), "conv_id", "parent_conv_id", "n_convs", "_words", F.col("head").alias("_parent")
        )
        levels.append(saved(heads, "heads"))
        current = onward.select(
            F.col("next").alias("head"), (F.col("depth") + 1).alias("depth"), F.expr(f"substring(path, {_ID + 1})").alias("path"), F.expr("slice(words, 2, greatest(size(words) - 1, 0))").alias("words"),
            "n", "rep", "kids", "leaves", "saved", F.lit(None).cast("long").alias("least"),
        )
    everything = final[0]
    for more in final[1:]:
        everything = everything.unionByName(more)
    turns = everything.agg(F.sum(left + 1).cast("long")).first()[0] or 0
    shards = max(partitions(entries.sparkSession), -(-turns // burst))
    swept = saved(group_arrow(everything.withColumn("shard", F.pmod(F.xxhash64("head"), F.lit(shards))), ["shard"], _sweep, _NODE), "swept")
    nodes = swept.filter("depth IS NOT NULL")
    sums = swept.filter("depth IS NULL").select("node", F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    for more in stops:
        sums = sums.unionByName(more)

    def added(df: DataFrame) -> DataFrame:
        return df.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")])

    for heads in reversed(levels):
        own = added(sums).withColumnRenamed("node", "_node")
        done = heads.join(own, F.col("node") == F.col("_node"), "left").na.fill(0, ["kids", "leaves", "saved"])
        done = saved(
            done.select(
                "node", "depth", "conv_id", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"),
                (F.col("saved") + (F.col("n_convs") - 1) * F.col("_words")).alias("saved_tokens"), "_parent",
            ),
            "heads",
        )
        nodes = nodes.unionByName(done.drop("_parent"))
        up = done.groupBy(F.col("_parent").alias("node")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        sums = sums.unionByName(up)
    return nodes, added(sums)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node in a row, in order, packed."""
    node, ids = None, []
    rows: list[tuple] = []
    for batch in batches:
        for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
            if own != node or len(ids) == _CHUNK:
                if ids:
                    rows.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = own, []
            ids.append(conv)
        yield _rows(rows)
        rows = []
    if ids:
        yield _rows([(node, ids[0], ",".join(map(str, ids)))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    node, first, text = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], names=["node", "first", "ids"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["_node", "ends_sha256"])

    for batch in batches:
        for own, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if own != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield flush()
        done = []
    if node is not None:
        done.append((node, state.hexdigest()))
        yield flush()


def ends_of(rows: DataFrame) -> DataFrame:
    """Per node the hash of the ids (node, conv) that end in it. A huge node passes as chunks, never whole."""
    count = partitions(rows.sparkSession)
    ordered = rows.repartitionByRange(count, "node", "conv").sortWithinPartitions("node", "conv")
    packed = map_arrow(ordered, _chunks, "node binary, first long, ids string")
    return map_arrow(packed.repartition(count, "node").sortWithinPartitions("node", "first"), _hash, "_node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, share: bool = False, slab: int = SLAB, burst: int = BURST) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    lasting = folders()
    rebuilt, lengths = rebuilt_turns(numbered_turns(turns), share)
    lengths = saved(lengths, "lengths")
    longest = lengths.agg(F.max("length")).first()[0]
    slabs = max(1, -(-(longest or 0) // slab))
    rows = saved(suffixes(rebuilt, lengths, slab, slabs), "suffixes")
    entries = saved(
        rows.groupBy("slab", "start", "ending", "ended").agg(F.count("*").alias("n"), F.min("rep").alias("rep"), F.first("path").alias("path"), F.first("words").alias("words")), "entries"
    )
    below, nodes = None, None
    for k in reversed(range(slabs)):
        before = entries.filter(F.col("slab") == k - 1) if k else None
        found, below = _containers(entries.filter(F.col("slab") == k), before, below, k * slab, burst)
        below = saved(below, "sums")
        nodes = found if nodes is None else nodes.unionByName(found)
    everyone = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(F.lit(bytearray(_ROOT)).alias("node"), "*")
    both = everyone.unionByName(below.withColumnRenamed("saved", "saved_tokens"), allowMissingColumns=True).groupBy("node").agg(*[F.max(c).alias(c) for c in ("conv_id", "n_convs", "kids", "leaves", "saved_tokens")])
    root = both.filter("n_convs IS NOT NULL").select(
        "node", F.lit(0).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"),
        F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"), "saved_tokens",
    )
    ends = ends_of(rows.filter("ended").select(F.col("ending").alias("node"), F.col("rep").alias("conv")))
    out = nodes.unionByName(root).join(ends, F.col("node") == F.col("_node"), "left").select("conv_id", "depth", *_NAMES[3:], F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    scratch = folders() - lasting
    result = saved(out, "trie")
    forget(scratch)
    return result
