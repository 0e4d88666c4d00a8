"""Row order over a whole table without putting it into one task.

A window without PARTITION BY sorts everything in one task, and one PARTITION BY key that holds a
third of the rows is nearly as bad. Here Spark sorts the table over all tasks and writes it once,
each row with a number that tells its task and its place there. What a task's rows need from the
tasks before them is one small row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagscope.session import temporary_folder

_SPAN = 1_000_000
_PLACE_BITS = 33  # of monotonically_increasing_id: the task's number above, the place below


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def sorted_table(df: DataFrame, order_by, ranges: int | None = None, runs_of=(), marks_of=()) -> DataFrame:
    """The rows sorted and written to the shared folder, with ``_range`` and ``_place`` in it.

    The numbers depend on where the sort cut the table, so they are fixed by writing them: every
    later read, and every retry after a lost executor, sees the same ones. While the sorted rows pass, each is compared
    with the one above it in its task: with ``runs_of`` it gets ``_nth``, its 1-based place in the run of equal values, and
    ``_head``, whether that is the task's first run; ``_same_<i>`` says whether column i of ``marks_of`` repeats.
    The folder is removed when the program ends.
    """
    order_by = _names(order_by)
    ordered = df.orderBy(*order_by)
    if ranges:
        ordered = df.repartitionByRange(ranges, *order_by).sortWithinPartitions(*order_by)
    ordered = ordered.withColumn("_id", F.monotonically_increasing_id())
    if runs_of or marks_of:
        ordered = _compared(ordered, list(runs_of), list(marks_of))
    path = temporary_folder(df.sparkSession, "sorted")
    ordered.write.parquet(path)
    table = df.sparkSession.read.schema(ordered.schema).parquet(path)
    place = F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return table.withColumns({"_range": F.shiftright("_id", _PLACE_BITS), "_place": place}).drop("_id")


def _compared(ordered: DataFrame, runs_of: list[str], marks_of: list[str]) -> DataFrame:
    """Sorted rows with the results of comparing each with the row above it; whole Arrow batches, no shuffle."""
    texts = {f"_run_{i}": F.col(c).cast("string") for i, c in enumerate(runs_of)}
    texts |= {f"_mark_{i}": F.col(c).cast("string") for i, c in enumerate(marks_of)}
    made = [T.StructField("_nth", T.LongType()), T.StructField("_head", T.BooleanType())] if runs_of else []
    made += [T.StructField(f"_same_{i}", T.BooleanType()) for i in range(len(marks_of))]
    kept, runs, marks = ordered.columns, [f"_run_{i}" for i in range(len(runs_of))], [f"_mark_{i}" for i in range(len(marks_of))]

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        above: dict[str, pa.Array] = {}  # the last value of each column so far
        nth, head = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            equal = {}
            for name in (*runs, *marks):
                column = batch.column(name)
                before = pa.concat_arrays([above.get(name, pa.nulls(1, column.type)), column.slice(0, batch.num_rows - 1)])
                same = pc.fill_null(pc.equal(column, before), False)
                if name in runs:
                    same = pc.or_(same, pc.and_(pc.is_null(column), pc.is_null(before)))
                equal[name] = np.asarray(same)
                if name not in above:
                    equal[name] = np.concatenate([[name in runs], equal[name][1:]])  # the task's first row begins its first run
                above[name] = column.slice(batch.num_rows - 1, 1)
            columns = [batch.column(c) for c in kept]
            if runs:
                new = ~np.logical_and.reduce([equal[n] for n in runs])
                rows = np.arange(batch.num_rows)
                since = np.maximum.accumulate(np.where(new, rows, -1))  # -1: the run that came over from the batch before
                place = np.where(since < 0, rows + nth, rows - since) + 1
                columns += [pa.array(place, pa.int64()), pa.array(head & (since < 0))]
                nth, head = int(place[-1]), bool(head and since[-1] < 0)
            columns += [pa.array(equal[n]) for n in marks]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(f.name for f in made)])

    return ordered.withColumns(texts).mapInArrow(work, T.StructType([*ordered.schema.fields, *made]))


def number_rows(df: DataFrame, order_by, by=(), name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """1-based row number in ``order_by``, restarting for every ``by``; the order must be total.

    Rows are numbered inside their sorted task. Only the rows of a task's first run (the whole task without ``by``) lack what
    came before, which is one number per task.
    """
    by, order_by = _names(by), _names(order_by)
    if not by:
        table = sorted_table(df, order_by, ranges)
        sizes = table.groupBy("_range").agg(F.count("*").alias("_size"))
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
        offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
        numbered = table.join(F.broadcast(offsets), "_range")  # two numbers per task
        return numbered.select(*df.columns, (F.col("_place") + F.col("_before") + 1).alias(name))
    table = sorted_table(df, [*by, *order_by], ranges, runs_of=by)
    key = F.struct(*by)
    ends = table.groupBy("_range").agg(
        F.min_by(key, "_place").alias("_first"), F.max_by(key, "_place").alias("_last"),
        F.max_by("_nth", "_place").alias("_tail"), F.bool_and("_head").alias("_single"),
    )
    tasks = Window.orderBy("_range")  # one row per task
    goes_on = F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(tasks)), F.lit(False))
    through = goes_on & F.coalesce(F.lag("_single").over(tasks), F.lit(False))
    steps = ends.select("_range", F.when(goes_on, F.lag("_tail").over(tasks)).otherwise(0).alias("_step"), (~through).cast("long").alias("_new"))
    blocks = steps.withColumn("_block", F.sum("_new").over(tasks.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    offsets = blocks.select("_range", F.sum("_step").over(within).alias("_before"))
    numbered = table.join(F.broadcast(offsets), "_range")  # two numbers per task
    return numbered.select(*df.columns, (F.col("_nth") + F.when(F.col("_head"), F.col("_before")).otherwise(0)).alias(name))


def number_by_position(df: DataFrame, pos: str, by, name: str = "seq", span: int = _SPAN, by_has_nulls: bool = True) -> DataFrame:
    """1-based row number per ``by`` in the order of a unique whole-number position.

    Positions are cut into slots of ``span``, so no task sorts more than one slot of one group. A
    group adds up the sizes of its earlier slots; groups within one slot have none to add. Without
    NULLs in ``by`` the rows stay partitioned as the numbering left them.
    """
    by = _names(by)
    rows = df.withColumn("_slot", F.col(pos) - F.pmod(F.col(pos), F.lit(span)))
    local = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_slot").orderBy(pos)).cast("long"))
    groups = [f"_g{i}" for i in range(len(by))]
    sizes = rows.groupBy(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col("_slot").alias("_s")).agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*groups).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.sum("_size").over(earlier)).filter("_before IS NOT NULL").drop("_size")
    same = F.col("_slot") == F.col("_s")
    for c, g in zip(by, groups, strict=True):
        same = same & (F.col(c).eqNullSafe(F.col(g)) if by_has_nulls else F.col(c) == F.col(g))
    joined = local.join(offsets, same, "left")
    return joined.select(*df.columns, (F.col(name) + F.coalesce(F.col("_before"), F.lit(0))).alias(name))


def ditto(df: DataFrame, cols, order_by, mark: str = '"', ranges: int | None = None) -> DataFrame:
    """A non-empty cell equal to the one above it becomes ``mark``; empty text and NULL stay.

    Cells are compared as the sorted rows pass. Only the first row of a task has its upper neighbour in another task; these few rows
    are put right on their own, the rest is read as it was written.
    """
    cols = _names(cols)
    table = sorted_table(df, order_by, ranges, marks_of=cols)

    def shown(rows: DataFrame, same) -> DataFrame:
        out = {}
        for i, c in enumerate(cols):
            text = F.col(c).cast("string")
            out[c] = F.when((text != "") & same(i, c), F.lit(mark)).otherwise(text)
        return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])

    inner = shown(table.filter("_place > 0"), lambda i, c: F.col(f"_same_{i}"))
    last = table.groupBy("_range").agg(F.max_by(F.struct(*cols), "_place").alias("_last"))
    carry = last.select(F.col("_range").alias("_r"), F.lag("_last").over(Window.orderBy("_range")).alias("_above"))  # one row per task
    firsts = table.filter("_place = 0").join(carry, F.col("_range") == F.col("_r"), "left")
    return inner.unionByName(shown(firsts, lambda i, c: F.col(f"_above.{c}").cast("string") == F.col(c).cast("string")))


def head(df: DataFrame, n: int, order_by) -> DataFrame:
    """The first ``n`` rows of an explicit order; each task sends at most ``n`` rows on."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*order_by).limit(n)


def preview(df: DataFrame, order_by, n: int = 100, null_text: str = "NULL") -> DataFrame:
    """At most ``n`` rows as text with a leading row number and NULL spelled out."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    first = head(df, n, order_by)
    number = F.row_number().over(Window.orderBy(*order_by))  # over the n rows only
    return first.select(
        number.alias("#"), *[F.coalesce(F.col(c).cast("string"), F.lit(null_text)).alias(c) for c in df.columns]
    )
