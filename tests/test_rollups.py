import random
from datetime import datetime, timedelta

import fixtures
import pytest

from lagscope.operators import filters, partials, rollups
from lagscope.plans import dashboard, named
from lagscope.streaming import rollups as rollup_streams

BEGIN, END = "2020-04-20 00:00:00", "2020-04-20 23:59:59"


def at(text):
    return datetime.fromisoformat("2020-04-20 " + text)


def test_totals_agree(spark):
    totals = {r.PIPELINE_ID: r.INSERT_COUNT for r in rollups.change_totals(fixtures.history(spark), BEGIN, END).collect()}
    state = {r.PIPELINE_ID: r.INSERT_COUNT for r in fixtures.table_stat(spark).collect()}
    moved = {r.PIPELINE_ID: r["sum(NUMBER)"] for r in fixtures.throughput(spark).groupBy("PIPELINE_ID").sum("NUMBER").collect()}
    assert totals == state == moved == {1: 10100, 3: 10000}


def test_null_source_is_a_group(spark):
    from pyspark.sql import functions as F

    rows = fixtures.history(spark).withColumn("PIPELINE_ID", F.when(F.col("PIPELINE_ID") == 1, F.lit(1)))
    totals = {r.PIPELINE_ID: r.INSERT_COUNT for r in rollups.change_totals(rows, BEGIN, END).collect()}
    assert totals == {1: 10100, None: 10000}


def test_exception_exists(spark):
    log = fixtures.log_records(spark)
    assert [r["count"] for r in rollups.has_exception(log, BEGIN, END).collect()] == [1]
    assert rollups.has_exception(log, BEGIN, "2020-04-20 04:19:23").count() == 0
    per_minute = {r.bucket: r.exceptions for r in rollups.exceptions_per_minute(log).collect()}
    assert per_minute == {at("04:19:00"): 2, at("10:54:00"): 1}


def test_buckets_and_gaps(spark):
    sizes = rollups.bucket_sum(fixtures.throughput(spark), "GMT_MODIFIED", "SIZE", "1 minute", alias="size")
    assert {r.bucket: r.size for r in sizes.collect()} == {at("02:49:00"): 511328, at("02:50:00"): 9713112, at("06:15:00"): 51176}
    rows = rollups.bucket_sum(fixtures.history(spark), "GMT_MODIFIED", "INSERT_COUNT", "1 minute", alias="n")
    assert {r.bucket: r.n for r in rows.collect()} == {at("02:49:00"): 1000, at("02:50:00"): 19000, at("06:15:00"): 100}
    filled = rollups.fill_gaps(sizes, "bucket", "1 minute", at("02:49:00"), at("06:15:35"))
    assert filled.count() == 207 and filled.filter("size IS NOT NULL").count() == 3
    zero = dashboard.throughput(fixtures.throughput(spark), at("02:49:00"), at("06:15:35"), ts="GMT_MODIFIED", col="SIZE")
    got = [r.size for r in zero.collect()]
    assert len(got) == 207 and sum(got) == 10275616
    skip = dashboard.throughput(fixtures.throughput(spark), at("02:49:00"), at("06:15:35"), nulls="skip", ts="GMT_MODIFIED", col="SIZE")
    assert skip.count() == 3


def test_gaps_per_series_and_large_range(spark):
    df = spark.createDataFrame([("a", at("00:00:00"), 1), (None, at("00:02:00"), 2)], "k string, bucket timestamp, v long")
    out = rollups.fill_gaps(df, "bucket", "1 minute", at("00:00:00"), at("00:02:00"), by=["k"])
    assert sorted((r.k or "", r.bucket.minute, r.v) for r in out.filter("v IS NOT NULL").collect()) == [("", 2, 2), ("a", 0, 1)]
    assert out.count() == 6
    wide = rollups.fill_gaps(df, "bucket", "1 second", at("00:00:00"), at("10:00:00"), by=["k"])
    assert wide.count() == 2 * 36001 and wide.select("k", "bucket").distinct().count() == 2 * 36001


def test_intervals():
    assert [rollups.interval_seconds(t) for t in ("1 minute", "5 minutes", "2 hours", "1 day", "30 seconds")] == [60, 300, 7200, 86400, 30]


def test_last_values(spark):
    t = at("00:00:10")
    rows = [(1, "a", t, 5, None), (2, "a", t, None, "x"), (3, "a", at("00:00:50"), None, "y"), (4, "b", at("00:01:00"), 9, None)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, n long, s string")
    overall = rollups.last_value_by(df, ["ts", "id"], ["n", "s"]).first()
    assert (overall.n, overall.s) == (9, "y")
    by = {r.k: (r.n, r.s) for r in rollups.last_value_by(df, ["ts", "id"], ["n", "s"], by=["k"]).collect()}
    assert by == {"a": (5, "y"), "b": (9, None)}
    per = {r.bucket: r.n for r in rollups.last_value_by(df, ["ts", "id"], ["n"], interval="1 minute").collect()}
    assert per == {at("00:00:00"): 5, at("00:01:00"): 9}


def test_strict_filters_and_positions(spark):
    delays = fixtures.delays(spark)
    assert [r.ID for r in filters.newer_than(delays, "GMT_MODIFIED", at("02:50:57")).orderBy("ID").collect()] == [9, 11, 13]
    assert [r.ID for r in filters.after_id(delays, "ID", 9).orderBy("ID").collect()] == [11, 13]
    assert filters.between(delays, "GMT_MODIFIED", at("02:49:57"), at("02:50:57")).count() == 4
    assert filters.time_range(delays, "GMT_MODIFIED", at("04:20:11"), timedelta(minutes=10)).count() == 2
    assert rollups.next_watermark(delays, "GMT_MODIFIED", at("01:00:00")).first().position == at("04:20:11")
    assert rollups.next_watermark(delays, "GMT_MODIFIED", at("23:00:00")).first().position == at("23:00:00")
    assert rollups.next_watermark(delays.filter("ID < 0"), "ID", 4).first().position == 4


def test_wide_record_and_identity(spark):
    rows = [("server_id", "100"), ("log_bin", "abc"), ("other", "x")]
    wide = rollups.flatten_kv(spark.createDataFrame(rows, "name string, value string"), "name", "value", ["server_id", "log_bin", "missing"]).first()
    assert tuple(wide) == ("100", "abc", None)
    nodes = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u1", "b"), ("u2", "c"), (None, "d"), (None, "e")], "uuid string, node string")
    assert [tuple(r) for r in rollups.duplicate_identity(nodes, "uuid", "node").collect()] == [("u1", 2, "a", "b")]
    assert sorted(tuple(r) for r in rollups.identity_members(nodes, "uuid", "node").collect()) == [("u1", "a"), ("u1", "b")]


def test_named_queries(spark):
    queries = named.NamedQueries(spark)
    views = {"table_history_stat": fixtures.history(spark), "log_record": fixtures.log_records(spark), "delay_stat": fixtures.delays(spark),
             "throughput_stat": fixtures.throughput(spark), "table_stat": fixtures.table_stat(spark)}
    out = queries.run("history_totals", views, begin=BEGIN, end=END)
    assert {r.pipeline_id: r.insert_count for r in out.collect()} == {1: 10100, 3: 10000}
    assert queries.run("manager_exception", begin=BEGIN, end=END).count() == 1
    assert queries.run("new_delays", last=at("02:50:57")).count() == 3
    assert queries.run("new_log_records", last=3).count() == 3
    assert {queries.run(q, last=at("02:50:00")).count() for q in ("new_throughput", "changed_totals", "new_history")} == {2, 3}
    queries.register("mine", "SELECT :x + 1 AS y")
    assert queries.run("mine", x=1).first().y == 2
    assert named.check_query(spark).count() == 1


def test_choose_interval():
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rule = {(1, 1440): "60 seconds", (1, 700): "120 seconds", (7, 700): "900 seconds", (30, 700): "3600 seconds", (365, 100): "86400 seconds"}
    assert {k: partials.choose_interval(day(0), day(k[0]), k[1]) for k in rule} == rule
    assert partials.choose_interval("2024-01-01 00:00:00", "2024-01-01 00:01:00", 1000) == "1 seconds"
    assert partials.choose_interval(day(0), day(1), 20000, "1 minute") == "60 seconds"
    assert partials.choose_interval(day(0), day(1), 6000, "7 seconds") == "21 seconds"  # a multiple of what is kept
    with pytest.raises(ValueError, match="at least one"):
        partials.choose_interval(day(0), day(1), 0)


def _points(seed, n):
    random.seed(seed)
    start = at("00:00:00")
    return [(seed * 100_000 + i, random.choice("ab"), start + timedelta(seconds=random.randrange(20_000)) if i % 50 else None,
             random.choice([None, 1, 2, 3]), random.choice([None, 5, 7])) for i in range(n)]


def test_kept_rollup_reads_new_points_only(spark, tmp_path):
    kind = "id long, k string, ts timestamp_ntz, n long, s long"
    spec = partials.RollupSpec("ts", "1 minute", ("n",), ("n",), ("s",), ("id",), ("k",))
    source, folder, points = f"{tmp_path}/points", f"{tmp_path}/rollup", []
    for run, n in enumerate((400, 0, 300, 1)):  # the second run adds no point
        fresh = _points(run, n)
        points += fresh
        if fresh:
            spark.createDataFrame(fresh, kind).coalesce(1).write.mode("append").parquet(source)
        query = rollup_streams.stream_rollup(spark.readStream.schema(kind).parquet(source), spec, folder, available_now=True)
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == n
        if run == 2:
            rollup_streams.fold_rollup(spark, spec, folder)
        whole = spark.createDataFrame(points, kind)
        for interval in ("1 minute", "1 hour", "1 day"):
            want = partials.finished(partials.partials(whole, partials.RollupSpec("ts", interval, ("n",), ("n",), ("s",), ("id",), ("k",))), spec)
            assert sorted(map(str, rollup_streams.kept_rollup(spark, spec, folder, interval).collect())) == sorted(map(str, want.collect()))
    # By hand: one hour of one series.
    mine = [p for p in points if p[1] == "a" and p[2] is not None and p[2].hour == 1]
    last = max((p[2], p[0], p[4]) for p in mine if p[4] is not None)[2]
    row = rollup_streams.kept_rollup(spark, spec, folder, "1 hour").filter("k = 'a' AND hour(bucket) = 1").first()
    assert (row.points, row.sum_n, row.max_n, row.last_s) == (len(mine), sum(p[3] or 0 for p in mine), max(p[3] or 0 for p in mine), last)
    with pytest.raises(ValueError, match="multiple"):
        rollup_streams.kept_rollup(spark, spec, folder, "30 seconds")


def test_kept_rollup_of_nothing(spark, tmp_path):
    kind, spec = "id long, ts timestamp_ntz, n long", partials.RollupSpec("ts", sums=("n",), lasts=("n",), tie=("id",))
    spark.createDataFrame([], kind).coalesce(1).write.parquet(f"{tmp_path}/points")
    for _ in range(2):
        rollup_streams.stream_rollup(spark.readStream.schema(kind).parquet(f"{tmp_path}/points"), spec, f"{tmp_path}/out", available_now=True).awaitTermination()
        assert rollup_streams.fold_rollup(spark, spec, f"{tmp_path}/out") == -1
        got = rollup_streams.kept_rollup(spark, spec, f"{tmp_path}/out", "1 hour")
        assert got.columns == ["bucket", "points", "sum_n", "last_n"] and got.count() == 0
    filled = rollup_streams.panel(spark, spec, f"{tmp_path}/out", "2024-01-01 00:00:00", "2024-01-01 01:59:59", 2)
    assert [r.points for r in filled.collect()] == [None, None]
