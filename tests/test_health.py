import random

import pytest
from pyspark.sql import functions as F

from lagscope.operators import health, ordered, reconcile
from lagscope.schemas import NODE_STATUS, struct_of
from lagscope.sources.stats import gen_rows, read_node_status, read_variables

GOOD = dict(Slave_IO_Running="Yes", Slave_SQL_Running="Yes", Seconds_Behind_Master="0", Last_Errno=0, Last_IO_Error="")


def statuses(spark, *rows):
    schema = struct_of(NODE_STATUS + ", reachable boolean")
    data = [tuple({**GOOD, "reachable": True, **row}.get(f.name) for f in schema.fields) for row in rows]
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(
    "change, errors",
    [
        ({}, 0),
        ({"Seconds_Behind_Master": "61"}, 1),
        ({"Seconds_Behind_Master": "100"}, 1),
        ({"Seconds_Behind_Master": "7"}, 0),
        ({"Seconds_Behind_Master": "60"}, 0),
        ({"Seconds_Behind_Master": "NULL"}, 1),
        ({"Last_Errno": 1062}, 2),
        ({"Slave_IO_Running": "No", "Slave_SQL_Running": "Connecting"}, 2),
        ({"Slave_IO_Running": None, "Slave_SQL_Running": None, "Seconds_Behind_Master": None, "Last_Errno": None}, 4),
        ({"reachable": False}, 1),
        ({"reachable": False, "Last_Errno": 1062}, 3),
    ],
)
def test_node_rules(spark, change, errors):
    row = health.replication_errors(statuses(spark, change)).first()
    assert (row.n_errors, row.ok, len(row.errors)) == (errors, errors == 0, errors)


def test_node_rule_options(spark):
    seven, hundred = statuses(spark, {"Seconds_Behind_Master": "7"}), statuses(spark, {"Seconds_Behind_Master": "100"})
    assert health.replication_errors(seven, lexical_lag=True).first().n_errors == 1
    assert health.replication_errors(hundred, lexical_lag=True).first().n_errors == 0
    missing = statuses(spark, {"Seconds_Behind_Master": None})
    assert health.replication_errors(missing).first().n_errors == 0
    assert health.replication_errors(missing, null_lag_fails=True).first().n_errors == 1
    text = health.replication_errors(statuses(spark, {"Last_Errno": 1062, "Last_Error": "Could not execute"})).first().errors
    assert text == ["Error when processing relay log (Last_Errno = 1062)", "(Last_Error = Could)"]


def test_cluster(spark):
    nodes = {"a:1": statuses(spark, {"Slave_IO_Running": "yes", "Slave_SQL_Running": "YES"}), "b:1": statuses(spark, {})}
    fine = read_node_status(nodes)
    assert [tuple(r) for r in health.cluster_status(fine).collect()] == [(None, "OK")]
    bad = read_node_status({**nodes, "d:1": statuses(spark, {"Last_IO_Error": "lost"}), "c:1": statuses(spark, {"Slave_SQL_Running": None})})
    assert sorted(r.problem for r in health.cluster_status(bad).collect()) == [
        "Address:c:1\nSlaveIoRunning:Yes\nSlaveSQLRunning:\nLastIOError:\n",
        "Address:d:1\nSlaveIoRunning:Yes\nSlaveSQLRunning:Yes\nLastIOError:lost\n"]
    table = health.health_report(bad, "table")
    assert table.columns[:3] == ["#", "Address", "Slave IO State"]
    assert sorted(r["#"] for r in table.collect()) == [1, 2, 3, 4]
    assert health.health_report(fine, "json").first().json.startswith('{"Address":"a:1","SlaveIOState":""')
    assert health.health_report(fine).count() == 1


def test_preview(spark):
    df = spark.createDataFrame([(3, None), (1, "x"), (2, "y")], "k int, v string")
    assert [tuple(r) for r in ordered.preview(df, "k").collect()] == [(1, "1", "x"), (2, "2", "y"), (3, "3", "NULL")]
    assert ordered.preview(gen_rows(spark, 500), "key").count() == 100
    assert [r.key for r in ordered.head(gen_rows(spark, 9), 3, "key").collect()] == [1, 2, 3]


def _skewed(spark, n=3000):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", f"k{rng.randrange(40)}", None]), i, rng.choice(["", "a", "a", "b", None])) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, i long, v string").repartition(7)


@pytest.mark.parametrize("ranges", [1, 2, 8, 50])
def test_row_numbers(spark, ranges):
    rows, df = _skewed(spark)
    got = {r.i: r.row_number for r in ordered.number_rows(df, "i", ranges=ranges).collect()}
    assert got == {i: i + 1 for i in range(len(rows))}
    want, seen = {}, {}
    for g, i, _ in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert {r.i: r.row_number for r in ordered.number_rows(df, ["i"], by=["g"], ranges=ranges).collect()} == want


def test_ranges_are_even_and_groups_are_split(spark):
    _, df = _skewed(spark)
    table = ordered.sorted_table(df, ["g", "i"], 10)
    sizes = [r["count"] for r in table.groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * df.count() / 10
    assert table.filter("g = 'hot'").select("_range").distinct().count() >= 5


@pytest.mark.parametrize("span", [1, 10, 1000, 10**6])
def test_numbers_by_position(spark, span):
    rows, df = _skewed(spark, 1500)
    want, seen = {}, {}
    for g, i, _ in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert {r.i: r.seq for r in ordered.number_by_position(df, "i", ["g"], span=span).collect()} == want


@pytest.mark.parametrize("ranges", [1, 3, 20])
def test_ditto(spark, ranges):
    rows, df = _skewed(spark, 400)
    want, last = {}, object()
    for _, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = '"' if v and v == last else v
        last = v
    assert {r.i: r.v for r in ordered.ditto(df, ["v"], "i", ranges=ranges).collect()} == want


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_numbers_of_groups_with_nulls(spark, ranges):
    rows = [(i, [None, "a", "b"][min(i // 70, 2)], i // 90 or None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, h int")
    want, at = {}, {}
    for i, g, h in rows:
        at[g, h] = at.get((g, h), 0) + 1
        want[i] = at[g, h]
    assert {r.i: r.row_number for r in ordered.number_rows(df, "i", by=["g", "h"], ranges=ranges).collect()} == want


def test_order_needs_no_second_shuffle_and_leaves_nothing(spark):
    import os

    from lagscope import session

    df = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("g"))
    auto, adaptive = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (ordered.number_rows(df, "id", by=["g"]), ordered.ditto(df, ["g"], "id")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            assert not any("hashpartitioning(g" in line for line in shuffled)
            # what is shuffled by task is what aggregates or first rows leave: one row per task
            assert len(shuffled) <= 4 and out.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    left = {p for p in session._temporary if os.path.isdir(p)}
    assert left
    session.remove_temporary(spark)
    assert not any(os.path.isdir(p) for p in left)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, i long, v string")
    assert ordered.number_rows(empty, "i").count() == 0 and ordered.ditto(empty, ["v"], "i").count() == 0


def test_reconcile_counts(spark):
    a, b = gen_rows(spark, 100), gen_rows(spark, 200).filter("key > 100")
    assert tuple(reconcile.reconcile_counts(a, b).first()) == (100, 100, 0, True)
    assert tuple(reconcile.reconcile_counts(a.unionAll(b), a).first()) == (200, 100, 100, False)


def test_reconcile_rows(spark):
    a = [(1, "x", None), (2, "y", 1), (3, None, "z"), (4, "d", 0), (4, "d", 0), (5, "e", 0), (5, "f", 0), (None, "n", 1)]
    b = [(1, "x", None), (2, "y", 2), (3, "z", None), (4, "d", 0), (5, "f", 0), (5, "e", 0), (6, "g", 0), (None, "n", 1)]
    kind = "k long, s string, t string"
    rows = [(k, s, None if t is None else str(t)) for k, s, t in a], [(k, s, None if t is None else str(t)) for k, s, t in b]
    out = reconcile.reconcile_rows(spark.createDataFrame(rows[0], kind), spark.createDataFrame(rows[1], kind), ["k"])
    assert {r.k: r.status for r in out.collect()} == {2: "differs", 3: "differs", 4: "differs", 6: "only_b"}
    both = reconcile.reconcile_rows(gen_rows(spark, 200), gen_rows(spark, 200), ["key"])
    assert both.count() == 0


def test_reconcile_other_types(spark):
    a = spark.createDataFrame([(1, 2, "1.5")], "k int, v int, d string").withColumn("d", F.col("d").cast("decimal(6,2)"))
    b = spark.createDataFrame([(1, 2, "1.5")], "k bigint, v bigint, d string").withColumn("d", F.col("d").cast("decimal(9,4)"))
    assert reconcile.reconcile_rows(a, b, ["k"]).count() == 0
    assert [tuple(r) for r in reconcile.reconcile_rows(a, b.withColumn("v", F.lit(3)), ["k"]).collect()] == [(1, "differs")]
    with pytest.raises(ValueError, match="int on one side"):
        reconcile.reconcile_rows(a, b.withColumn("v", F.lit("2")), ["k"])
    m = spark.createDataFrame([(1, {"a": 1, "b": 2})], "k int, m map<string,int>")
    n = spark.createDataFrame([(1, {"b": 2, "a": 1})], "k int, m map<string,int>")
    assert reconcile.reconcile_rows(m, n, ["k"]).count() == 0


def test_variables(spark):
    df = spark.createDataFrame([("server_id", "1")], "Variable_name string, Value string")
    assert [tuple(r) for r in read_variables(df).collect()] == [("server_id", "1")]


def _replicas(spark, changed):
    """Two replicas of 100,000 rows with far-apart keys; ``changed`` picks the rows that differ in the second."""
    a = spark.range(100_000).selectExpr("id * 7919 - 50000000 AS k", "id % 13 AS v", "cast(id % 5 AS string) AS w")
    return a, a.withColumn("v", F.when(F.expr(changed), F.lit(-1)).otherwise(F.col("v")))


def test_reconcile_ranges_reads_what_differs(spark, tmp_path):
    a, b = _replicas(spark, "k BETWEEN 1000000 AND 1200000 OR k BETWEEN 400000000 AND 400100000")
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    left = reconcile.unlike_ranges(a, b, ["k"], fanout=64, leaf_rows=10)
    assert 2 <= len(left.spans) <= 256 and not left.nulls
    assert a.filter(left.of("k")).count() < 200  # of 100,000; 39 differ
    got = reconcile.reconcile_ranges(a, b, ["k"], fanout=64, leaf_rows=10)
    assert "PushedFilters: [Or(" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reconcile.reconcile_rows(a, b, ["k"]).collect()))


@pytest.mark.parametrize("changed,most", [("false", 1), ("true", 20), ("k % 3 = 0", 3), ("k < -49990000", 20)])
def test_reconcile_ranges_equals_rows(spark, changed, most):
    a, b = (df.limit(1000).coalesce(1) for df in _replicas(spark, changed))
    more = spark.createDataFrame([(None, 1, "x"), (2**63 - 1, 2, "y"), (-(2**63), 2, "y"), (5, None, None)], "k long, v long, w string").coalesce(1)
    for one, two in ((a.unionAll(more), b), (a.unionAll(more), b.unionAll(more).unionAll(more)), (a.limit(0), b)):
        want = sorted(map(str, reconcile.reconcile_rows(one, two, ["k"]).collect()))
        assert sorted(map(str, reconcile.reconcile_ranges(one, two, ["k"], fanout=16, leaf_rows=5, most=most).collect())) == want


def test_reconcile_ranges_of_nothing(spark):
    none = spark.createDataFrame([], "k int, v string")
    assert reconcile.unlike_ranges(none, none, ["k"]) == reconcile.Ranges((), False)
    assert reconcile.reconcile_ranges(none, none, ["k"]).count() == 0
    with pytest.raises(ValueError, match="whole number"):
        reconcile.reconcile_ranges(none, none, ["v"])
