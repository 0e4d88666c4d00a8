"""Polled tables, nodes and transaction id sets."""

import random
import sqlite3
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagscope.operators import gtid
from lagscope.operators.health import replication_errors
from lagscope.sources.nodes import read_nodes
from lagscope.sources.polled import DbTable, ParquetTable, read_polled, saved_positions

ROWS = T.StructType().add("id", "long").add("ts", "string").add("size", "long")


def _start(rows, out, checkpoint):
    return rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()


def _database(path, rows):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE IF NOT EXISTS stat (id INTEGER, ts TEXT, size INTEGER)")
        db.executemany("INSERT INTO stat VALUES (?, ?, ?)", rows)


def _second(n):
    return str(datetime(2024, 1, 1) + timedelta(seconds=n))


@pytest.mark.parametrize("by_id", [True, False])
def test_two_runs_are_one(spark, tmp_path, by_id):
    path = str(tmp_path / "stat.db")
    table = DbTable(lambda: sqlite3.connect(path), "stat", "id" if by_id else "ts", ("id", "ts", "size"), mark="?")
    rows = [(i, _second(i), i * 10) for i in range(1, 101)]
    for name, cuts in (("once", [100]), ("often", [30, 30, 31, 100])):
        (tmp_path / "stat.db").unlink(missing_ok=True)
        done = 0
        for cut in cuts:
            _database(path, rows[done:cut])
            done = cut
            _start(read_polled(spark, table, ROWS, by_id=by_id), tmp_path / name, tmp_path / f"{name}-cp").awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect())) == rows
    saved = saved_positions(spark, str(tmp_path / "often-cp")).orderBy("batch").collect()
    want = [30, 31, 100]
    assert [r.position for r in saved] == [str(n) if by_id else _second(n) for n in want] and all(r.done for r in saved)


def test_rows_of_one_second_and_overlap(spark, tmp_path):
    path = str(tmp_path / "stat.db")
    table = DbTable(lambda: sqlite3.connect(path), "stat", "ts", ("id", "ts", "size"), mark="?")
    _database(path, [(1, _second(5), 0), (2, _second(9), 0)])
    for name, overlap in (("strict", None), ("overlap", timedelta(seconds=1))):
        _start(read_polled(spark, table, ROWS, overlap=overlap), tmp_path / name, tmp_path / f"{name}-cp").awaitTermination()
    _database(path, [(3, _second(9), 0), (4, _second(12), 0)])
    found = {}
    for name, overlap in (("strict", None), ("overlap", timedelta(seconds=1))):
        _start(read_polled(spark, table, ROWS, overlap=overlap), tmp_path / name, tmp_path / f"{name}-cp").awaitTermination()
        found[name] = sorted({r.id for r in spark.read.parquet(str(tmp_path / name)).collect()})
    assert found == {"strict": [1, 2, 4], "overlap": [1, 2, 3, 4]}


def test_a_batch_that_died_is_read_again(spark, tmp_path):
    path = str(tmp_path / "stat.db")
    _database(path, [(i, _second(i), i) for i in range(1, 21)])
    broken = DbTable(lambda: sqlite3.connect(path), "stat", "id", ("id", "ts", "size / nothing"), mark="?")
    sound = DbTable(lambda: sqlite3.connect(path), "stat", "id", ("id", "ts", "size"), mark="?")
    with pytest.raises(Exception, match="nothing"):
        _start(read_polled(spark, broken, ROWS, by_id=True), tmp_path / "out", tmp_path / "cp").awaitTermination()
    assert [(r.position, r.done) for r in saved_positions_or_none(spark, tmp_path)] == [("20", False)]
    _database(path, [(99, _second(99), 99)])  # waits for a batch of its own, behind the one that is repeated
    for want in ([*range(1, 21)], [*range(1, 21), 99]):
        _start(read_polled(spark, sound, ROWS, by_id=True), tmp_path / "out", tmp_path / "cp").awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    assert [r.position for r in saved_positions(spark, str(tmp_path / "cp")).orderBy("batch").collect()] == ["20", "99"]


def saved_positions_or_none(spark, tmp_path):
    (tmp_path / "cp" / "commits").mkdir(exist_ok=True)
    return saved_positions(spark, str(tmp_path / "cp")).collect()


def test_polled_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = T.StructType.fromDDL("id long, ts timestamp_ntz")
    table = ParquetTable(str(tmp_path / "in"), "id", ("id", "ts"))
    for n in range(3):
        ids = list(range(10 * n, 10 * n + 10))
        pq.write_table(pa.table({"ts": pa.array([datetime(2024, 1, 1, 0, 0, i) for i in ids], pa.timestamp("us")), "id": ids}), tmp_path / "in" / f"{n}.parquet")
        _start(read_polled(spark, table, schema, by_id=True, start=-1), tmp_path / "out", tmp_path / "cp").awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10 * n + 10))


def test_nodes_that_do_not_answer_are_rows(spark):
    def fetch(address):
        if address.startswith("n13:"):
            raise TimeoutError("no answer")
        return [] if address.startswith("n14:") else [{"Slave_IO_Running": "Yes", "Slave_SQL_Running": "Yes", "Last_Errno": 0, "other": 1}]

    schema = T.StructType.fromDDL("Slave_IO_Running string, Slave_SQL_Running string, Last_Errno int, Last_Error string, Seconds_Behind_Master string")
    many = read_nodes(spark, [f"n{i}:3306" for i in range(2000)], fetch, schema, per_task=50)
    few = read_nodes(spark, ["n1:3306", "n13:3306"], fetch, schema)
    size = lambda df: df._jdf.queryExecution().executedPlan().treeString().count("\n")
    assert size(many) == size(few) and few.rdd.getNumPartitions() == 2
    rows = {r.address: r for r in many.collect()}
    assert len(rows) == 2000 and [a for a, r in rows.items() if not r.reachable] == ["n13:3306"]
    assert rows["n13:3306"].error == "TimeoutError: no answer" and rows["n14:3306"].Slave_IO_Running is None
    bad = {r.address: r.errors for r in replication_errors(few).collect() if not r.ok}
    assert list(bad) == ["n13:3306"] and "connect" in bad["n13:3306"][0]
    assert read_nodes(spark, [], fetch, schema).count() == 0
    with pytest.raises(ValueError):
        read_nodes(spark, [], fetch, T.StructType.fromDDL("address string"))


def _numbers(rows):
    return {(*r[:-2], n) for r in rows for n in range(r[-2], r[-1] + 1)}


def test_sets_of_transaction_ids(spark):
    rnd = random.Random(2)

    def some(n):
        return [(f"S{rnd.randrange(3)}", a, a + rnd.randrange(6)) for a in (rnd.randrange(1, 90) for _ in range(n))]

    one, two = some(25), some(25)
    text = lambda rows: ", ".join(f"{s}:{a}" if a == b else f"{s}:{a}-{b}" for s, a, b in rows)
    table = spark.createDataFrame([(1, text(one)), (2, text(two)), (3, None), (4, ""), (5, "s:1-5,bad,s:9-7,s:0,t:3")], "server int, gtid_set string")
    sets = gtid.gtid_intervals(table, keys=["server"])
    assert sorted(r.reject for r in sets.filter("reject IS NOT NULL").collect()) == ["bad", "s:0", "s:9-7"]
    good = sets.filter("reject IS NULL").drop("reject")
    by = lambda k: good.filter(F.col("server") == k).drop("server")
    a, b = _numbers((s.lower(), x, y) for s, x, y in one), _numbers((s.lower(), x, y) for s, x, y in two)
    own = by(1).orderBy("source", "first").collect()
    assert _numbers(map(tuple, own)) == a
    assert all(p.source != q.source or p.last + 1 < q.first for p, q in zip(own, own[1:]))  # merged: a gap between any two
    for got, want in ((gtid.subtract_intervals(by(1), by(2)), a - b), (gtid.intersect_intervals(by(1), by(2)), a & b), (gtid.union_intervals(by(1), by(2)), a | b)):
        assert _numbers(map(tuple, got.collect())) == want
    assert tuple(gtid.contains_intervals(by(1), by(2)).first()) == (not b - a, len(b - a))
    assert tuple(gtid.contains_intervals(gtid.union_intervals(by(1), by(2)), by(2)).first()) == (True, 0)
    again = gtid.gtid_intervals(gtid.gtid_text(good, ["server"]), keys=["server"]).drop("reject")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, good.collect()))
    assert gtid.gtid_text(by(5)).first().gtid_set == "s:1-5,t:3"


def test_executed_sets_of_many_slots(spark, monkeypatch):
    monkeypatch.setattr(gtid, "_SPAN", 10)
    events = spark.range(1, 500).filter("id % 77 <> 5").selectExpr("concat('U:', id) AS gtid").unionByName(spark.createDataFrame([(None,), ("odd",), ("u:7",)], "gtid string"))
    got = [tuple(r) for r in gtid.executed_intervals(events).orderBy("first").collect()]
    assert got[0] == ("u", 1, 4) and got[1] == ("u", 6, 81) and _numbers(got) == {("u", n) for n in range(1, 500) if n % 77 != 5}


def test_a_set_of_many_intervals_in_one_text(spark):
    ends = {n: n + n % 3 for n in range(1, 80_000, 4)}
    pieces = ":".join(f"{a}-{b}" if b > a else f"{a}" for a, b in ends.items())
    rows = [(1, f"Long:{pieces}, other:7"), (2, f"Long:{pieces}:9-8:0"), (3, f"Long:{pieces}:"), (4, f"Long:x:{pieces}")]
    table = spark.createDataFrame(rows, "server int, gtid_set string")
    sets = gtid.gtid_intervals(table, keys=["server"]).cache()
    want = {(s, "long", a, b) for s in (1, 2) for a, b in ends.items()} | {(1, "other", 7, 7)}
    good = [tuple(r)[:4] for r in sets.filter("reject IS NULL").collect()]
    assert len(good) == len(want) and set(good) == want
    bad = [tuple(r) for r in sets.filter("reject IS NOT NULL").collect()]
    assert sorted(bad) == [(s, None, None, None, rows[s - 1][1]) for s in (2, 3, 4)]
    sets.unpersist()


def test_history_gives_every_snapshot_back(spark):
    from lagscope.operators.history import as_of, deleted_rows, validity_intervals

    rnd = random.Random(3)
    days = [datetime(2024, 1, 1 + d) for d in (0, 1, 2, 5, 6, 9)]
    state, rows = {}, []
    for day in days:
        for k in (None, *range(12)):
            draw = rnd.random()
            if draw < 0.2:
                state.pop(k, None)
            elif draw < 0.6:
                state[k] = rnd.choice(["a", "b", None])
        rows += [(k, v, day) for k, v in state.items()] + [(k, v, day) for k, v in list(state.items())[:1]]  # one row twice
    table = spark.createDataFrame(rows, "k long, v string, at timestamp")
    intervals = validity_intervals(table, ["k"], "at")
    for n, day in enumerate(days):
        for later in (day, day + timedelta(hours=5)):
            assert {tuple(r) for r in as_of(intervals, later).collect()} == {r[:2] for r in rows if r[2] == day}
    assert as_of(intervals, days[0] - timedelta(days=1)).count() == 0
    at = {day: {r[0] for r in rows if r[2] == day} for day in days}
    gone = {(k, new) for old, new in zip(days, days[1:]) for k in at[old] - at[new]}
    assert {(r.k, r.valid_to) for r in deleted_rows(intervals, ["k"]).collect()} == gone and gone
    stretches = intervals.collect()
    assert len({(r.k, r.v, r.valid_from) for r in stretches}) == len(stretches)
    assert validity_intervals(table.filter("k > 99"), ["k"], "at").count() == 0


def test_channels_in_rings(spark):
    from lagscope.operators.rings import channels_in_rings

    rnd = random.Random(7)
    for nodes, many in ((4, 5), (6, 9), (7, 8)):
        edges = {(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(many)} | {(90, 91), (91, 90), (80, 81), (81, 82), (82, 80)}

        def way(u, v, seen):
            """Channels of the shortest way from v to u over nodes not seen."""
            ways = [1 + (0 if b == u else way(u, b, seen | {b})) for a, b in edges if a == v and b not in seen]
            return min(ways, default=99)

        want = set()
        for u, v in sorted(edges):
            if u == v:
                continue
            back = (v, u) in edges
            edges.discard((v, u))
            ring = 1 + way(u, v, {v})
            if back:
                edges.add((v, u))
            if ring < 90:
                want.add((u, v, ring))
        table = spark.createDataFrame([*edges, *list(edges)[:2], (None, 1), (3, None)], "source int, target int")
        assert {tuple(r) for r in channels_in_rings(table).collect()} == want
        assert {(80, 81, 3), (81, 82, 3), (82, 80, 3)} <= want and not any(u in (90, 91) for u, _, _ in want)
    assert channels_in_rings(spark.createDataFrame([], "source int, target int")).count() == 0
