import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import fixtures
from lagscope.operators import changes as ops
from lagscope.operators.copying import fan_out_copy
from lagscope.operators.points import PointSpec, dedupe_points
from lagscope.schemas import CHANGE_KINDS, CHANGE_READ, struct_of
from lagscope.sources import changes as source
from lagscope.sources.stats import jdbc_options, list_schemas, list_tables, read_stat, read_texts
from lagscope.streaming import changes as streams
from lagscope.streaming.collector import Source, capture_changes, collect_once, collected_points, latest_state, run_collect, stream_points
from lagscope.streaming.positions import START_ID, START_TIME, WatermarkTable

USER = T.StructType().add("id", "long").add("email", "string").add("age", "integer")


def event(pos, kind="row", op=None, gtid=None, table="user", before=None, after=None, **more):
    text = {k: None if v is None else str(v) for k, v in (after or {}).items()}
    old = {k: None if v is None else str(v) for k, v in (before or {}).items()}
    return dict(kind=kind, op=op, schema="db", table=table, key=None, before=old or None, after=text or None, pos=pos, gtid=gtid,
                ts=f"2024-01-01T00:{pos % 60:02d}:00Z", **more)


EVENTS = [
    event(0, "rotate"), event(1, "gtid", gtid="g1"),
    event(2, op="I", gtid="g1", after={"id": 1, "email": "a", "age": 3}),
    event(3, op="I", gtid="g1", after={"id": 2, "email": "b", "age": None}),
    event(4, "xid", gtid="g1"), event(5, "ddl"), event(6, "table_changed"),
    event(7, op="U", gtid="g2", before={"id": 1}, after={"id": 1, "email": "c", "age": 4}),
    event(8, op="D", gtid="g2", before={"id": 2, "email": "b"}),
    event(9, "xid", gtid="g2"), event(10, "pos_synced"),
    event(11, op="I", gtid="g3", after={"id": 3, "email": "z", "age": 1}),
]


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events))


def test_envelope(spark, tmp_path):
    write(tmp_path / "in", "0.json", EVENTS)
    batch = source.read_changes(spark, str(tmp_path / "in"), streaming=False)
    assert batch.schema.simpleString() == struct_of(CHANGE_READ).simpleString()
    assert source.of_kind(batch, "row").count() == 5 and source.of_kind(batch, "xid").count() == 2
    with pytest.raises(ValueError):
        source.of_kind(batch, "other")
    raw = spark.createDataFrame([(json.dumps(e),) for e in EVENTS], "value string")
    assert source.decode_changes(raw).filter("kind = 'row' AND op = 'D'").first().before == {"id": "2", "email": "b"}


def test_table_from_changes(spark, tmp_path):
    write(tmp_path / "in", "0.json", EVENTS)
    batch = source.read_changes(spark, str(tmp_path / "in"), streaming=False)
    rows = ops.rows_of(batch, USER, ["id"], extra=("op", "pos"))
    base = spark.createDataFrame([(2, "old", 9), (7, "kept", 1)], USER)
    out = ops.apply_changes(base, rows, ["id"], "pos")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "c", 4), (3, "z", 1), (7, "kept", 1)]


def test_apply_against_brute_force(spark):
    rng = random.Random(11)
    log = [(rng.choice([1, 1, 1, rng.randrange(50)]), rng.choice("IUD"), rng.random(), pos) for pos in range(2000)]
    state = {k: float(k) for k in range(30)}
    base = spark.createDataFrame(list(state.items()), "k long, v double")
    for k, op, v, _ in log:
        state.pop(k, None)
        if op != "D":
            state[k] = v
    rng.shuffle(log)
    out = ops.apply_changes(base, spark.createDataFrame(log, "k long, op string, v double, pos long"), ["k"], "pos")
    assert {r.k: r.v for r in out.collect()} == state and out.count() == len(state)


def test_transactions(spark, tmp_path):
    write(tmp_path / "in", "0.json", EVENTS)
    batch = source.read_changes(spark, str(tmp_path / "in"), streaming=False)
    got = {r.gtid: ([(x.pos, x.op) for x in r.rows], r.changes, r.closed, r.chunk) for r in ops.group_transactions(batch).collect()}
    assert got == {"g1": ([(2, "I"), (3, "I")], 2, True, 0), "g2": ([(7, "U"), (8, "D")], 2, True, 0), "g3": ([(11, "I")], 1, False, 0)}


def test_huge_transaction_is_chunked(spark):
    rows = spark.range(5000).select(F.lit("row").alias("kind"), F.when(F.col("id") < 4500, "big").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("gtid"),
                                    F.col("id").alias("pos"))
    out = ops.group_transactions(rows, ["pos"], chunk_rows=100).collect()
    big = sorted((r.chunk, [x.pos for x in r.rows]) for r in out if r.gtid == "big")
    assert [c for c, _ in big] == list(range(45)) and [p for _, ps in big for p in ps] == list(range(4500))
    assert len(out) == 45 + 50 and all(r.changes == (4500 if r.gtid == "big" else 10) for r in out)


def test_loop_filter(spark):
    rows = [
        ("own", "retl_mark", 1, 0), ("own", "t", None, 1), ("own", "retl_mark", 1, 2),
        ("other", "retl_mark", 2, 3), ("other", "t", None, 4), ("other", "retl_mark", 2, 5),
        ("plain", "t", None, 6), (None, "t", None, 7),
    ]
    changes = spark.createDataFrame(rows, "gtid string, table string, channel_id int, pos long")
    assert sorted(r.pos for r in ops.drop_looped(changes, 1).collect()) == [4, 6, 7]
    assert sorted(r.pos for r in ops.drop_looped(changes, 2).collect()) == [1, 6, 7]


def test_change_stats_equal_history_shape(spark):
    rows = [("p", "I", datetime(2024, 1, 1, 0, 0, s)) for s in (1, 5, 9)] + [("p", "D", datetime(2024, 1, 1, 0, 1, 0)), ("q", "U", datetime(2024, 1, 1, 0, 0, 2))]
    out = ops.change_stats(spark.createDataFrame(rows, "p string, op string, ts timestamp"), ["p"], "1 minute")
    got = {(r.p, r.bucket.minute): (r.insert_count, r.update_count, r.delete_count, r.start_time.second, r.end_time.second) for r in out.collect()}
    assert got == {("p", 0): (3, 0, 0, 1, 9), ("p", 1): (0, 0, 1, 0, 0), ("q", 0): (0, 1, 0, 2, 2)}


def _run_in_parts(spark, folder, start):
    """Feeds the events in three files, with a restart between them."""
    for n, part in enumerate((EVENTS[:3], EVENTS[3:8], EVENTS[8:])):
        write(folder / "in", f"{n}.json", part)
        start(source.read_changes(spark, str(folder / "in"))).awaitTermination()


def test_streamed_transactions(spark, tmp_path):
    _run_in_parts(spark, tmp_path, lambda s: streams.stream_transactions(s, str(tmp_path / "out"), available_now=True))
    got = {r.gtid: (r.changes, r.first_pos, r.last_pos, r.closed) for r in streams.finished_transactions(spark, str(tmp_path / "out")).collect()}
    assert got == {"g1": (2, 1, 4, True), "g2": (2, 7, 9, True)}
    assert [(r.gtid, r.changes) for r in streams.open_transactions(spark, str(tmp_path / "out")).collect()] == [("g3", 1)]
    batch = ops.transaction_summary(source.read_changes(spark, str(tmp_path / "in"), streaming=False)).filter("closed")
    assert {r.gtid: (r.changes, r.first_pos, r.last_pos, r.closed) for r in batch.collect()} == got
    write(tmp_path / "in", "9.json", [event(12, kind="xid", gtid="g3")])  # a late end, batches after its rows
    streams.stream_transactions(source.read_changes(spark, str(tmp_path / "in")), str(tmp_path / "out"), available_now=True).awaitTermination()
    late = streams.finished_transactions(spark, str(tmp_path / "out")).filter("gtid = 'g3'").first()
    assert (late.changes, late.last_pos, late.closed) == (1, 12, True)
    assert streams.open_transactions(spark, str(tmp_path / "out")).count() == 0


def test_streamed_transactions_refuse_another_checkpoint(spark, tmp_path):
    write(tmp_path / "in", "0.json", EVENTS)
    (tmp_path / "out" / "done" / "_spark_metadata").mkdir(parents=True)
    with pytest.raises(Exception, match="another checkpoint"):
        streams.stream_transactions(source.read_changes(spark, str(tmp_path / "in")), str(tmp_path / "out"), available_now=True)


def test_streamed_transaction_timeout(spark, tmp_path):
    """One whose end does not come is put out when its time is over, and what comes later is added to it."""
    write(tmp_path / "in", "0.json", EVENTS)
    folder = str(tmp_path / "out")
    query = streams.stream_transactions(source.read_changes(spark, str(tmp_path / "in")), folder, timeout="1 second", trigger="300 milliseconds")
    try:
        _until(lambda: streams.finished_transactions(spark, folder).count() == 3)
        got = sorted((r.gtid, r.changes, r.closed) for r in streams.finished_transactions(spark, folder).collect())
        assert got == [("g1", 2, True), ("g2", 2, True), ("g3", 1, False)]
        write(tmp_path / "in", "1.json", [event(12, kind="xid", gtid="g3")])
        _until(lambda: streams.finished_transactions(spark, folder).filter("closed").count() == 3)
        whole = {r.gtid: (r.changes, r.last_pos, r.closed) for r in streams.finished_transactions(spark, folder).collect()}
        assert whole["g3"] == (1, 12, True) and whole["g1"][0] == 2
    finally:
        query.stop()


def _until(true, seconds=60):
    import time

    end = time.time() + seconds
    while not true():
        assert time.time() < end
        time.sleep(0.3)


def test_buckets_keep_rows_without_a_time(spark):
    from lagscope.operators.rollups import bucket

    for kind in ("timestamp", "timestamp_ntz"):
        rows = spark.createDataFrame([("2024-01-01 00:07:09",), (None,)], "t string").select(F.col("t").cast(kind).alias("t"))
        out = rows.select(bucket("t", "5 minutes").alias("b"))
        assert out.schema["b"].dataType.typeName() == kind
        assert sorted((str(r.b) for r in out.collect())) == ["2024-01-01 00:05:00", "None"]


def test_a_hot_used_name_is_sent_once(spark):
    from lagscope.operators.naming import unused

    names = spark.createDataFrame([("a",), ("b",), (None,)], "n string")
    used = spark.range(1000).selectExpr("if(id < 900, 'a', concat('x', id)) AS n")
    out = unused(names, used, ["n"])
    assert sorted(str(r.n) for r in out.collect()) == ["None", "b"]
    assert "HashAggregate" in out._jdf.queryExecution().executedPlan().toString()


def test_transactions_without_rows_stay(spark):
    rows = [("gtid", "e", 1, None), ("xid", "e", 2, None), ("row", "f", 3, "I"), ("xid", "f", 4, None)]
    out = ops.group_transactions(spark.createDataFrame(rows, "kind string, gtid string, pos long, op string")).collect()
    assert {r.gtid: (r.changes, len(r.rows), r.closed) for r in out} == {"e": (0, 0, True), "f": (1, 1, True)}


def test_update_of_the_key_moves_the_row(spark):
    rows = [("row", "U", {"id": "1", "name": "a"}, {"id": "2", "name": "b"}, 5)]
    changes = spark.createDataFrame(rows, "kind string, op string, before map<string,string>, after map<string,string>, pos long")
    typed = ops.rows_of(changes, T.StructType.fromDDL("id int, name string"), ["id"], ("op", "pos"))
    base = spark.createDataFrame([(1, "a"), (9, "z")], "id int, name string")
    assert sorted(map(tuple, ops.apply_changes(base, typed, ["id"], "pos").collect())) == [(2, "b"), (9, "z")]


def test_marks_of_a_raw_envelope(spark):
    rows = [("t1", "retl", "retl_mark", {"channel_id": "1"}), ("t1", "app", "user", {"id": "1"}), ("t2", "app", "retl_mark", {"channel_id": "1"})]
    changes = spark.createDataFrame([(*r, None) for r in rows], "gtid string, schema string, table string, after map<string,string>, before map<string,string>")
    assert [r.gtid for r in ops.drop_looped(changes, 1).collect()] == ["t2"]


def test_streamed_table(spark, tmp_path):
    def start(stream):
        rows = ops.rows_of(stream, USER, ["id"], extra=("op", "pos"))
        query = streams.stream_table(rows, str(tmp_path / "out"), ["id"], "pos", available_now=True)
        return query

    _run_in_parts(spark, tmp_path, start)
    want = [(1, "c", 4), (3, "z", 1)]
    assert sorted(tuple(r) for r in streams.current_table(spark, str(tmp_path / "out"), ["id"], "pos").collect()) == want
    assert streams.compact_table(spark, str(tmp_path / "out"), ["id"], "pos") == 2
    assert sorted(tuple(r) for r in streams.current_table(spark, str(tmp_path / "out"), ["id"], "pos").collect()) == want
    write(tmp_path / "in", "3.json", [event(12, op="D", before={"id": 3}), event(1, op="I", after={"id": 2, "email": "late", "age": 0})])
    start(source.read_changes(spark, str(tmp_path / "in"))).awaitTermination()
    assert sorted(tuple(r) for r in streams.current_table(spark, str(tmp_path / "out"), ["id"], "pos").collect()) == [(1, "c", 4)]


def test_handlers(spark, tmp_path):
    seen = {}

    def note(kind):
        return lambda batch, number: seen.setdefault(kind, []).extend(r.pos for r in batch.collect())

    kinds = ("rotate", "table_changed", "ddl", "row", "xid", "gtid", "pos_synced")
    handlers = {k: note(k) for k in kinds}
    _run_in_parts(spark, tmp_path, lambda s: streams.handle_changes(s, handlers, str(tmp_path / "cp"), available_now=True))
    assert {k: sorted(v) for k, v in seen.items()} == {
        "rotate": [0], "gtid": [1], "row": [2, 3, 7, 8, 11], "xid": [4, 9], "ddl": [5], "table_changed": [6], "pos_synced": [10]}
    with pytest.raises(ValueError):
        streams.handle_changes(None, {"other": None}, "x")


def test_positions(spark, tmp_path):
    table = WatermarkTable(spark, str(tmp_path / "pos"), keep=2)
    assert table.get("a") == START_TIME and table.get("b", START_ID) == 0
    assert table.commit({"a": datetime(2024, 1, 1, 1, 2, 3, 456), "b": 5})
    assert not table.commit({"a": datetime(2023, 1, 1), "b": 5, "c": None})
    assert table.commit({"b": 6}) and table.commit({"b": 70})
    assert table.get("a") == datetime(2024, 1, 1, 1, 2, 3, 456) and table.get("b", START_ID) == 70
    (tmp_path / "pos" / "v=9").mkdir()  # a version whose writer died
    assert table.get("b", START_ID) == 70
    assert table.commit({"b": 71}) and table.get("b", START_ID) == 71


def _delay_source(df):
    return Source("delay", lambda s: df, "GMT_MODIFIED", PointSpec.of("delay", "GMT_MODIFIED", ["PIPELINE_ID"], ["DELAY_TIME", "ID"]))


def test_two_runs_equal_one(spark, tmp_path):
    delays, log = fixtures.delays(spark), fixtures.log_records(spark)
    spec = PointSpec.of("log", "GMT_MODIFIED", ["PIPELINE_ID"], ["ID"])

    def run(name, *steps):
        positions = WatermarkTable(spark, str(tmp_path / name / "pos"))
        for most in steps:
            sources = [_delay_source(delays.filter(F.col("ID") <= most)), Source("log", lambda s, m=most: log.filter(F.col("ID") <= m), "ID", spec, by_id=True)]
            collect_once(spark, sources, positions, str(tmp_path / name / "out"))
        assert collect_once(spark, sources, positions, str(tmp_path / name / "out")) == {}
        assert positions.get("delay") == datetime(2020, 4, 20, 4, 20, 11) and positions.get("log", START_ID) == 9
        lines = [collected_points(spark, str(tmp_path / name / "out"), s)[0] for s in ("delay", "log")]
        return sorted(r.line for df in lines for r in df.collect())

    assert run("once", 99) == run("thrice", 3, 7, 99) and len(run("again", 99)) == 12


def test_runs_without_new_rows_change_nothing(spark, tmp_path):
    delays, out = fixtures.delays(spark), str(tmp_path / "out")
    positions = WatermarkTable(spark, str(tmp_path / "pos"))
    counts = []
    for most in (0, 3, 3, 99, 99):
        collect_once(spark, [_delay_source(delays.filter(F.col("ID") <= most))], positions, out)
        counts.append(collected_points(spark, out, "delay")[0].count())
    assert counts[0] == 0 and counts[1] == counts[2] and counts[3] == counts[4] == 7


def test_a_source_that_fails_leaves_the_others_collected(spark, tmp_path):
    def broken(_):
        raise RuntimeError("no such table")

    positions = WatermarkTable(spark, str(tmp_path / "pos"))
    good = _delay_source(fixtures.delays(spark))
    with pytest.raises(RuntimeError, match="no such table"):
        collect_once(spark, [Source("bad", broken, "GMT_MODIFIED", good.spec), good], positions, str(tmp_path / "out"))
    assert positions.get("delay") == datetime(2020, 4, 20, 4, 20, 11) and positions.get("bad") == START_TIME
    assert collected_points(spark, str(tmp_path / "out"), "delay")[0].count() == 7


def test_run_that_died_repeats_into_the_same_place(spark, tmp_path):
    positions = WatermarkTable(spark, str(tmp_path / "pos"))
    commit, positions.commit = positions.commit, lambda moved: None
    collect_once(spark, [_delay_source(fixtures.delays(spark))], positions, str(tmp_path / "out"))
    positions.commit = commit
    collect_once(spark, [_delay_source(fixtures.delays(spark))], positions, str(tmp_path / "out"))
    assert collected_points(spark, str(tmp_path / "out"), "delay")[0].count() == 7


def test_overlap_catches_late_rows(spark, tmp_path):
    delays = fixtures.delays(spark)
    early = delays.filter("ID IN (1, 5)")  # 3 and 7 share their second and come late
    for name, overlap, want in (("strict", None, 5), ("overlap", timedelta(seconds=1), 6)):
        positions = WatermarkTable(spark, str(tmp_path / name / "pos"))
        for df in (early, delays):
            collect_once(spark, [_delay_source(df)], positions, str(tmp_path / name / "out"), overlap)
        lines, rejects = collected_points(spark, str(tmp_path / name / "out"), "delay")
        assert lines.distinct().count() == want and rejects.count() == 0
    twice = delays.unionAll(delays)
    assert dedupe_points(twice, _delay_source(delays).spec, ["ID"]).count() == 7


def test_streamed_points(spark, tmp_path):
    delays = fixtures.delays(spark)
    spec = _delay_source(delays).spec
    out = str(tmp_path / "out")
    for part in ("ID < 5", "ID >= 5"):
        delays.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream_points(spark.readStream.schema(delays.schema).parquet(str(tmp_path / "in")), spec, out, available_now=True).awaitTermination()
    lines, rejects = collected_points(spark, out, "delay")
    assert lines.count() == 7 and lines.distinct().count() == 7 and rejects.count() == 0


def test_streamed_buckets(spark, tmp_path):
    from lagscope.operators.rollups import bucket_sum

    sizes = fixtures.throughput(spark)
    sizes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sizes.schema).parquet(str(tmp_path / "in"))
    rolled = bucket_sum(stream, "GMT_MODIFIED", "SIZE", "1 minute", alias="size")
    query = rolled.writeStream.format("memory").queryName("sizes").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.size for r in spark.table("sizes").collect()) == [51176, 511328, 9713112]


def test_shared_folder():
    from types import SimpleNamespace

    from lagscope.session import shared_folder

    def session(master, setting=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting),
                               sparkContext=SimpleNamespace(master=master, applicationId=master))

    assert shared_folder(session("yarn", "hdfs:///tmp/cp/"), "x") == "hdfs:///tmp/cp/x"
    local = shared_folder(session("local[2]"), "x")
    assert local.endswith("/x") and shared_folder(session("local[2]"), "x") == local
    with pytest.raises(ValueError):
        shared_folder(session("yarn"), "x")


def test_captured_states(spark):
    t = [datetime(2024, 1, 1, 0, 0, s) for s in range(4)]
    states = spark.createDataFrame([(1, t[1], 5), (1, t[2], 8), (2, t[3], 1)], "k long, ts timestamp, n long")
    assert capture_changes(states, "ts", t[1]).count() == 2 and capture_changes(states, "ts", t[0], t[2]).count() == 2
    assert {r.k: r.n for r in latest_state(states, "k", "ts", ["n"]).collect()} == {1: 8, 2: 1}


def test_timer(spark, tmp_path):
    import time

    ticks = []
    query = run_collect(spark, ticks.append, str(tmp_path / "cp"), trigger="1 second")
    until = time.time() + 30
    while len(ticks) < 2 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert len(ticks) >= 2


def test_sources(spark, tmp_path):
    fixtures.delays(spark).write.parquet(str(tmp_path / "DELAY_STAT"))
    out = read_stat(spark, str(tmp_path), "delay_stat")
    assert out.columns == ["ID", "DELAY_TIME", "PIPELINE_ID", "GMT_CREATE", "GMT_MODIFIED"] and out.count() == 7
    fixtures.log_records(spark).write.json(str(tmp_path / "json" / "LOG_RECORD"))
    log = read_stat(spark, {"format": "json", "path": str(tmp_path / "json")}, "LOG_RECORD")
    assert log.count() == 5 and log.first().MESSAGE.count("\n") == 1
    jdbc = {"format": "jdbc", "options": {"url": "jdbc:mysql://h/db", "lowerBound": 0, "upperBound": 100, "numPartitions": 4}}
    options = jdbc_options(jdbc, "DELAY_STAT", "ID")
    assert options["partitionColumn"] == "ID" and options["numPartitions"] == "4" and options["dbtable"] == "DELAY_STAT"
    assert options["zeroDateTimeBehavior"] == "CONVERT_TO_NULL"
    with pytest.raises(ValueError, match="one task"):
        jdbc_options({"options": {"url": "u"}}, "T", "ID")
    single = jdbc_options({"options": {"url": "u"}, "single": True}, "T", "ID")
    assert "partitionColumn" not in single and "zeroDateTimeBehavior" not in single
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "a.cnf").write_text("x=1\ny=2\n")
    assert read_texts(spark, str(tmp_path / "conf")).first().text == "x=1\ny=2\n"


def test_catalogue(spark):
    rows = [("mysql", "user"), ("app", "t"), ("skip", "t"), ("MySQL", "kept_by_name")]
    tables = spark.createDataFrame(rows, "TABLE_SCHEMA string, TABLE_NAME string")
    assert sorted(r.TABLE_SCHEMA for r in list_tables(tables, ["skip"]).collect()) == ["MySQL", "app"]
    names = spark.createDataFrame([("SYS",), ("app",), ("Mysql",)], "Database string")
    assert [r.Database for r in list_schemas(names).collect()] == ["app"]


def test_fan_out_copy(spark, tmp_path):
    tables = {"t": spark.range(5), "mysql.help_topic": spark.range(1)}
    written = fan_out_copy(tables, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert list(written) == ["t"] and [spark.read.parquet(p).count() for p in written["t"]] == [5, 5]


def test_unreadable_events_are_rejected(spark, tmp_path):
    lines = ['{"kind":"ddl","file":"bin.000009","pos":4,"ddl":"DROP TABLE t","gtid_set":"s:1-5"}', "{broken", '{"kind":"other"}', '{"pos":"x","kind":"row"}', "[]",
             '{"kind":"rotate","next_file":"bin.000010","force":true}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines) + "\n")
    events = source.read_changes(spark, str(tmp_path / "in"), streaming=False)
    assert sorted(r.reject for r in events.filter("reject IS NOT NULL").collect()) == sorted(lines[1:5])
    good = {r.kind: r for r in events.filter("reject IS NULL").collect()}
    assert (good["ddl"].ddl, good["ddl"].file, good["ddl"].gtid_set) == ("DROP TABLE t", "bin.000009", "s:1-5")
    assert (good["rotate"].next_file, good["rotate"].force) == ("bin.000010", True)
    empty = source.decode_changes(spark.createDataFrame([(None,)], "value string")).first()
    assert empty.reject == "" and empty.kind is None
    with pytest.raises(Exception, match="unreadable change event"):
        source.read_changes(spark, str(tmp_path / "in"), streaming=False, strict=True).count()


def test_positions_restart_with_every_log_file(spark):
    rows = [("row", "I", "bin.9", 500, {"id": "1", "name": "old"}), ("row", "U", "bin.10", 4, {"id": "1", "name": "new"})]
    changes = spark.createDataFrame([(k, o, f, p, None, a) for k, o, f, p, a in rows],
                                    "kind string, op string, file string, pos long, before map<string,string>, after map<string,string>")
    typed = ops.rows_of(changes, T.StructType.fromDDL("id int, name string"), ["id"], ("op", "log", "pos"))
    base = spark.createDataFrame([(1, "base"), (2, "b")], "id int, name string")
    assert sorted(tuple(r) for r in ops.apply_changes(base, typed, ["id"], ["log", "pos"]).collect()) == [(1, "new"), (2, "b")]


def test_handlers_of_all_kinds_read_the_source_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    spark.range(70).selectExpr("id", f"element_at(array({', '.join(repr(k) for k in CHANGE_KINDS)}), cast(id % 7 AS INT) + 1) AS kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, kind string").parquet(str(tmp_path / "in")).mapInArrow(count, "id long, kind string")
    seen = {}
    handlers = {k: (lambda batch, number, k=k: seen.__setitem__(k, batch.count())) for k in CHANGE_KINDS}
    streams.handle_changes(stream, handlers, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert seen == dict.fromkeys(CHANGE_KINDS, 10) and read.value == 70
