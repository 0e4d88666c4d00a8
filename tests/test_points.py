from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

import fixtures
from lagscope.functions.scalars import id_origin
from lagscope.operators import gauges, points
from lagscope.operators.points import PointSpec, project, split_rejects, stat_specs, to_line_protocol
from lagscope.sources.pages import PAGE_LABELS, extract_html_table, page_points, table_rows


def lines(df, spec, **kw):
    return [r.line for r in split_rejects(to_line_protocol(df, spec, **kw))[0].collect()]


def test_golden_line(spark):
    rows = [(datetime(2020, 4, 20, 8, 30, 16), 1, 123456.0, 332333, 100, "测试")]
    df = spark.createDataFrame(rows, "ModifiedTime timestamp, ID long, Delay double, Something long, IncrID long, MyNote string")
    spec = PointSpec.of("pipeline_delay", "ModifiedTime", {"ID": "delay_id"}, ["Delay", "IncrID", "MyNote"])
    assert lines(df, spec) == ['pipeline_delay,delay_id=1 delay=123456,incr_id=100,my_note="测试" 1587371416000000000']


def test_line_cases(spark):
    at = datetime(2020, 4, 20)
    ns = int((at - datetime(1970, 1, 1)).total_seconds()) * 10**9
    rows = [(1, "a,b=c d", "x", 1, at), (2, None, 'q"\\\n', 2, at), (3, "t", None, None, at), (4, "t", "é" * 32000, 4, at), (5, "t", "é" * 32000 + "a", 5, at), (6, "t", "z", 6, None)]
    df = spark.createDataFrame(rows, "id long, tag string, s string, n long, at timestamp")
    spec = PointSpec.of("m", "at", {"tag": "t k"}, {"s": "s", "n": "n=1"})
    encoded = to_line_protocol(df, spec, now=F.lit("2020-04-21 00:00:00").cast("timestamp"))
    out = {r.id: (r.line, r.reject) for r in encoded.collect()}
    assert out[1][0] == f'm,t\\ k=a\\,b\\=c\\ d s="x",n\\=1=1 {ns}'
    assert out[2][0] == f'm s="q\\"\\\\\\n",n\\=1=2 {ns}'
    assert out[3] == (None, "no fields")
    assert out[4][1] is None and out[4][0].endswith(f'",n\\=1=4 {ns}')
    assert out[5] == (None, "string too long: s")
    assert out[6][0] == f'm,t\\ k=t s="z",n\\=1=6 {ns + 86400 * 10**9}'
    good, bad = split_rejects(encoded)
    assert good.count() == 4 and sorted(r.id for r in bad.collect()) == [3, 5]


def test_field_types(spark):
    df = spark.sql("""SELECT true b, float(0.1) f, 1234567.0D d, interval '1' second i, timestamp'1970-01-01 00:00:01' t,
                   decimal(5) n, binary('ab') x, timestamp'1970-01-01 00:00:02' at""")
    spec = PointSpec.of("m", "at", [], ["b", "f", "d", "i", "t", "n", "x"])
    assert lines(df, spec) == ['m b=true,f=0.1,d=1.234567e+06,i=1000000000,t=1000000000,n=5,x="ab" 2000000000']
    bad = to_line_protocol(df.withColumn("a", F.array(F.lit(1))), PointSpec.of("m", "at", [], ["b", "a"])).first()
    assert bad.line is None and bad.reject == "unsupported type: a"


def test_statistics_points(spark):
    spec = stat_specs("x_")["DELAY_STAT"]
    assert spec.measurement == "x_delay_stat"
    out = lines(fixtures.delays(spark), spec)
    assert "x_delay_stat,pipeline_id=1 delay_time=1772,id=1 1587350997000000000" in out
    assert project(fixtures.throughput(spark), stat_specs()["THROUGHPUT_STAT"]).columns == [
        "time", "pipeline_id", "type", "number", "size", "start_time", "end_time", "id"]
    assert len(lines(fixtures.log_records(spark), stat_specs()["LOG_RECORD"])) == 5


def test_dedupe_points(spark):
    at = datetime(2020, 4, 20)
    rows = [(1, "a", 5, None, at), (2, "a", None, "y", at), (3, "a", 7, None, at), (4, "b", 1, None, at)]
    df = spark.createDataFrame(rows, "id long, tag string, n long, s string, at timestamp")
    out = points.dedupe_points(df, PointSpec.of("m", "at", ["tag"], ["n", "s"]), ["id"])
    assert sorted((r.tag, r.n, r.s) for r in out.collect()) == [("a", 7, "y"), ("b", 1, None)]


ROW = ("3", "pipeb", "工作中", "1.213 s", "2020-04-14 08:27:35", "2020-04-17 07:22:04")
TITLES = ("序号", "Pipeline名字", "mainstem状态", "延迟时间", "最后同步时间", "最后位点时间")


def page(titles, *rows):
    head = "".join(f"<th> {t} </th>" for t in titles)
    body = "".join("<tr>" + "".join(f"<td>\n {c}</td>" for c in row) + "</tr>" for row in rows)
    return f'<html><table><tr><td>other</td></tr></table><table class="x list"><tr>{head}</tr>{body}</table></html>'


def test_status_page(spark):
    order = [4, 2, 0, 1, 5, 3]
    pages = [
        ("plain", page(TITLES, ROW, ROW)),
        ("reordered", page([TITLES[i] for i in order], [ROW[i] for i in order])),
        ("missing", page(TITLES[:3], ROW[:3])),
        ("stray", page(("备注", *TITLES), ("note", *ROW))),
        ("unclosed", '<table class="list"><tr><th>序号<th>mainstem状态<tr><td>9<td>定位中</table>'),
        ("nested", '<TABLE CLASS=list><TR><TH>序号</TH><TH><!-- <td>x</td> -->名字 &amp; b</TH></TR><tr><td title="a>b">1</td>'
                   '<td><a href="?x">n</a><script>var t = "<tr><td>no</td></tr>";</script></td></tr></TABLE><table><tr><td>other</td></tr></table>'),
        ("none", "<p>no table</p>"),
        ("null", None),
    ]
    out = extract_html_table(spark.createDataFrame(pages, "name_of_page string, html string"), "html")
    got = {}
    for r in out.collect():
        got.setdefault(r.name_of_page, []).append(tuple(r[c] for c in PAGE_LABELS))
    assert got["plain"] == [ROW, ROW] and got["reordered"] == [ROW] and got["stray"] == [ROW]
    assert got["missing"] == [(*ROW[:3], "", "", "")]
    assert got["unclosed"] == [("9", "", "定位中", "", "", "")]
    assert got["nested"] == [("1", "", "", "", "", "")]
    assert set(got) == {"plain", "reordered", "missing", "stray", "unclosed", "nested"}
    cells = spark.createDataFrame([pages[5]], "n string, html string").select(table_rows("list")("html").alias("r")).first().r
    assert cells == [["序号", "名字 & b"], ["1", 'nvar t = "<tr><td>no</td></tr>";']]


def test_title_binding(spark):
    # An empty title is part of every label: all labels take it and the last one has it.
    html = '<table class="list"><tr><th></th><th>序号</th></tr><tr><td>e</td><td>1</td></tr></table>'
    labels = {"seq": "序号", "name": "名字"}
    row = extract_html_table(spark.createDataFrame([(html,)], "html string"), "html", "list", labels).first()
    assert (row.seq, row.name) == ("", "e")


def test_page_point_and_gauges(spark):
    rows = extract_html_table(spark.createDataFrame([(page(TITLES, ROW),)], "html string"), "html")
    point = page_points(rows, F.lit("2020-04-20 00:00:00").cast("timestamp"))
    first = point.first()
    assert (first.pipeline_id, first.state, first.delay_time) == ("3", "工作中", 1213.0)
    assert first.last_sync_time == datetime(2020, 4, 14, 8, 27, 35)
    line = lines(point, stat_specs()["STATUS_PAGE"])[0]
    assert line.startswith('pipeline,pipeline_id=3 state="工作中",delay_time=1213,last_sync_time=1586852855000000000,')
    made = [(tuple(r["keys"]), r.val) for r in gauges.state_gauges(point, "root").collect()]
    assert made == [(("root", "pipeline", "3", "state"), 1), (("root", "pipeline", "3", "delayTime"), 1213)]


def test_gauges(spark):
    log, history = fixtures.log_records(spark), fixtures.history(spark)

    def made(begin, end, **kw):
        out = gauges.collect_gauges(log, history, begin, end, "root", "10.0.0.1", **kw)
        return {tuple(r["keys"]): r.val for r in out.collect()}

    quiet = made("2020-04-20 02:49:00", "2020-04-20 02:50:57")
    assert quiet[("self", "10.0.0.1", "alive")] == 1 and ("root", "exception") not in quiet
    assert quiet[("root", "pipeline", "3", "insertCount")] == 10000 and quiet[("root", "pipeline", "1", "insertCount")] == 10000
    assert quiet[("root", "pipeline", "1", "deleteCount")] == 0 and len(quiet) == 7
    assert made("2020-04-20 02:49:00", "2020-04-20 02:50:57", emit_zero=True)[("root", "exception")] == 0
    assert made("2020-04-20 04:19:24", "2020-04-20 04:20:24") == {("self", "10.0.0.1", "alive"): 1, ("root", "exception"): 1}
    record = gauges.to_gauge_json(gauges.heartbeat(spark, "h"), "cat", "h", F.lit("2020-04-20 01:02:03").cast("timestamp")).first().json
    assert record == '{"ipPort":"h","keys":["self","h","alive"],"time":"20200420010203","category":"cat","values":[{"metricType":"Gauges","name":"V","val":1}]}'


def test_missing_heartbeats(spark):
    at = [datetime(2020, 4, 20, 0, m, 5) for m in (0, 1, 1, 3)]
    beats = spark.createDataFrame([(t,) for t in at], "at timestamp")
    out = gauges.missing_heartbeats(beats, "at", "1 minute", "2020-04-20 00:00:00", "2020-04-20 00:04:59")
    assert sorted(r.bucket.minute for r in out.collect()) == [2, 4]


def test_row_origin(spark):
    for table in (fixtures.delays, fixtures.history, fixtures.throughput, fixtures.table_stat):
        origins = {int(r.o) for r in table(spark).select(id_origin(F.col("ID"), 2).alias("o")).collect()}
        assert origins == {1}
    assert [r.o for r in spark.range(0, 6).select(id_origin("id", 3).alias("o")).collect()] == [3, 1, 2, 3, 1, 2]


def test_schema_of_gauge(spark):
    from lagscope.schemas import GAUGE

    records = gauges.to_gauge_records(gauges.heartbeat(spark, "h"), "c", "h", F.lit("2020-04-20 01:02:03").cast("timestamp"))
    wanted = T.StructType.fromDDL(GAUGE)
    assert [f.name for f in records.schema.fields] == [f.name for f in wanted.fields]
    assert [f.dataType.simpleString() for f in records.schema.fields] == [f.dataType.simpleString() for f in wanted.fields]
