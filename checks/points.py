"""Sources, points, gauges, copies, incremental collection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.base import LOGS, STATS, check, logs, read, stats
from lagscope.functions.text import MAX_STRING_BYTES
from lagscope.operators import copying, gauges, history, points, rollups, silence
from lagscope.session import temporary_folder
from lagscope.sources import pages as page_source
from lagscope.sources import polled
from lagscope.sources import stats as stat_source
from lagscope.streaming import collector
from lagscope.streaming import silence as silence_streams
from lagscope.streaming.positions import WatermarkTable

FROM, TO = "2024-01-05 00:00:00", "2024-01-25 12:00:00"
HOST = "10.0.0.1"
ROOT = "replication"
NOW = "2024-02-01 08:09:10"


def _scratch(spark, name):
    return temporary_folder(spark, name)


@check("src1_scan_stat", "SELECT event_id, value, user_id, ts FROM events")
def src1(spark, sf):
    source = {"format": "parquet", "path": sf}
    return stat_source.read_table(spark, source, "events.parquet").select("event_id", "value", "user_id", "ts")


_LABELS = {"seq": "序号", "name": "Pipeline名字", "state": "mainstem状态", "delay": "延迟时间"}


def _page_tables(spark, sf):
    """Every page with a two-row status table in front; titles in another order, one of them unknown."""
    def cell(tag, text):
        return F.concat(F.lit(f"<{tag}> "), text, F.lit(f"\n</{tag}>"))

    titles = F.concat(*[cell("th", F.lit(t)) for t in ("状态", "序号", "stray", "名字")])
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))

    def row(n):
        return F.concat(F.lit("<tr>"), cell("td", F.lit(f"<b>工作</b>{n}")), cell("td", F.col("page_id").cast("string")),
                        cell("td", F.lit("x")), cell("td", url), F.lit("</tr>"))

    table = F.concat(F.lit('<table class="wide list"><tr>'), titles, F.lit("</tr>"), row(1), row(2), F.lit("</table>"))
    return read(spark, sf, "pages").select("page_id", F.concat(table, F.col("html")).alias("html"))


@check("src2_html_table", """SELECT page_id, r AS row, cast(page_id AS VARCHAR) AS seq, url AS name, '工作' || r AS state, '' AS delay
 FROM pages CROSS JOIN (VALUES (1), (2)) v(r)""")
def src2(spark, sf):
    return page_source.extract_html_table(_page_tables(spark, sf), "html", "list", _LABELS)


@check("src4_list_tables", """SELECT table_schema, table_name FROM (SELECT CASE p_brand WHEN 'Brand#1' THEN 'mysql' WHEN 'Brand#2' THEN 'sys'
 ELSE p_brand END AS table_schema, p_name || '_' || p_partkey AS table_name FROM part)
 WHERE table_schema NOT IN ('performance_schema','information_schema','mysql','sys','Brand#3')""")
def src4(spark, sf):
    return stat_source.list_tables(_catalogue(spark, sf), ["Brand#3"]).select(
        F.col("TABLE_SCHEMA").alias("table_schema"), F.col("TABLE_NAME").alias("table_name"))


def _catalogue(spark, sf):
    brand = F.col("p_brand")
    return read(spark, sf, "part").select(
        F.when(brand == "Brand#1", F.lit("mysql")).when(brand == "Brand#2", F.lit("sys")).otherwise(brand).alias("TABLE_SCHEMA"),
        F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("TABLE_NAME"))


@check("prd6_user_tables", """SELECT table_schema, count(*) AS tables FROM (SELECT CASE p_brand WHEN 'Brand#1' THEN 'mysql' WHEN 'Brand#2' THEN 'sys'
 ELSE p_brand END AS table_schema FROM part) WHERE table_schema NOT IN ('mysql','sys') GROUP BY 1""")
def prd6(spark, sf):
    from lagscope.operators.filters import user_tables

    kept = user_tables(_catalogue(spark, sf))
    return kept.groupBy(F.col("TABLE_SCHEMA").alias("table_schema")).agg(F.count("*").alias("tables"))


@check("src4_list_schemas", """SELECT DISTINCT upper(CASE p_brand WHEN 'Brand#1' THEN 'mysql' WHEN 'Brand#2' THEN 'sys' ELSE p_brand END) AS "Database"
 FROM part WHERE p_brand NOT IN ('Brand#1','Brand#2')""")
def src4_schemas(spark, sf):
    names = _catalogue(spark, sf).select(F.upper("TABLE_SCHEMA").alias("Database")).distinct()
    return stat_source.list_schemas(names)


@check("src5_node_status", """SELECT 'master-a' AS address, s_name AS "Master_Host", cast(s_acctbal AS VARCHAR) AS "Seconds_Behind_Master" FROM supplier
 UNION ALL SELECT 'master-b', c_name, NULL FROM customer""")
def src5(spark, sf):
    a = read(spark, sf, "supplier").select(F.col("s_name").alias("Master_Host"), F.col("s_acctbal").cast("string").alias("Seconds_Behind_Master"))
    b = read(spark, sf, "customer").select(F.col("c_name").alias("Master_Host"))
    return stat_source.read_node_status({"master-a": a, "master-b": b})


@check("src6_variables", "SELECT event_type AS name, props AS value FROM events")
def src6(spark, sf):
    return stat_source.read_variables(read(spark, sf, "events"), "event_type", "props")


@check("src7_read_texts", "SELECT cast(item_id AS BIGINT) AS item_id, text || chr(10) AS text FROM benchmark")
def src7(spark, sf):
    folder = _scratch(spark, "texts")
    read(spark, sf, "benchmark").select("text", "item_id").repartition("item_id").write.partitionBy("item_id").text(folder)
    texts = stat_source.read_texts(spark, folder)
    return texts.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "text")


@check("src8_gen_rows", "SELECT unnest(generate_series(1, (SELECT count(*) FROM orders))) AS key, unnest(generate_series(1, (SELECT count(*) FROM orders))) AS a")
def src8(spark, sf):
    return stat_source.gen_rows(spark, read(spark, sf, "orders").count())


_ESC = "replace(replace(replace({0}, ',', '\\,'), '=', '\\='), ' ', '\\ ')"
_QUOTE = "'\"' || replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"'"
_NUM = "regexp_replace(cast({0} AS VARCHAR), '\\.0$', '')"


@check("snk1_line_protocol", f"""SELECT 'events,user_id=' || user_id || ',label=' || {_ESC.format("event_type || ', a=b'")} ||
 ' event_id=' || event_id || ',value=' || {_NUM.format('value')} || ',props=' || {_QUOTE.format('props')} || ',ts=' || (epoch_us(ts) * 1000) ||
 ' ' || (epoch_us(ts) * 1000) AS line FROM events""")
def snk1(spark, sf):
    rows = read(spark, sf, "events").withColumn("label", F.concat("event_type", F.lit(", a=b")))
    spec = points.PointSpec.of("events", "ts", ["user_id", "label"], ["event_id", "value", "props", "ts"])
    return points.split_rejects(points.to_line_protocol(rows, spec))[0]


@check("snk1_line_protocol_texts", f"""SELECT 'docs,lang=' || lang || ' n_chars=' || n_chars || ',text=' || {_QUOTE.format('text')} ||
 ' ' || (epoch_us(TIMESTAMP '{NOW}') * 1000) AS line FROM documents
 WHERE octet_length(encode(text)) <= {MAX_STRING_BYTES}""")
def snk1_texts(spark, sf):
    rows = read(spark, sf, "documents").withColumn("at", F.lit(None).cast("timestamp"))
    spec = points.PointSpec.of("docs", "at", ["lang"], ["n_chars", "text"])
    encoded = points.to_line_protocol(rows, spec, now=F.lit(NOW).cast("timestamp"))
    return points.split_rejects(encoded)[0]


@check("snk2_rejects", f"""SELECT doc_id, 'string too long: text' AS reject FROM documents WHERE octet_length(encode(repeat(text, 4))) > {MAX_STRING_BYTES}""")
def snk2(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.expr("repeat(text, 4)").alias("text"), F.lit(NOW).cast("timestamp").alias("at"))
    spec = points.PointSpec.of("docs", "at", [], ["text"])
    return points.split_rejects(points.to_line_protocol(rows, spec))[1].select("doc_id", "reject")


@check("snk3_dedupe_points", """SELECT user_id, date_trunc('second', ts) AS time, arg_max(value, event_id) AS value,
 arg_max(event_type, event_id) FILTER (event_type <> 'view') AS event_type FROM events GROUP BY 1, 2""")
def snk3(spark, sf):
    rows = read(spark, sf, "events").select(
        "user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("time"), "value", "event_id",
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))
    return points.dedupe_points(rows, points.PointSpec.of("events", "time", ["user_id"], ["value", "event_type"]), ["event_id"])


_TOTALS = f"""(SELECT pipeline_id, sum(insert_count) AS i, sum(update_count) AS u, sum(delete_count) AS d FROM {STATS}
 WHERE gmt_modified BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' GROUP BY 1)"""
_GAUGES = f"""(SELECT '["self","{HOST}","alive"]' AS keys, 1 AS val
 UNION ALL SELECT '["{ROOT}","exception"]', 1 WHERE EXISTS (SELECT 1 FROM {LOGS} WHERE pipeline_id = '-1' AND gmt_modified BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}')
 UNION ALL SELECT '["{ROOT}","pipeline","' || pipeline_id || '","insertCount"]', i FROM {_TOTALS}
 UNION ALL SELECT '["{ROOT}","pipeline","' || pipeline_id || '","updateCount"]', u FROM {_TOTALS}
 UNION ALL SELECT '["{ROOT}","pipeline","' || pipeline_id || '","deleteCount"]', d FROM {_TOTALS})"""


@check("set1_collect_gauges", f"SELECT keys, cast(val AS BIGINT) AS val FROM {_GAUGES}")
def set1(spark, sf):
    out = gauges.collect_gauges(logs(spark, sf), stats(spark, sf), FROM, TO, ROOT, HOST)
    return out.select(F.to_json("keys").alias("keys"), "val")


@check("snk4_gauge_json", f"""SELECT '{{"ipPort":"{HOST}","keys":' || keys || ',"time":"20240201080910","category":"health","values":[{{"metricType":"Gauges","name":"V","val":'
 || cast(val AS BIGINT) || '}}]}}' AS json FROM {_GAUGES}""")
def snk4(spark, sf):
    out = gauges.collect_gauges(logs(spark, sf), stats(spark, sf), FROM, TO, ROOT, HOST)
    return gauges.to_gauge_json(out, "health", HOST, F.lit(NOW).cast("timestamp"))


@check("set1_state_gauges", f"""SELECT '["{ROOT}","pipeline","' || event_id || '","state"]' AS keys, cast(event_type = 'click' AS BIGINT) AS val FROM events
 UNION ALL SELECT '["{ROOT}","pipeline","' || event_id || '","delayTime"]', cast(floor(value) AS BIGINT) FROM events""")
def set1_state(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_id").alias("pipeline_id"), F.col("event_type").alias("state"), F.floor("value").alias("delay_time"))
    out = gauges.state_gauges(rows, ROOT, working="click")
    return out.select(F.to_json("keys").alias("keys"), "val")


@check("snk5_fan_out_copy", """SELECT t AS target, name, n FROM (SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier
 UNION ALL SELECT 'orders', count(*) FROM orders) CROSS JOIN (VALUES ('a'), ('b')) v(t)""")
def snk5(spark, sf):
    folder = _scratch(spark, "copies")
    tables = {t: read(spark, sf, t) for t in ("nation", "supplier", "orders", "region")}
    done = copying.fan_out_copy(tables, [f"{folder}/a", f"{folder}/b"], exclude=("region",))
    counts = [
        spark.read.parquet(path).agg(F.lit(path.split("/")[-2]).alias("target"), F.lit(name).alias("name"), F.count("*").alias("n"))
        for name, paths in done.items() for path in paths
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _sources(upto=None):
    def load(spark, sf):
        rows = stats(spark, sf)
        return rows if upto is None else rows.filter(F.col("GMT_MODIFIED") <= F.lit(upto).cast("timestamp_ntz"))

    spec = points.PointSpec.of("delay", "GMT_MODIFIED", {"PIPELINE_ID": "pipeline_id"}, {"SIZE": "size", "ID": "id"})
    return load, spec


@check("str1_collect_incrementally", f"""SELECT 'delay,pipeline_id=' || pipeline_id || ' size=' || size || ',id=' || id || ' ' || (epoch_us(gmt_modified) * 1000) AS line FROM {STATS}""")
def str1(spark, sf):
    """Three runs over a table that grows in between give the lines of one full run."""
    folder = _scratch(spark, "collect")
    positions = WatermarkTable(spark, f"{folder}/positions")
    for upto in ("2024-01-10 00:00:00", "2024-01-20 00:00:00", None):
        load, spec = _sources(upto)
        source = collector.Source("delay", lambda s, load=load: load(s, sf), "GMT_MODIFIED", spec)
        collector.collect_once(spark, [source], positions, f"{folder}/out")
    return collector.collected_points(spark, f"{folder}/out", "delay")[0]


@check("snk1_stream_points", "SELECT 'events,user_id=' || user_id || ' event_id=' || event_id || ' ' || (epoch_us(ts) * 1000) AS line FROM events")
def snk1_stream(spark, sf):
    """The same encoding on a stream over the events file."""
    folder = _scratch(spark, "points")
    schema = read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    spec = points.PointSpec.of("events", "ts", ["user_id"], ["event_id"])
    collector.stream_points(stream, spec, folder, available_now=True).awaitTermination()
    return collector.collected_points(spark, folder, "events")[0]


def _polled(spark, sf, folder):
    """Three runs over the events as a table polled by time; what each run finds ends where the next begins."""
    schema = read(spark, sf, "events").select("event_id", "ts", "user_id").schema
    table = polled.ParquetTable(f"{sf}/events.parquet", "ts", ("event_id", "ts", "user_id"))
    spec = points.PointSpec.of("events", "ts", ["user_id"], ["event_id"])
    for until in (datetime(2024, 1, 10), datetime(2024, 1, 20, 12), None):
        rows = polled.read_polled(spark, table, schema, until=until)
        collector.stream_points(rows, spec, folder, available_now=True).awaitTermination()


@check("str1_polled_points", "SELECT 'events,user_id=' || user_id || ' event_id=' || event_id || ' ' || (epoch_us(ts) * 1000) AS line FROM events")
def str1_polled(spark, sf):
    folder = _scratch(spark, "polled")
    _polled(spark, sf, folder)
    return collector.collected_points(spark, folder, "events")[0]


@check("str2_polled_positions", """SELECT row_number() OVER (ORDER BY position) - 1 AS batch, position, true AS done FROM (SELECT DISTINCT unnest([
 max(ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-10'), max(ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'), max(ts)]) AS position FROM events)""")
def str2_polled(spark, sf):
    """The positions of the same runs, read from the query's checkpoint."""
    folder = _scratch(spark, "polled")
    _polled(spark, sf, folder)
    saved = polled.saved_positions(spark, f"{folder}/checkpoint/events")
    return saved.select("batch", F.col("position").cast("timestamp_ntz").alias("position"), "done")


@check("str2_positions", f"SELECT 'by_id' AS source, cast(max(id) AS VARCHAR) AS position FROM {STATS} UNION ALL SELECT 'by_time', cast(max(gmt_modified) AS VARCHAR) FROM {STATS}")
def str2(spark, sf):
    folder = _scratch(spark, "positions")
    positions = WatermarkTable(spark, folder)
    rows = stats(spark, sf)
    top = rows.agg(F.max("ID").alias("id"), F.max("GMT_MODIFIED").alias("ts")).first()
    positions.commit({"by_time": datetime(2024, 1, 3), "by_id": 7})
    positions.commit({"by_time": top["ts"], "by_id": top["id"]})
    positions.commit({"by_time": datetime(2024, 1, 4), "by_id": 8})
    return spark.createDataFrame(list(positions.all().items()), "source string, position string")


@check("str3_capture_changes", f"SELECT pipeline_id, arg_max(size, id) AS size FROM {STATS} WHERE gmt_modified > TIMESTAMP '{FROM}' AND gmt_modified <= TIMESTAMP '{TO}' GROUP BY 1")
def str3(spark, sf):
    states = collector.capture_changes(stats(spark, sf), "GMT_MODIFIED", FROM, TO)
    out = collector.latest_state(states, "PIPELINE_ID", "GMT_MODIFIED", ["SIZE"], "ID")
    return out.select(F.col("PIPELINE_ID").alias("pipeline_id"), F.col("SIZE").alias("size"))


@check("str7_missing_heartbeats", f"""SELECT bucket FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:59:00', INTERVAL 1 MINUTE)) AS bucket)
 WHERE bucket NOT IN (SELECT date_trunc('minute', gmt_modified) FROM {STATS})""")
def str7(spark, sf):
    return gauges.missing_heartbeats(stats(spark, sf), "GMT_MODIFIED", "1 minute", "2024-01-01 00:00:00", "2024-01-30 23:59:59")


@check("str7_heartbeat", f"""SELECT keys, count(*) AS beats FROM (SELECT '["self","' || user_id || '","alive"]' AS keys FROM events) GROUP BY 1""")
def str7_beat(spark, sf):
    rows = read(spark, sf, "events")
    beats = gauges.beat_gauges(rows, "user_id")
    return beats.select(F.to_json("keys").alias("keys")).groupBy("keys").agg(F.count("*").alias("beats"))


_SILENCES = """WITH g AS (SELECT host, t, lead(t) OVER (PARTITION BY host ORDER BY t) AS later FROM (SELECT user_id AS host, ts AS t FROM events {more}) WHERE t <= {until})
 SELECT host, 'silent' AS event, t + INTERVAL 12 HOUR AS "at" FROM g WHERE t + INTERVAL 12 HOUR <= {until} AND (later IS NULL OR later > t + INTERVAL 12 HOUR)
 UNION ALL SELECT host, 'returned' AS event, later AS "at" FROM g WHERE later > t + INTERVAL 12 HOUR"""
_SINCE = "2024-01-01 00:00:00"


@check("str7_silent_hosts", _SILENCES.format(until="TIMESTAMP '2024-01-30 00:00:00'", more=f"UNION ALL SELECT user_id + d.d AS host, TIMESTAMP '{_SINCE}' AS t FROM (SELECT DISTINCT user_id FROM events), (VALUES (0), (1000000)) d(d)"))
def str7_silent(spark, sf):
    """Every user and as many others, who never report, are expected."""
    beats = read(spark, sf, "events").select("user_id", "ts")
    users = beats.select(F.explode(F.array("user_id", F.col("user_id") + 1_000_000)).alias("user_id")).distinct()
    return silence.silences(beats, "user_id", "ts", "12 hours", "2024-01-30 00:00:00", _SINCE, users)


@check("str7_stream_silent_hosts", _SILENCES.format(until="(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)", more=""))
def str7_stream(spark, sf):
    folder = temporary_folder(spark, "silences")
    beats = spark.readStream.schema(read(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    silence_streams.stream_silences(beats, "user_id", "ts", "12 hours", folder, "1 hour", available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/events")


_DAYS = "(SELECT user_id, date_trunc('day', ts) AS snap, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1, 2)"
_STRETCHES = f"""(SELECT user_id, kind, min(snap) AS valid_from, CASE WHEN max(no) < (SELECT count(DISTINCT snap) FROM {_DAYS}) THEN arg_max(next, no) END AS valid_to
 FROM (SELECT d.*, no, next, no - row_number() OVER (PARTITION BY user_id, kind ORDER BY no) AS g FROM {_DAYS} d
 JOIN (SELECT snap, row_number() OVER (ORDER BY snap) AS no, lead(snap, 1, snap) OVER (ORDER BY snap) AS next FROM (SELECT DISTINCT snap FROM {_DAYS})) USING (snap)) GROUP BY user_id, kind, g)"""


def _history(spark, sf):
    """Daily snapshots of the users that were active, each with the kind of its last event."""
    days = read(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).agg(F.max_by("event_type", "event_id").alias("kind"))
    return history.validity_intervals(days, ["user_id"], "at")


@check("str3_validity_intervals", f"SELECT user_id, kind, valid_from, valid_to FROM {_STRETCHES}")
def str3_history(spark, sf):
    return _history(spark, sf)


@check("str3_as_of", f"SELECT user_id, kind FROM {_DAYS} WHERE snap = TIMESTAMP '2024-01-17'")
def str3_as_of(spark, sf):
    """The intervals read at a time give the snapshot of that time."""
    return history.as_of(_history(spark, sf), "2024-01-17 15:30:00")


@check("str3_deleted_rows", f"SELECT s.* FROM {_STRETCHES} s WHERE valid_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_STRETCHES} n WHERE n.user_id = s.user_id AND n.valid_from = s.valid_to)")
def str3_deleted(spark, sf):
    return history.deleted_rows(_history(spark, sf), ["user_id"])
