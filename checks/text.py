"""Scalar functions and name work."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, read
from lagscope.functions import scalars, text, times
from lagscope.operators import naming

_NAMES = """(SELECT DISTINCT name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT p_brand || '_bak' || p_size FROM part WHERE p_size <> p_partkey % 7))"""


def _names(spark, sf):
    part = read(spark, sf, "part")
    old = part.filter(F.col("p_size") != F.col("p_partkey") % 7)
    return part.select(F.col("p_brand").alias("name")).unionAll(
        old.select(F.concat("p_brand", F.lit("_bak"), F.col("p_size").cast("string")).alias("name"))).distinct()


@check("prd7_backup_names", f"SELECT name, regexp_matches(name, '.+_bak\\d*') AS is_backup FROM {_NAMES}")
def prd7(spark, sf):
    return _names(spark, sf).select("name", text.is_backup_name("name").alias("is_backup"))


@check("prd8_contains_any", "SELECT p_partkey, contains(p_name, 'ring') OR contains(p_name, 'old') AS hit FROM part")
def prd8(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.contains_any("p_name", ["ring", "old"]).alias("hit"))


@check("prd9_drop_comments", """SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(CASE WHEN lang = 'en' THEN '  # ' ELSE '' END || text, chr(10))) AS line FROM documents)
 WHERE NOT starts_with(trim(line), '#')""")
def prd9(spark, sf):
    body = F.concat(F.when(F.col("lang") == "en", F.lit("  # ")).otherwise(F.lit("")), F.col("text"))
    lines = read(spark, sf, "documents").select("doc_id", F.explode(F.split(body, "\n")).alias("line"))
    return lines.filter(text.drop_comments("line"))


@check("joi1_anti_probe", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem)")
def joi1(spark, sf):
    wanted = read(spark, sf, "orders").select("o_custkey").distinct()
    used = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("o_custkey"))
    return naming.unused(wanted, used, ["o_custkey"])


@check("txt9_smallest_free_suffix", f"""WITH n AS {_NAMES}, plain AS (SELECT name FROM n WHERE NOT regexp_matches(name, '.+_bak\\d*'))
 SELECT name, min(i) AS suffix, name || '_bak' || min(i) AS free_name FROM plain CROSS JOIN (SELECT unnest(generate_series(1, 60)) AS i)
 WHERE name || '_bak' || i NOT IN (SELECT name FROM n) GROUP BY name""")
def txt9(spark, sf):
    return naming.smallest_free_suffix(_names(spark, sf))


@check("txt1_escape_key", "SELECT doc_id, replace(replace(replace(text, ',', '\\,'), '=', '\\='), ' ', '\\ ') AS escaped FROM documents")
def txt1(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.escape_key("text").alias("escaped"))


@check("txt2_field_literal", """SELECT event_id, '"' || replace(props, '"', '\\"') || '"' AS s, cast(user_id AS VARCHAR) AS i,
 regexp_replace(cast(value AS VARCHAR), '\\.0$', '') AS f, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS b, cast(epoch_us(ts) * 1000 AS VARCHAR) AS t FROM events""")
def txt2(spark, sf):
    df = read(spark, sf, "events").withColumn("big", F.col("value") > 50)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select("event_id", *[text.field_literal(c, kinds[c]).alias(n) for c, n in
                                   {"props": "s", "user_id": "i", "value": "f", "big": "b", "ts": "t"}.items()])


@check("txt3_snake_names", "SELECT o_orderkey AS order_key, o_custkey AS cust_id, o_orderdate AS gmt_modified, o_totalprice AS total_price FROM orders")
def txt3(spark, sf):
    orders = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("OrderKey"), F.col("o_custkey").alias("CustID"), F.col("o_orderdate").alias("GMT_MODIFIED"), F.col("o_totalprice").alias("totalPrice"))
    return orders.select(*[F.col(c).alias(text.snake(c)) for c in orders.columns])


@check("txt4_group1_all", "SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1), '|') AS links FROM pages")
def txt4(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.array_join(text.group1_all("html", 'href="/([^"]*)"'), "|").alias("links"))


@check("txt5_replace_group1", "SELECT page_id, CASE WHEN regexp_matches(html, 'href=\"/([^\"]*)\"') THEN regexp_replace(html, '(href=\"/)([^\"]*)(\")', '\\1X\\3', 'g') END AS html FROM pages")
def txt5(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.replace_group1("html", 'href="/([^"]*)"', "X").alias("html"))


@check("txt5_replace_group1_spans", "SELECT doc_id, CASE WHEN regexp_matches(text, '[aeiou]n') THEN regexp_replace(text, '[aeiou]n', '_n', 'g') END AS text FROM documents")
def txt5_spans(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.replace_group1("text", "(?:([aeiou])n)", "_").alias("text"))


@check("txt6_search_blocks", """SELECT page_id, array_to_string(flatten(list_transform(regexp_extract_all(html, '(?s)<nav>(.+?)</nav>', 1), lambda b: regexp_extract_all(b, '>([a-zA-Z]+)<', 1))), '|') AS words FROM pages""")
def txt6(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.array_join(text.search_blocks("html", "(?s)<nav>(.+?)</nav>", ">([a-zA-Z]+)<"), "|").alias("words"))


@check("txt7_server_list", """SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN '10.0.0.' || s_nationkey || ':3306' WHEN s_nationkey < 16 THEN 'fd15::' || s_nationkey || ':9633' ELSE '' END AS first,
 CASE WHEN s_acctbal < 0 THEN '' ELSE 'db' || s_suppkey || ':3307' END AS last FROM supplier""")
def txt7(spark, sf):
    """A balancer text per supplier: an own address, a commented one or none, then a second line."""
    nation = F.col("s_nationkey")
    key = F.col("s_suppkey").cast("string")
    first = F.when(nation < 8, F.concat(F.lit("  server a 10.0.0."), nation, F.lit(":3306 check"))).when(
        nation < 16, F.concat(F.lit("  server a 10.0.0.1:3306 check # fd15::"), nation, F.lit(":9633"))).otherwise(F.lit("  server a 10.0.0.1:3306 # none"))
    second = F.concat(F.when(F.col("s_acctbal") < 0, F.lit("  # server b db")).otherwise(F.lit("  server b db")), key, F.lit(":3307"))
    body = F.concat_ws("\n", F.lit("listen mysql-ro"), first, second, F.lit("# MySQLClusterConfigEnd"))
    servers = read(spark, sf, "supplier").select("s_suppkey", nation.alias("n"), text.server_list(body).alias("list"))
    has_first = F.col("n") < 16
    return servers.select(
        "s_suppkey",
        F.when(has_first, F.get("list", F.lit(0))).otherwise(F.lit("")).alias("first"),
        F.coalesce(F.get("list", F.when(has_first, F.lit(1)).otherwise(F.lit(0))), F.lit("")).alias("last"))


@check("txt8_split_address", "SELECT s_suppkey, 'fd15::' || s_nationkey AS host, cast(3306 + s_suppkey AS INTEGER) AS port FROM supplier")
def txt8(spark, sf):
    address = F.concat(F.lit("fd15::"), F.col("s_nationkey"), F.lit(":"), F.col("s_suppkey") + 3306)
    return read(spark, sf, "supplier").select("s_suppkey", text.split_address(address).alias("a")).select("s_suppkey", "a.host", "a.port")


@check("txt10_camel_to_words", "SELECT p_partkey, regexp_replace(regexp_replace(s, '(.)([A-Z][a-z]+)', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS words FROM (SELECT p_partkey, replace(p_type, ' ', '') || 'SlaveIoRunning' || p_brand AS s FROM part)")
def txt10(spark, sf):
    name = F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit("SlaveIoRunning"), F.col("p_brand"))
    return read(spark, sf, "part").select("p_partkey", text.camel_to_words(name).alias("words"))


@check("txt11_letters_digits", "SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{Nd}]', '', 'g') AS text FROM documents")
def txt11(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.letters_digits("text").alias("text"))


_MIXED = "'é测' || c_custkey || '试ü' || c_name"


@check("txt12_left_bytes", f"""SELECT c_custkey, cast(k + short AS BIGINT) AS chars, left(t, k) || repeat(chr(65533), short) AS cut FROM (SELECT *, CASE WHEN strlen(left(t, k)) < 10 THEN 1 ELSE 0 END AS short FROM
 (SELECT *, list_max(list_transform(range(0, 21), lambda n: CASE WHEN strlen(left(t, n)) <= 10 THEN n ELSE 0 END)) AS k FROM (SELECT c_custkey, {_MIXED} AS t FROM customer)))""")
def txt12(spark, sf):
    """Ten bytes of texts with characters of one to three bytes; one cut in the middle is shown as replaced."""
    rows = read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("é测"), F.col("c_custkey").cast("string"), F.lit("试ü"), "c_name").alias("t"))
    cut = text.left_bytes("t", 10)
    return rows.select("c_custkey", F.char_length(cut).cast("long").alias("chars"), cut.alias("cut"))


@check("txt13_equals_any_ci", "SELECT o_orderkey, lower(o_orderpriority) IN ('1-urgent', '2-high') AS hit FROM orders")
def txt13(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.equals_any_ci("o_orderpriority", ["1-Urgent", "2-high"]).alias("hit"))


@check("txt14_split_trim", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''), '|') AS parts FROM documents")
def txt14(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(text.split_trim("text", "."), "|").alias("parts"))


@check("tim1_parse_time", "SELECT event_id, date_trunc('second', ts) AS t FROM events")
def tim1(spark, sf):
    return read(spark, sf, "events").select("event_id", times.parse_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("t"))


@check("tim2_duration_ms", "SELECT event_id, cast(floor(round(value * 100) * 10) AS BIGINT) AS ms, CASE WHEN event_type = 'view' THEN NULL ELSE user_id * 61000 + 500 END AS mixed FROM events")
def tim2(spark, sf):
    seconds = F.concat(F.col("value").cast("string"), F.lit(" s"))
    mixed = F.when(F.col("event_type") == "view", F.lit("soon")).otherwise(F.format_string("%dm%d.5s", F.col("user_id"), F.col("user_id")))
    return read(spark, sf, "events").select("event_id", times.duration_ms(seconds).alias("ms"), times.duration_ms(mixed).alias("mixed"))


@check("tim3_epoch_ns", "SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def tim3(spark, sf):
    return read(spark, sf, "events").select("event_id", times.epoch_ns("ts").alias("ns"))


@check("tim4_ns_to_s", "SELECT event_id, (event_id * 1500000000) / 1000000000 AS s FROM events")
def tim4(spark, sf):
    return read(spark, sf, "events").select("event_id", times.ns_to_s(F.col("event_id") * 1500000000).alias("s"))


@check("tim5_compact_time", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS t FROM events")
def tim5(spark, sf):
    return read(spark, sf, "events").select("event_id", times.compact_time("ts").alias("t"))


@check("tim6_time_or", "SELECT event_id, CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END AS t FROM events")
def tim6(spark, sf):
    missing = F.when(F.col("event_type") != "view", F.col("ts"))
    return read(spark, sf, "events").select("event_id", times.time_or(missing, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("t"))


@check("log1_flag_equals", "SELECT event_id, cast(event_type = 'click' AS INTEGER) AS flag FROM events")
def log1(spark, sf):
    return read(spark, sf, "events").select("event_id", scalars.flag_equals("event_type", "click").alias("flag"))


@check("jsn1_json_of", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def jsn1(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", scalars.json_of(F.struct("n_name", "n_regionkey")).alias("json"))


@check("arr1_key_path", "SELECT event_id, 'replication/pipeline/' || user_id || '/insertCount' AS path FROM events")
def arr1(spark, sf):
    keys = scalars.key_path("replication", "pipeline", F.col("user_id"), "insertCount")
    return read(spark, sf, "events").select("event_id", F.array_join(keys, "/").alias("path"))
