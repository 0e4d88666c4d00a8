import pytest
from pyspark.sql import functions as F

from lagscope.functions import scalars, text, times
from lagscope.operators.naming import smallest_free_suffix, unused

BALANCER = """
# MySQLClusterConfigStart
frontend orders
  bind :3399
listen mysql-ro
  balance leastconn
  server left 192.0.2.10:7001 weight 5 # 2001:db8:7::21:7001
  server middle 192.0.2.20:7001 weight 5 # 2001:db8:7::22:7001
  SERVER right 192.0.2.30:3306
  # server away 192.0.2.40:3306
  server resting 192.0.2.50:3306 # for repair
# MySQLClusterConfigEnd
"""

TWO_BLOCKS = """alpha {
 pool writers
  node p1 198.51.100.1:5000 fast
  node p2 198.51.100.2:5000
}
 pool readers
  node q1 198.51.100.7:5000 slow
  NODE q2 198.51.100.8
  node q3 198.51.100.9:5001
} omega"""


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn("v").alias("out")).orderBy("i").collect()]


def test_quoting(spark):
    cases = {
        "测试": '"测试"',
        'a"b\\c\nd\te': '"a\\"b\\\\c\\nd\\te"',
        "x y\u0001z\U0001f600﻿\u007f": '"x\\u00a0y\\x01z\U0001f600\\ufeff\\x7f"',
        "\u0007\u0008\u000b\u000c\r": '"\\a\\b\\v\\f\\r"',
        "": '""',
    }
    assert values(spark, list(cases), text.quote_text) == list(cases.values())


def test_float_text(spark):
    cases = {0.0: "0", 123456.0: "123456", 1234567.0: "1.234567e+06", 1e6: "1e+06", 999999.5: "999999.5", 1.5e-5: "1.5e-05",
             0.0001234: "0.0001234", 0.00123: "0.00123", -2.5: "-2.5", 1e21: "1e+21", 1e100: "1e+100", 1e-4: "0.0001", 100.0: "100",
             float("inf"): "+Inf", float("-inf"): "-Inf"}
    assert values(spark, list(cases), text.float_text, "double") == list(cases.values())
    assert values(spark, [float("nan"), -0.0, None], text.float_text, "double") == ["NaN", "-0", None]


def test_names():
    cases = {"IncrID": "incr_id", "MyNote": "my_note", "PipelineID": "pipeline_id", "TYPE": "type", "ID": "id", "InsertCount": "insert_count",
             "DELAY_TIME": "delay_time", "GMT_MODIFIED": "gmt_modified", "delay": "delay"}
    assert {k: text.snake(k) for k in cases} == cases
    assert text.camel_name_to_words("SlaveIoRunning") == "Slave Io Running"


def test_group_count():
    assert [text.capture_groups(p) for p in ("a", "(a)", r"\(a", "(?:a)(b)", "(?<n>a)(?=b)", "[(](a)", "(?i)(a(b))")] == [0, 1, 0, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        text.group1_all("c", "abc")


def test_replace_group1(spark):
    number = r"(?i)server[-_]id\s*=\s*(\d+)"
    got = values(spark, ["a=b\nserver_id=0\nc=d\nserver_id=3", "none", None], lambda c: text.replace_group1(c, number, "123456"))
    assert got == ["a=b\nserver_id=123456\nc=d\nserver_id=123456", None, None]
    got = values(spark, ["START\na\nb\nEND"], lambda c: text.replace_group1(c, r"(?is)START(.+)END", "\nHAHA\n"))
    assert got == ["START\nHAHA\nEND"]
    assert values(spark, ["x1y x2y"], lambda c: text.replace_group1(c, r"x(\d)y", "$1\\")) == ["x$1\\y x$1\\y"]
    # Nested groups stay in the JVM; where a match may lack group 1 they do not.
    assert text._around_group1(r"(?:k=(\d+))") and text._around_group1(r"k(?i)=(\d+)") is None
    assert text._around_group1(r"(?:x|y(\d))z") is None and text._around_group1(r"(?:(a))?b") is None and text._around_group1(r"(?:x|y)(a)")
    assert text._around_group1(r"a|(b)") is None and text._around_group1(r"(a)+") is None and text._around_group1(r"(a)\1") is None
    assert values(spark, ["k=1 k=22", "k=", None], lambda c: text.replace_group1(c, r"(?:k=(\d+))", "9")) == ["k=9 k=9", None, None]
    assert values(spark, ["k=1 k=22", "k="], lambda c: text.replace_group1(c, r"k=((\d)+)( |$)", "9")) == ["k=9 k=9", None]


def test_replace_group1_nested_optional_and_java_only(spark):
    def run(inputs, pattern, repl="Q"):
        return values(spark, inputs, lambda c: text.replace_group1(c, pattern, repl))

    assert run(["xAby Cb"], r"(?:(\p{Lu})b)") == ["xQby Qb"]
    assert run(["abcefghi abdefghi"], r"(?:a(?:b(c|d)(e))f(g))h(i)", "7$") == ["ab7$efghi ab7$efghi"]
    assert run(["xb", "ab", "cab"], r"(a)?b") == [None, "Qb", "cQb"]  # a match without group 1
    assert run(["k1", "j", "k1 j"], r"k(\d)|j") == ["kQ", None, None]
    assert run(["b", "c"], r"(a*)b") == ["Qb", None] and run(["b"], r"(?:(a*)b|z)") == ["Qb"]  # an empty group at the start
    assert run(["k1"], r"k(\d)", "5") == ["k5"]
    with pytest.raises(ValueError):
        text.replace_group1("c", r"(\p{Lu})?b", "Q")
    plan = spark.createDataFrame([("k=1",)], "v string").select(text.replace_group1("v", r"(?:k=(\d))", "9").alias("o"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_blocks_and_servers(spark):
    got = values(spark, [TWO_BLOCKS], lambda c: text.search_blocks(c, r"(?is)readers(.+)omega", r"(?i)node\s+\S+\s(\d+(\.\d+){3})(:\d+)?"))
    assert got == [["198.51.100.7", "198.51.100.8", "198.51.100.9"]]
    assert values(spark, [BALANCER, "nothing", None], text.server_list) == [
        ["2001:db8:7::21:7001", "2001:db8:7::22:7001", "192.0.2.30:3306"], None, None]


def test_small_helpers(spark):
    assert [tuple(v) for v in values(spark, ["fd15::4:9633", "h:1", "plain"], text.split_address)] == [("fd15::4", 9633), ("h", 1), (None, None)]
    assert values(spark, ["abc", "x"], lambda c: text.contains_any(c, ["a"])) == [True, False]
    assert values(spark, ["abc"], lambda c: text.contains_any(c, ["d", "e"])) == [False]
    assert values(spark, ["  # x", "a # x", ""], text.drop_comments) == [False, True, True]
    assert values(spark, ["t_bak", "t_bak12x", "_bak1", "t"], text.is_backup_name) == [True, True, False, False]
    assert values(spark, ["a-b_c 9é!"], text.letters_digits) == ["abc9é"]
    assert values(spark, ["测试", "abcdef", "ab"], lambda c: text.left_bytes(c, 3)) == ["测", "abc", "ab"]
    assert values(spark, ["YES", "no"], lambda c: text.equals_any_ci(c, ["yes"])) == [True, False]
    assert values(spark, [" a ,, b　,"], lambda c: text.split_trim(c, ",")) == [["a", "b"]]
    assert values(spark, ["SlaveIoRunning", "LastIOError"], text.camel_to_words) == ["Slave Io Running", "Last IO Error"]
    assert values(spark, ["a,b=c d\\"], text.escape_key) == ["a\\,b\\=c\\ d\\"]


def test_times(spark):
    assert values(spark, ["1.213 s", "1h2m3.5s", "x", "-3ms", "1.9999ms", "12", "1500us"], times.duration_ms) == [1213, 3723500, None, -3, 1, None, 1]
    got = values(spark, ["2020-04-14 08:27:35", "0000-00-00 00:00:00", ""], lambda c: times.epoch_ns(times.parse_time(c)))
    assert got == [1586852855000000000, None, None]
    assert values(spark, ["2020-04-14 08:27:35"], lambda c: times.compact_time(times.parse_time(c))) == ["20200414082735"]
    assert values(spark, [1500000000], times.ns_to_s, "long") == [1.5]


def test_scalars(spark):
    assert values(spark, ["工作中", "停止", None], scalars.flag_equals) == [1, 0, 0]
    pretty = values(spark, ["x"], lambda c: scalars.json_of(F.struct(F.col(c).alias("a")), pretty=True))[0]
    assert pretty.replace(" ", "").replace("\n", "") == '{"a":"x"}' and "\n" in pretty
    assert values(spark, [7], lambda c: scalars.key_path("root", F.col(c), "state"), "long") == [["root", "7", "state"]]


def test_free_suffix(spark):
    names = ["t", "t_bak1", "t_bak3", "u", "v", "v_bak", "v_bak01", "v_bakx", "w_bak1_bak1", "w", "x", "x_bak1", "x_bak2", "y_bak1"]
    df = spark.createDataFrame([("s", n) for n in names] + [("r", "t")], "schema string, name string")
    out = {(r["schema"], r["name"]): r.free_name for r in smallest_free_suffix(df, by=["schema"]).collect()}
    assert out == {("s", "t"): "t_bak2", ("s", "u"): "u_bak1", ("s", "v"): "v_bak1", ("s", "w"): "w_bak1", ("s", "x"): "x_bak3", ("r", "t"): "t_bak1"}


def test_free_suffix_against_brute_force(spark):
    import random

    rng = random.Random(3)
    taken = {(f"n{rng.randrange(4)}", rng.randrange(1, 60)) for _ in range(120)}
    names = [f"n{i}" for i in range(4)] + [f"{n}_bak{s}" for n, s in taken]
    out = {r["name"]: r.suffix for r in smallest_free_suffix(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert out == {f"n{i}": next(k for k in range(1, 99) if (f"n{i}", k) not in taken) for i in range(4)}


def test_unused(spark):
    a, b = spark.range(5), spark.range(3)
    assert sorted(r.id for r in unused(a, b, ["id"]).collect()) == [3, 4]
