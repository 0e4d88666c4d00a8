"""The registered queries of the numbered operators: op<N>_<name>(spark, sf_dir), and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, collocations, decontaminate, imatch, main_text, near_dedup, prefix_trie, private_data, quality, repeats, shard_tree, token_files, url_filter
from llm.common import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query("op6_near_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf, "documents"), threshold=0.85)


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    cut = repeats.remove_repeats(read(spark, sf, "documents"), width=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_bpe")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(read(spark, sf, "documents").select("doc_id", "text"), path).drop("text")
    text = bpe.decode(coded, path)
    return text.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_token_files")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(read(spark, sf, "documents"), tokenizer, folder)
    size = bpe.vocabulary(tokenizer).size
    rows = token_files.read_tokens(spark, folder, size).withColumnRenamed("id", "doc_id")
    # crc32 reads four little-endian bytes of each id
    return rows.mapInArrow(token_files.checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op3_imatch")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    rows = imatch.compare_with_edits(read(spark, sf, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


# The rules of the query, and host labels of the unwanted sites in the pages
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UNWANTED = ["casino-win", "cheap-pills", "free-bets"]

_HOST = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP4 = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
 WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
 WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
listed AS (SELECT DISTINCT host, path FROM p WHERE regexp_matches(host, '(^|[.])(casino-win|cheap-pills|free-bets)[.]'))
SELECT page_id, r.host, r.path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
 WHEN listed.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM r LEFT JOIN listed ON r.host = listed.host AND r.path = listed.path"""


@query("op4_url_filter", _OP4)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages")
    host, path = url_filter.host_and_path(F.col("url"))
    listed = pages.filter(host.rlike(r"(^|[.])(" + "|".join(UNWANTED) + r")[.]")).select(F.concat(host, path).alias("url"))
    return url_filter.judge(pages, RULES, listed)


def _tree_sql(tree: shard_tree.Tree) -> str:
    def draw(node: str, weight: float) -> str:
        return f"-ln((cast('0x' || substr(md5('{node}|' || key), 1, 13) AS BIGINT) + 0.5) / {1 << 52}.0) / {weight}"

    def least(nodes: list[tuple[str, str]]) -> str:
        return "list_sort([" + ", ".join(f"{{'d': {d}, 'i': {i}, 'v': {v}}}" for i, (d, v) in enumerate(nodes)) + "])[1].v"

    regions = []
    for region, racks in tree.items():
        inner = [(draw(f"{region}/{k}", sum(s.values())), least([(draw(f"{region}/{k}/{n}", w), str(n)) for n, w in s.items()])) for k, s in racks.items()]
        regions.append((draw(region, sum(w for s in racks.values() for w in s.values())), least(inner)))
    return least(regions)


def _crc_sql() -> str:
    """CRC-32 over a list of byte texts ``h``, four bits at a time."""
    step = "xor(c, b)"
    table = "[" + ", ".join(str(_crc_entry(n)) for n in range(16)) + "]"
    for _ in range(2):
        step = f"xor(({step}) >> 4, {table}[(({step}) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(h, lambda x: cast('0x' || x AS BIGINT))), lambda c, b: {step}), 4294967295)"


def _crc_entry(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (n & 1) * 0xEDB88320
    return n


_OP10 = f"""WITH k AS (SELECT doc_id, text, cast(doc_id AS VARCHAR) AS key, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
s AS (SELECT doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {_crc_sql()} AS text_crc32, 'key' AS law,
 cast({_tree_sql(shard_tree.even_tree(8))} AS INTEGER) AS shard, cast({_tree_sql(shard_tree.grown(shard_tree.even_tree(8), 8))} AS INTEGER) AS grown_shard FROM k)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM s"""


@query("op10_sharding", _OP10)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return shard_tree.shard(read(spark, sf, "documents"), 8)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op9_quality")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    model = quality.train(docs, read(spark, sf, "labels").filter(~held_out()))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_decontaminate")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), F.col("leaks.item_id").alias("item_ids"))


@query("op8_main_text")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages")
    return main_text.extract(pages, main_text.train(pages))


_OP13 = """WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, len(w) AS k FROM w WHERE len(w) > 0),
one AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w) AS w1 FROM g) GROUP BY ALL),
two AS (SELECT lang, x.a AS w1, x.b AS w2, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(list_transform(range(1, k), lambda i: {'a': w[i], 'b': w[i + 1]})) AS x FROM g WHERE k > 1) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, x.a AS w1, x.b AS w2, x.c AS w3, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(list_transform(range(1, k - 1), lambda i: {'a': w[i], 'b': w[i + 1], 'c': w[i + 2]})) AS x FROM g WHERE k > 2) GROUP BY ALL HAVING count(*) >= 10),
inner2 AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY ALL),
c AS (SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, (1000000 * t.f * t.f) // (x.f * y.f) AS score FROM two t
 JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
 LEFT JOIN inner2 i ON i.lang = t.lang AND i.w1 = t.w1 AND i.w2 = t.w2 WHERE i.f IS NULL OR 100 * i.f < 50 * t.f
UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM (
 SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
  (1000000 * t.f * t.f) // (x.f * yz.f) AS s1, (1000000 * t.f * t.f) // (xy.f * z.f) AS s2 FROM three t
 JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one z ON z.lang = t.lang AND z.w1 = t.w3
 JOIN two xy ON xy.lang = t.lang AND xy.w1 = t.w1 AND xy.w2 = t.w2 JOIN two yz ON yz.lang = t.lang AND yz.w1 = t.w2 AND yz.w2 = t.w3)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM c)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM k JOIN total USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", _OP13)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(read(spark, sf, "documents"))


_OP12 = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, regexp_extract_all(hex(encode(cast(conv_id AS VARCHAR))), '..') AS h FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS lender, ({_crc_sql()}) % 4 AS k FROM i),
r AS (SELECT c.conv_id, 0 AS part, n, role, text FROM c JOIN t ON t.conv_id = c.lender AND n <= k UNION ALL SELECT c.conv_id, 1, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND n > k),
d AS (SELECT conv_id, text, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || ':' || text), '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)),
a AS (SELECT conv_id, '' AS text, 0 AS depth, '' AS path FROM c UNION ALL SELECT * FROM d),
m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM a),
x AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS own,
 sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
u AS (SELECT x.*, (SELECT count(*) FROM x y WHERE y.depth = x.depth + 1 AND starts_with(y.path, x.path)) AS n_children FROM x),
v AS (SELECT u.path, count(*) FILTER (WHERE z.n_children = 0) AS n_leaves, sum(z.own)::BIGINT AS saved_tokens FROM u JOIN u z ON starts_with(z.path, u.path) GROUP BY 1)
SELECT u.conv_id, u.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, u.n_convs, u.n_children, n_leaves, saved_tokens, u.ends_sha256
 FROM u JOIN v USING (path) LEFT JOIN x q ON q.depth = u.depth - 1 AND q.path = left(u.path, 32 * (u.depth::INT - 1))"""


@query("op12_prefix_trie", _OP12)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf, "conversations"), share=True)


@query("op11_private_data")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    found = private_data.find(docs, private_data.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in private_data.KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
