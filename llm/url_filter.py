"""URL verdicts: host and path rules, then a list of canonical URLs behind a blocked Bloom filter. DataFrame functions only.

A canonical URL is its host (A-Z lower-cased) and path. The list is packed into blocks of 256 bits: a URL's hash
picks its block and one bit in each of four words. Pages meet the blocks by a join on the block number, which Spark
broadcasts only while the blocks are below its own limit; possible hits then meet the list itself in an exact join,
so no false positive stays. Pages without a possible hit never enter that join.

Rules are a short parameter list and become one expression; the longest that fits wins over the list.

Nulls: a null URL, or one without ``://``, has empty host and path, fits no rule and is not listed: allowed. Null and
repeated list entries count once. Repeated pages all come out. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # verdict, host, path
_BITS_PER_URL = 12
_WORDS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(_WORDS)]


def bloom_blocks(urls: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of a column ``url`` of listed canonical URLs."""
    one = [F.expr("1L")] * _WORDS
    words = [F.call_function("shiftleft", o, b) for o, b in zip(one, _bits(F.col("url")))]
    rows = urls.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: id, host, path, rule, verdict. ``listed`` has one column: canonical URLs (host and path) to block."""
    urls = listed.select(F.col(listed.columns[0]).cast("string").alias("url")).filter("url IS NOT NULL").distinct()
    blocks = max(1, -(-urls.count() * _BITS_PER_URL // (64 * _WORDS)))
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    canonical = F.concat("host", "path")
    rows = rows.select("*", rule.alias("rule"), verdict.alias("_verdict"), canonical.alias("_key"), F.pmod(F.xxhash64(canonical), F.lit(blocks)).alias("_block"))
    bloom = bloom_blocks(urls, blocks)
    probed = rows.join(bloom, F.col("_block") == F.col("block"), "left")
    may = F.col("_verdict").isNull() & F.col("block").isNotNull()
    for i, bit in enumerate(_bits(F.col("_key"))):
        may = may & (F.call_function("shiftrightunsigned", F.col(f"w{i}"), bit).bitwiseAND(F.lit(1)) == 1)
    probed = probed.select("_id", "host", "path", "rule", "_verdict", "_key", F.coalesce(may, F.lit(False)).alias("_may"))
    hits = probed.filter("_may").join(urls, F.col("_key") == F.col("url"), "left")
    hits = hits.withColumn("_verdict", F.when(F.col("url").isNotNull(), F.lit("block"))).drop("url")
    both = hits.unionByName(probed.filter("NOT _may"))
    return both.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", F.lit("allow")).alias("verdict"))
