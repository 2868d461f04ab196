"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact hash join for the possible hits.

Everything runs as DataFrame expressions. A rule is a host and a path; its canonical key is host + path. A url's candidate
keys are the ends of its host that have a listed host's length and are a domain, each with the starts of its path that have the length of a path
listed for such hosts; a rule fits exactly if its key is among them. So the list bounds a url's candidates, however many labels its host has.
Urls none of whose candidates pass the filter are settled in the scan, without a shuffle.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, spread_join, table

#: A filter block has eight words of 32 bits: a key sets one bit in each word.
WORDS = 8
#: Bits a listed key gets, and the filter's bound: more keys than this allows only cost more exact lookups.
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 15

#: The rules of the query: (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? # or the end. Both empty without ://."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    has = F.instr(u, "://") > 0
    rest = F.when(has, F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _masks(key: Column) -> list[Column]:
    """One bit for each word of the key's block, from a second hash: five bits of it for each word."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(keys: DataFrame, key: str, n: int) -> tuple[int, list[list[int]]]:
    """(blocks, words by block) of n keys. At most MAX_BLOCKS * WORDS numbers reach the driver, whatever the list's size."""
    blocks = max(1, min(MAX_BLOCKS, 1 << math.ceil(math.log2(max(1, n * BITS_PER_KEY / (32 * WORDS))))))
    made = keys.select(_block(F.col(key), blocks).alias("b"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    rows = made.groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).collect()
    words = [[0] * WORDS for _ in range(blocks)]
    for r in rows:
        words[r["b"]] = [r[f"w{i}"] for i in range(WORDS)]
    return blocks, words


def might_contain(key: Column, blocks: int, words: list[list[int]]) -> Column:
    """Whether the filter may hold the key; the filter is a literal of one array for each word. Never false for a listed key."""
    at = _block(key, blocks).cast("int")
    test = F.lit(True)
    for i, m in enumerate(_masks(key)):
        column = F.from_json(F.lit("[" + ",".join(str(w[i]) for w in words) + "]"), "array<bigint>") if blocks > 8 else F.array(*[F.lit(w[i]).cast("long") for w in words])
        test = test & (F.get(column, at).bitwiseAND(m) != 0)
    return test


def filter_urls(pages: DataFrame, url_col: str, rules: DataFrame, keep: list[str], default: str = "allow") -> DataFrame:
    """keep columns, host, path, rule, verdict for each row of pages.

    rules: (host, path, verdict). A rule fits its host and all subdomains when the url's path starts with the rule's path. The longest key
    (host and path together) wins, equal lengths go to the smaller key; of rules listed twice the smaller verdict ("allow"
    before "block") holds. Null and malformed urls have an empty host and path and get the default verdict, as do urls without
    a fitting rule; an empty host matches no rule. Rules with a null host, path or verdict are ignored. Repeated rows stay. pages must be a scan or a
    checkpoint, see spread_join.
    """
    listed = rules.select(F.translate("host", _UPPER, _LOWER).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("rule_verdict"))
    listed = listed.where("h is not null and p is not null and rule_verdict is not null and h <> ''")
    listed = listed.groupBy("h", "p").agg(F.min("rule_verdict").alias("rule_verdict")).withColumn("key", F.concat("h", "p"))
    by_host = listed.groupBy(F.length("h").alias("h")).agg(F.count("*").alias("n"), F.collect_set(F.length("p")).alias("p")).collect()  # pairs of lengths: as many as urls are long
    blocks, words = bloom_filter(listed, "key", sum(r["n"] for r in by_host))

    host, path = split_url(F.col(url_col))
    base = pages.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    lengths = F.from_json(F.lit(json.dumps([{"h": r["h"], "p": sorted(r["p"])} for r in sorted(by_host)])), "array<struct<h:int,p:array<int>>>")
    size = F.length("host")
    domain = lambda x: (x["h"] <= size) & ((x["h"] == size) | (F.substring("host", size - x["h"], F.lit(1)) == "."))
    starts = lambda x: F.transform(F.filter(x["p"], lambda n: n <= F.length("path")), lambda n: F.concat(F.substring("host", size - x["h"] + 1, x["h"]), F.substring("path", F.lit(1), n)))
    keys = F.flatten(F.transform(F.filter(lengths, domain), starts))
    keys = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(keys)
    base = base.withColumn("_cand", F.filter(keys, lambda k: might_contain(k, blocks, words)))
    out = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]

    # Exact joins on the possible hits only, once for each distinct host and path; keys that many hosts share and urls that many pages share are spread.
    hits = base.where(F.size("_cand") > 0)
    asked = cut(hits.groupBy("host", "path").agg(F.first("_cand").alias("_cand"), F.count("*").alias("_n")))
    tried = cut(asked.select("host", "path", F.explode("_cand").alias("key")))
    keyed = listed.join(tried.groupBy("key").agg(F.count("*").alias("_n")), "key")
    found = spread_join(tried, keyed, ["key"], "_n", tried.count())
    # A key is host + path of a rule; the split must be where the url's own host ends.
    found = found.where((F.col("host") == F.col("h")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("h")))).where(F.startswith("path", F.col("p")))
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.length("key")).alias("n"), "key", "rule_verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.key").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    best = best.join(asked.select("host", "path", "_n"), ["host", "path"])
    judged = spread_join(hits, best, ["host", "path"], "_n", asked.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], "left")
    judged = judged.select(*out, "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
    clear = base.where(F.size("_cand") == 0).select(*out, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(clear)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page. A rule is written host + path, as in its list."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), "url", rules, ["page_id"])


ORACLE = """
WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id,
        CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT s.*, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC NULLS LAST, h || p) AS k
      FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
