"""Operators that have SQL: against DuckDB on the tables, and on small awkward inputs."""

import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, queries, topk_search, url_filter
from millrace.llm.common import spread_join


def rows_of(rows, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op6_secrets", "op7_topk_search", "op10_url_filter"])
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got.collect(), columns) == sorted(tuple(str(x) for x in r) for r in want.select(", ".join(columns)).fetchall())


def test_exact_dedup_cases(spark):
    rows = [(1, "a b"), (2, "ab "), (3, "a\tb  "), (4, None), (5, ""), (6, "ab\u00a0"), (7, "x" * 100_000), (8, "x" * 100_000 + " "), (9, "solo"), (None, "solo "), (10, "dup"), (10, "dup"), (11, "same id 1"), (11, "same id 2")]
    docs = spark.createDataFrame([(i, t, "k", True) for i, t in rows], "doc_id long, text string, keep_id string, id boolean")
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows) and "keep_id" in got[0].asDict()
    keep = {(r.doc_id, r.text): (r.keep_id, r.group_size, r.kept) for r in got}
    assert keep[1, "a b"] == (3, 3, False) and keep[3, "a\tb  "] == (3, 3, True) and keep[2, "ab "][0] == 3
    assert keep[4, None] == (4, 2, True) and keep[5, ""] == (4, 2, False) and keep[6, "ab\u00a0"] == (6, 1, True)
    assert keep[8, "x" * 100_000 + " "] == (8, 2, True) and keep[7, "x" * 100_000] == (8, 2, False)
    assert keep[9, "solo"] == (None, 2, False) and keep[None, "solo "] == (None, 2, True)
    assert keep[10, "dup"] == (10, 2, True) and keep[11, "same id 1"] == (11, 1, True)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    stay = exact_dedup.first_of_each(docs).collect()
    assert sorted(map(repr, stay)) == sorted(repr(r) for r in docs.collect() if keep[r.doc_id, r.text][2])
    assert exact_dedup.first_of_each(docs.limit(0)).count() == 0


def test_exact_dedup_clashing_names(spark):
    names = ["_id", "_n", "_h", "_keep", "_hash", "_gone", "_own", "_text", "_salt", "_few", "_many", "full_hash", "size", "len", "points", "name", "kept", "_c0"]
    docs = spark.createDataFrame([(1, "a b", *range(len(names))), (2, "ab", *range(len(names))), (3, "c", *range(len(names)))], ["doc_id", "text", *names])
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert (got[1].keep_id, got[1].kept, got[2].keep_id, got[2].kept, got[3].group_size) == (1, True, 1, False, 1) and got[2]["_keep"] == 3
    assert sorted(r.doc_id for r in exact_dedup.first_of_each(docs).collect()) == [1, 3]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join(spark, how):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"))
    keyed = rows.where("k < 300").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = spread_join(rows, keyed, ["k"], "n", 2000, how)
    want = rows.join(keyed.drop("n"), "k", how).select(*got.columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spread_join(rows, keyed, ["k"], "n", 2000, how)._jdf.queryExecution().sparkPlan().toString()
        assert re.search(r"SortMergeJoin \[k#\d+L, _salt#\d+\]", plan), plan  # the salt is a key, not a condition
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_long_and_random_hosts(spark):
    """A host of a million labels costs what the list costs, not the square of its labels."""
    rng = np.random.default_rng(8)
    part = lambda most: ".".join(rng.choice(["a", "b", "ab", "", "xn--é"], rng.integers(1, most)))
    rules = sorted({(part(4), "/" + "x" * int(rng.integers(0, 4)), ("allow", "block")[int(rng.integers(2))]) for _ in range(60)} | {("com", "/", "block")})
    rules = list({(h, p): (h, p, v) for h, p, v in reversed(rules) if h}.values())
    urls = [f"h://{part(6)}/{'x' * int(rng.integers(0, 5))}?{part(3)}" for _ in range(300)] + ["http://" + "." * 1_000_000 + "com/x", "http://" + "a." * 300_000 + "b", "http://" + "b" * 1_000_000, "http://com/" + "x" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(pages, "url", spark.createDataFrame(rules, "host string, path string, verdict string"), ["page_id"]).collect()
    assert len(got) == len(urls)
    for r in got:
        host, _, path = urls[r.page_id].split("://", 1)[1].split("?")[0].partition("/")
        path = "/" + path if "/" in urls[r.page_id].split("://", 1)[1].split("?")[0] else ""
        fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.rule, r.verdict) == (min(fits)[1:] if fits else (None, "allow")), urls[r.page_id][:80]


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q=/en/", "https://example.com", "ftp://com/en/", "x://notexample.com/en/1", "http://a.net/de/#f", "http://example.net/de/8", "http://b.org/es/é", "http://org/ES/", "://x.com/en/", "http://com.evil/en/", "http://u@x.com:80/en/", "http://q.com?/en/"]
    rules = spark.createDataFrame([*url_filter.RULES, ("com", "/en/", "block"), (None, "/", "block"), ("", "/en/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, urls[3], "h", "r"), (3, urls[3], "h", "r")], "page_id long, url string, host string, rule string")

    def judge(url):
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[1], best[2] if best else "allow"

    got = url_filter.filter_urls(pages, "url", rules, ["page_id", "url"]).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(r.url), r.url
    assert url_filter.filter_urls(pages.limit(0), "url", rules, ["page_id"]).count() == 0
    none = url_filter.filter_urls(pages, "url", rules.limit(0), ["page_id"])
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_rules_of_the_query(spark, tmp_path):
    """Each rule's word as the contract lists it, written out here and not taken from the code."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"),
        "http://www.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/71": ("net/de/", "allow"), "http://a.org/es/1": ("org/es/", "block"), "http://a.org/en/1": (None, "allow"),
    }
    urls = list(want)
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {urls[r.page_id]: (r.rule, r.verdict) for r in url_filter.op10_url_filter(spark, str(tmp_path)).collect()}
    assert got == want


def test_bloom_filter_never_misses(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks, words = url_filter.bloom_filter(keys, "key", 5000)
    assert keys.where(~url_filter.might_contain(F.col("key"), blocks, words)).count() == 0
    other = spark.range(5000).select(F.concat(F.lit("q"), "id").alias("key"))
    assert other.where(url_filter.might_contain(F.col("key"), blocks, words)).count() < 200


def test_top_k_cases(spark):
    same = [0.5, 0.25, -0.5]
    rows = [(i, same) for i in range(0, 40)] + [(100, [0.9, 0.1, 0.0]), (150, [0.1, 0.1, 0.1]), (151, None), (152, [0.1, None, 0.1]), (153, [math.nan, 0.0, 0.0]), (154, [math.inf, 0.0, 0.0]), (200, [1.0, 2.0]), (250, []), (None, same), (100, [0.9, 0.1, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, rank int")
    got = topk_search.exact_top_k(df, "vec_id", "embedding", F.pmod(F.col("id"), F.lit(50)) == 0, 5).collect()
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, x in good:
        if q % 50 == 0:
            a = [math.floor(256 * c) for c in x]
            hits = sorted((-sum(s * math.floor(256 * c) for s, c in zip(a, v, strict=True)), i) for i, v in good if i != q and len(v) == len(x))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(hits[:5])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk_search.exact_top_k(df.limit(0), "vec_id", "embedding", F.col("id") == 0).count() == 0


def test_top_k_of_long_components(spark):
    """Components far beyond 32 bits, products beyond 64: integers of any size, scores held within a long; several batches of queries."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * 10.0 ** float(rng.choice([0, 3, 7]))).tolist()) for i in range(150)]
    rows += [(200, [1e7] * 6), (250, [1e300, -1e300, 0.0, 0.0, 0.0, 1.0]), (251, [1e300] * 6), (252, [-1e12] * 6), (300, [5e11] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    top = 2**63 - 1
    hold = lambda x: min(max(x, -top), top)
    whole = {i: [hold(math.floor(min(256 * c, 1e300))) for c in v] for i, v in rows}
    want = set()
    for q in whole:
        if q % 50 == 0:
            hits = sorted((-hold(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(hits[:5])}
    got = topk_search.exact_top_k(df, "vec_id", "embedding", F.pmod(F.col("id"), F.lit(50)) == 0, 5, batch_bytes=100).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_python_in_native_plans(spark, sf):
    for name in ("op6_secrets", "op10_url_filter"):
        plan = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sources_name_no_forbidden_calls():
    folder = os.path.dirname(queries.__file__)
    for f in os.listdir(folder):
        if f.endswith(".py"):
            text = open(os.path.join(folder, f), encoding="utf-8").read()
            assert "localCheckpoint" not in text and "crossJoin" not in text
