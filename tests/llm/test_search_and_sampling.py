"""Lexical search, BPE by speculation and importance resampling: against brute force, the tokenizers library and awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import importance, lexical_search, speculative_bpe
from millrace.llm.word_tokens import tokenizer_bytes

LIBRARY = Tokenizer.from_file(P.path("word_bpe_49k.json"))
SPECULATOR = speculative_bpe.Speculator(tokenizer_bytes())


# ---------------------------------------------------------------------------------------------- lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, queries, k):
    """(query number, rank, id, score) the plain way; docs: (id, text)."""
    words = [terms(t) for _, t in docs]
    n, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for q, text in enumerate(queries):
        scores = []
        for (i, _), ws in zip(docs, words, strict=True):
            tf = Counter(ws)
            m = 75 + 25 * len(ws) * n // total if total else 0
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in terms(text) if w in tf), i))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("shape", [(4096, 1 << 18, 8192), (2, 1 << 18, 2), (3, 4, 8192)])
def test_search_against_brute_force(spark, shape):
    shard_rows, block_terms, block_queries = shape
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["Ünï", "東京", "x1"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(120)]
    docs += [(200 + i, "the same copy of w1 x1 東京") for i in range(30)] + [(7, docs[7][1]), (7, "x1 " * 3000), (None, "x1 東京 rare"), (None, None), (301, ""), (302, " .,!\x00")]
    queries = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for _ in range(12)] + ["X1 x1 X1 東京", "nowhere", "", None, "the same copy of w1", "Ünï ünï", "w1 w2"]
    left = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in docs], "doc_id long, text string, score int, rank int, ids string").repartition(3)
    right = spark.createDataFrame([(q if q % 5 else None, t, q, "x") for q, t in enumerate(queries)], "item_id int, text string, doc_id int, _q string")
    got = lexical_search.search(left, right, "doc_id", "text", "item_id", "text", 5, block_terms, block_queries, shard_rows).collect()
    want = [(q if q % 5 else None, r, i, s) for q, r, i, s in ranked(docs, queries, 5)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for left, right in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.where("false").union(spark.createDataFrame([(1, None)], docs.schema)), items)):
        assert lexical_search.search(left, right, "doc_id", "text", "item_id", "text").count() == 0


def test_first_bounds_leave_little_to_send(spark, monkeypatch):
    """With bounds of the first pass, tasks send what can still be among the best, not k rows a query each."""
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * 7 + j * j) % 50}" for j in range(30))) for i in range(640)], "doc_id long, text string").repartition(32)
    items = spark.createDataFrame([(q, f"t{q} t{q + 1} t{q + 2}") for q in range(20)], "item_id long, text string")
    sent, plain = [], lexical_search._search_rows
    monkeypatch.setattr(lexical_search, "_search_rows", lambda *a: sent.append(plain(*a)) or sent[-1])
    hits = lexical_search.search(docs, items, "doc_id", "text", "item_id", "text", 5)
    assert hits.count() == 100 and sent[-1].count() < 32 * 100 / 4


def test_queries_match_sql(spark, sf):
    import duckdb

    from millrace.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("op11_lexical_search", "op13_importance"):
        got, want = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str(list(r)) for r in want.select(", ".join(columns)).fetchall()), name


# --------------------------------------------------------------------------------------------------------- BPE


WORDS = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0 ́'tsΣİéa1<|>thanering")), max_size=40)
MARKS = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "x<|endoftext|>́", " "])


def ids_of(text):
    return np.frombuffer(SPECULATOR.encode([text.encode()])[0], "<u4").tolist()


@given(st.one_of(WORDS, st.lists(st.one_of(WORDS, MARKS), max_size=6).map("".join), st.text("abcdeinrthsgo", max_size=30)))
@settings(max_examples=500, deadline=None)
def test_speculation_gives_the_librarys_ids(text):
    assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_pairs_against_merging():
    """A pair stands exactly if merging its string gives the pair."""
    rng = np.random.default_rng(2)
    vocabulary = {i: t for t, i in LIBRARY.get_vocab().items() if i < 49406}
    first = [i for i, t in vocabulary.items() if not t.endswith("</w>")]
    last = [i for i, t in vocabulary.items() if t.endswith("</w>") and len(t) < 9]
    a, b = rng.choice(first, 4000), rng.choice(last, 4000)
    stands = SPECULATOR.merges.compatible(a, b)
    for x, y, s in zip(a.tolist(), b.tolist(), stands.tolist(), strict=True):
        word = vocabulary[x] + vocabulary[y].removesuffix("</w>")
        assert s == ([t.id for t in LIBRARY.model.tokenize(word)] == [x, y]), word
    assert 0 < stands.sum() < len(stands)


def test_equal_ranks_go_leftmost_first():
    """a a | a: the pair across the border is as early as the one inside, and comes after it; a | a a: it comes before."""
    m = speculative_bpe.Merges({"vocab": {"a": 0, "aa": 1, "aaa": 2}, "merges": [["a", "a"], ["aa", "a"]]})
    assert m.compatible(np.array([1, 0, 1]), np.array([0, 1, 1])).tolist() == [False, False, True]
    assert m.alone.all()
    m = speculative_bpe.Merges({"vocab": {"a": 0, "b": 1, "ab": 2, "aab": 3, "aa": 4}, "merges": [["a", "b"], ["a", "ab"], ["a", "a"]]})
    assert m.compatible(np.array([4, 0]), np.array([1, 3])).tolist() == [False, True]
    m = speculative_bpe.Merges({"vocab": {"a": 0, "b": 1, "bb": 2, "ab": 3, "abb": 4}, "merges": [["a", "b"], ["b", "b"], ["a", "bb"]]})
    assert m.alone.tolist() == [True, True, True, True, False]  # "abb" is ab, b


def test_merge_lists_that_were_not_trained_are_refused():
    with pytest.raises(ValueError):
        speculative_bpe.Merges({"vocab": {"a": 0, "b": 1, "ab": 2, "aab": 3}, "merges": [["a", "ab"], ["a", "b"]]})


def test_most_words_of_a_language_need_no_merging():
    s = speculative_bpe.Speculator(tokenizer_bytes())
    s.encode([b"the quick brown fox jumps over the lazy dog and nobody has seen anything like this before in the history of the world"])
    assert s.merged < s.tried / 4


BPE_ROWS = [(1, "The quick fox<|endoftext|>"), (2, None), (3, ""), (4, "word " * 9000), (4, "word " * 9000), (None, "null id"), (5, "aab" * 100_000), (6, "a <|endoftext|> B<|startoftext|>c <|ENDOFTEXT|> l'été 東京"), (7, "\x85 　")]


def test_bpe_of_small_texts(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in BPE_ROWS], "doc_id long, text string, ids int, _text string")
    got = speculative_bpe.encode_texts(docs, keep=["doc_id", "ids"], into="tokens")
    rows = got.select("doc_id", "tokens", speculative_bpe.decoder()(got["tokens"]).alias("text")).collect()
    want = [(i, ids := LIBRARY.encode(t or "", add_special_tokens=False).ids, LIBRARY.decode(ids, skip_special_tokens=False)) for i, t in BPE_ROWS]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert speculative_bpe.encode_texts(docs.limit(0)).count() == 0


def test_bpe_of_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(speculative_bpe, "KEPT", 500)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = speculative_bpe.op12_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# -------------------------------------------------------------------------------------------------- resampling


def drawn(docs, target, longest, buckets, share, least):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    made = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for *_, g in made for b in g), Counter(b for x in target for b in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, n, g in made:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in g)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    enough = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: share * len(enough) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize(("longest", "buckets", "share", "least"), [(1, 10_000, 10, 20), (2, 50, 40, 3), (3, 7, 100, 0)])
def test_resampling_against_brute_force(spark, longest, buckets, share, least):
    rng = random.Random(longest)
    vocabulary = ["Über", "東京", "x1", "The", "a-b"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(200 + i, "one text of twenty words and more " * 4) for i in range(40)] + [(5, docs[5][1])] * 30 + [(None, "null id here " * 9), (None, None), (301, ""), (302, "x1 " * 5000), (303, " \x00.,")]
    target = [" ".join(rng.choices(vocabulary[:12], k=15)) for _ in range(20)] + [None, ""]
    left = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, row int, bucket int, place int").repartition(3)
    right = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(left, right, longest=longest, buckets=buckets, share=share, min_words=least).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, drawn(docs, target, longest, buckets, share, least)))


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert importance.resample(docs.limit(0), docs).count() == 0
    got = importance.resample(docs, docs.limit(0), share=100).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 40, 1), (2, 0, None)]
