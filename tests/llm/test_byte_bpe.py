import hashlib
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import public_tokenizers as P
import pyarrow as pa
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import byte_bpe as B

RANKS = B.load_ranks()
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "I'll don't  stop\n\n  x", "naïve café — 中文字 😀😀", "a" * 3000, " " * 2500 + "x", "<|endoftext|> 12345678", "ḃ́ 　\x1c\x85tab\tend ", "thhationer " * 50]


@given(st.text(min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_heap_merge_equals_tiktoken(text):
    word = text.encode("utf-8", "replace")
    assert B.heap_merge(word, RANKS) == TIK._core_bpe.encode_single_piece(word)


def check(spark, docs, dictionary, long=B.LONG):
    made, codec = B.encode_texts(docs, dictionary=dictionary, long=long)
    ids = B.id_array(made["ids"])
    rows = made.select("id", ids.alias("a"), codec.decode(ids).alias("d")).collect()
    texts = sorted((r.text or "" for r in docs.collect()))
    assert sorted(bytes(r.d).decode() for r in rows) == texts
    for r in rows:
        assert r.a == TIK.encode_ordinary(bytes(r.d).decode())


def test_small_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "", 0), (3, TEXTS[3], None, None)], "doc_id long, text string, ids string, id int")
    for dictionary, long in ((0, B.LONG), (3, B.LONG), (100_000, B.LONG), (3, 5)):  # all words folded in place, some, none; most by the heap
        check(spark, docs, dictionary, long)
    assert B.encode_texts(docs.limit(0))[0].count() == 0


def test_documents(spark, sf):
    got = {r.doc_id: r for r in B.op8_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = TIK.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_the_fold_gives_the_tables_words(spark, sf):
    codec = B.Codec(RANKS)
    known = B.frequent_words(spark.read.parquet(f"{sf}/documents.parquet").select("text"), codec, 500)
    assert 100 < known.num_rows <= 500
    for w, ids in zip(known["w"].to_pylist(), known["ids"].to_pylist(), strict=True):
        assert ids == ",".join(map(str, TIK.encode_ordinary(w)))


def test_a_merge_searches_no_place(spark):
    words = ["a", "é", "aaaa", "abababab", " thhationer" * 40, "\u0000ÿ", "zq" * 700]
    folded = spark.createDataFrame([(w,) for w in words], "w string").select("w", B.Codec(RANKS).encode_word(F.col("w")).alias("ids"))
    assert {r.w: r.ids for r in folded.collect()} == {w: TIK._core_bpe.encode_single_piece(w.encode()) for w in words}
    plan = folded.drop("w")._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in plan and "array_position(" not in plan and plan.count("slice(") == 3  # a step cuts one array in two; the third takes the edges away


@given(st.lists(st.sampled_from(["a", "b1", " ", " ", "  ", "'s", "!", "\n", "é", "'", "\x1c", "\u00a0", "ll"]), max_size=12).map("".join))
@settings(max_examples=600, deadline=None)
def test_words_stay_within_pieces(text):
    split, pieces = regex.compile(P.PATTERN).findall, B.spaced(text)
    if pieces is not None:
        assert split(pieces[0]) + [w for x in pieces[1:] for w in split(" " + x)] == split(text)


def test_counts_of_words(spark, monkeypatch):
    monkeypatch.setattr(B, "COUNTED", 3)
    texts = ["a b a", "a  b", "", "b a\nb c c c", " a", "it's a b-a"] * 7
    want = Counter(w for t in texts for w in regex.findall(P.PATTERN, t))
    got = B.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()
    assert {r.w: r["count"] for r in got} == want and len(got) == len(want)


def test_the_table_is_small_in_a_worker():
    words = [f" w{k}" for k in range(30_000)]
    shared = SimpleNamespace(value=B._packed(pa.table({"w": words, "ids": [f"{k},{k + 1}" for k in range(30_000)]})))
    tracemalloc.start()
    try:
        known = B._unpacked("a table", shared)
        held = tracemalloc.get_traced_memory()[0] / len(words)
    finally:
        tracemalloc.stop()
    assert held < 64  # bytes a word beside what came; a dictionary takes more than 150
    asked = [" w7", "w7", "", " w29999", "é"]
    assert [k if k < 0 else words[k] for k in known.find(asked).tolist()] == [" w7", -1, -1, " w29999", -1]
    known.keys[:] = hash(" w7")  # all hashes alike: a word that isn't the one found is unknown, never another's ids
    assert all(k < 0 or words[k] == w for w, k in zip(words[:50], known.find(words[:50]).tolist(), strict=True))
