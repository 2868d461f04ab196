import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, token_files
from millrace.llm.word_tokens import ChunkEncoder, tokenizer_bytes


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ENCODER = ChunkEncoder(tokenizer_bytes())


WORDS = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0 ́'tsΣİéa1<|>")))
SPECIAL = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "x<|endoftext|>́", " "])


@given(st.one_of(WORDS, st.lists(st.one_of(WORDS, SPECIAL), max_size=8).map("".join)))
@settings(max_examples=400, deadline=None)
def test_chunks_equal_whole_text(text):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json")) if not hasattr(test_chunks_equal_whole_text, "t") else test_chunks_equal_whole_text.t
    test_chunks_equal_whole_text.t = t
    assert np.frombuffer(ENCODER.encode([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@given(st.lists(st.lists(st.one_of(WORDS, SPECIAL), max_size=5).map("".join), max_size=6))
@settings(max_examples=150, deadline=None)
def test_texts_of_a_batch_do_not_mix(texts):
    raw = [t.encode() for t in texts]
    assert ENCODER.encode(raw) == [ENCODER.encode([t])[0] for t in raw]


def test_words_are_looked_up_without_their_signs():
    encoder = ChunkEncoder(tokenizer_bytes())
    one, two = encoder.encode([b"abc, abc. Abc; na\xc3\xafve? ABC!", b" abc abc,\tna\xc3\xafve."])
    assert set(encoder.table) - {b""} <= {b"abc", b"Abc", b"ABC", "naïve".encode(), b",", b".", b";", b"?", b"!"}
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in (one, two)] == [t.encode(x, add_special_tokens=False).ids for x in ("abc, abc. Abc; naïve? ABC!", " abc abc,\tnaïve.")]


ROWS = [(5, "The quick fox<|endoftext|>"), (2, None), (9, ""), (7, "word " * 9000), (7, "word " * 9000), (None, "null id"), (1, "x" * 700), (11, "a <|endoftext|> B<|startoftext|>c <|ENDOFTEXT|>")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, `offset` int, length int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(got, texts, plain):
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    want = []
    for i, t in texts:
        ids = [*plain(t), 1]
        want += [(i, k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    return seqs, sum(w[3] for w in want)


def test_packing_small_cases(spark, plain):
    check_packing(packing.pack_documents(frame(spark)).collect(), ROWS, plain)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_packing_is_the_same_however_it_is_read(spark, plain):
    rows = [(i, "w " * (i % 7)) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = packing.pack_documents(frame(spark, rows))
        one = placed.coalesce(1).collect()
        check_packing(one, rows, plain)
        assert sorted(map(tuple, one)) == sorted(map(tuple, placed.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packing_of_documents_is_nearly_full(spark, sf, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    seqs, total = check_packing(packing.op3_packing(spark, sf).collect(), docs, plain)
    assert len(seqs) == -(-total // 4096)


def test_fullest_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        capacity = int(rng.integers(5, 24))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 8))
        counts = np.bincount(lengths, minlength=capacity + 1)
        seed = int(lengths.max())
        rest = list(lengths)
        rest.remove(seed)
        sums = {0}
        for x in rest:
            sums |= {s + int(x) for s in sums if s + x <= capacity - seed}
        got = packing.fullest(counts, seed, capacity)
        assert sum(got) == seed + max(sums)
        assert all(np.bincount(got, minlength=capacity + 1) <= counts)
        placed = np.zeros(capacity + 1, int)
        for times, bin_ in packing.bin_plan(counts, capacity):
            placed += times * np.bincount(bin_, minlength=capacity + 1)
        assert (placed == counts).all()


def test_token_files_round_trip(spark, sf, plain, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in token_files.op9_token_files(spark, sf).collect()}
    start = 0
    for i, t in sorted(docs):
        ids = [*plain(t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    path = str(tmp_path / "tokens")
    token_files.write_token_files(frame(spark), path)
    rows = token_files.read_tokens(spark, path).collect()
    assert sorted((r.doc_id or -1, list(r.tokens)) for r in rows) == sorted((i or -1, [*plain(t), 2]) for i, t in ROWS)
    assert {r.doc_id for r in token_files.read_tokens(spark, path, [5, 9]).collect()} == {5, 9}
    meta = token_files.read_metadata(spark, path)
    assert meta.count() == len(ROWS) and "tokens:array" not in str(meta._jdf.queryExecution().executedPlan())
    empty = str(tmp_path / "empty")
    token_files.write_token_files(frame(spark, []), empty)
    assert token_files.read_digests(spark, empty).count() == 0
