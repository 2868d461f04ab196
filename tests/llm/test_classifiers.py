import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import quality, toxicity
from millrace.llm.common import crc_fold, fit_logistic, isotonic, labelled_ids


def corpus(spark, n=400):
    rng = np.random.default_rng(7)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "ti") for b in ("ran", "mel", "sop") for c in ("", "ed", "ing")]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(20, 80))))
        bad, toxic = bool(rng.random() < 0.3), bool(rng.random() < 0.3)
        if bad:
            w = [x + "###" for x in w]
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["idiot", "grobian", "st*pid", "you"])))
            w.insert(0, "grobianish")
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(None, "no id"), (9001, None), (9002, ""), (9003, "x" * 200_000), (0, docs[0][1])]
    labels += [(None, 1, 1), (9001, None, None), (1, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, kind):
    docs, labels = corpus(spark)
    if kind == "quality":
        model = quality.fit_quality(docs, labels, lambda i: crc_fold(i, 5) != 0)
        got, fold, rest = quality.score_quality(docs, model).collect(), 5, 0
    else:
        model = toxicity.fit_toxicity(docs, labels, lambda i: crc_fold(i, 4) != 2)
        got, fold, rest = toxicity.score_toxicity(docs, model).collect(), 4, 2
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r[kind] for r in labels.collect() if r.doc_id is not None and 1 < r.doc_id < 9000}
    held = [r for r in got if r.id in truth and zlib.crc32(str(r.id).encode()) % fold == rest]
    assert len(held) > 50 and np.mean([(r.score >= 0.3) == truth[r.id] for r in held]) > 0.95


def test_without_labels(spark):
    docs, labels = corpus(spark, 20)
    none = labels.limit(0)
    a = quality.score_quality(docs, quality.fit_quality(docs, none, lambda i: crc_fold(i, 5) != 0)).collect()
    b = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none, lambda i: crc_fold(i, 4) != 2)).collect()
    assert len({r.score for r in a}) == 1 and len({r.score for r in b}) == 1
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs, none, lambda i: crc_fold(i, 5) != 0)).count() == 0


def test_fold_is_crc32(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None, -7]], "id long")
    for r in df.select("id", crc_fold(df["id"], 5).alias("f")).collect():
        assert r.f == (None if r.id is None else zlib.crc32(str(r.id).encode()) % 5)


def test_queries(spark, sf):
    for f, fold, rest in ((quality.op2_quality, 5, 0), (toxicity.op4_toxicity, 4, 2)):
        got = f(spark, sf).collect()
        assert len(got) == 200
        for r in got:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(0, 1)), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_isotonic_is_monotone(points):
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    kx, ky = isotonic(x, y)
    assert (np.diff(kx) >= 0).all() and (np.diff(ky) >= 0).all() and 0 < ky.min() and ky.max() < 1


def test_small_models():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    t = toxicity.fit_trees(x, y, trees=60, depth=3)
    assert ((t.margin(x) > 0) == (y == 1)).mean() > 0.9
    w = fit_logistic(x, (x[:, 2] > 0).astype(float))
    assert abs(w[2]) > 5 * max(abs(w[0]), abs(w[1]))
    assert np.allclose(fit_logistic(x, np.ones(500))[:4], 0)


def test_capped_classes_keep_their_mix(spark):
    """A capped sample's weights give the table's rate back, in every fit."""
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = labelled_ids(labels, "toxic", lambda i: i >= 0, 50).collect()
    y, w = np.array([r.y for r in rows], float), np.array([r.w for r in rows])
    assert len(rows) == 100 and abs((w * y).sum() / w.sum() - 0.1) < 1e-9
    x = np.zeros((100, 1))
    assert abs(1 / (1 + np.exp(-fit_logistic(x, y, weight=w)[-1])) - 0.1) < 0.01
    assert np.allclose(isotonic(x[:, 0], y, w)[1], 0.1, atol=0.01)
    assert abs(1 / (1 + np.exp(-toxicity.fit_trees(x, y, weight=w).margin(x)[0])) - 0.1) < 0.01


def test_quality_learns_from_whole_texts(spark):
    """Long texts with a clean first part: their labels differ by what comes later."""
    rng = np.random.default_rng(9)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "ti", "ru") for b in ("ran", "mel", "sop", "vik") for c in ("", "ed", "ing", "er")]
    start = " ".join(rng.choice(words, 3500))
    assert len(start) > quality.MAX_ROW_BYTES
    docs = [(i, start + " " + ("zq## " * 4000 if i % 2 else " ".join(rng.choice(words, 3500))) + str(i)) for i in range(80)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in docs], "doc_id long, quality int")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = quality.score_quality(docs, quality.fit_quality(docs, labels, lambda i: i < 60)).collect()
    assert all((r.score >= 0.5) == (r.id % 2 == 0) for r in got)


def test_lexicon_counts_texts_of_equal_length(spark):
    """Toxic word in half of the toxic and 1 % of the clean texts, all texts of one length."""
    rows = [(f"{i:06d} abc " + ("zorgon" if (i % 2 if y else i % 100 == 0) else "abcdef"), y) for y in (0, 1) for i in range(y, 600, 1)]
    assert len({len(t) for t, _ in rows}) == 1
    assert "zorgon" in toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int")).words | {"zorgon" for s in toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int")).stems if "zorgon".startswith(s)}


def auc(score, truth):
    score, truth = np.asarray(score), np.asarray(truth, bool)
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n = truth.sum()
    return (rank[truth].sum() - n * (n + 1) / 2) / (n * (~truth).sum())


@pytest.mark.parametrize("f, label, least", [(quality.op2_quality, "quality", 0.97), (toxicity.op4_toxicity, "toxic", 0.93)])
def test_held_out_auc_of_the_queries(spark, f, label, least):
    """Rows that no model learned from, at sf0.1; two runs give the same scores."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = f(spark, sf).collect()
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 500 and auc([r.score for r in held], [truth[r.doc_id] for r in held]) > least
    assert {(r.doc_id, r.score) for r in f(spark, sf).collect()} == {(r.doc_id, r.score) for r in got}


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_extra_columns_with_clashing_names(spark, kind):
    docs, labels = corpus(spark, 60)
    names = ["id", "y", "w", "h", "x", "t", "fold", "score", "label", "count", "_toxicity", "_k0"]
    more = docs.selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    fit, score, learn = (quality.fit_quality, quality.score_quality, lambda i: crc_fold(i, 5) != 0) if kind == "quality" else (toxicity.fit_toxicity, toxicity.score_toxicity, lambda i: crc_fold(i, 4) != 2)
    key = lambda r: (r.id is None, r.id or 0, r.score)
    want = sorted(score(docs, fit(docs, labels, learn)).collect(), key=key)
    assert sorted(score(more, fit(more, labels.selectExpr("*", "1 as id", "2 as y", "3 as w"), learn)).collect(), key=key) == want
