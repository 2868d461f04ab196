"""Scores of the two classifiers, worked out again in plain loops from the fitted models."""

import math
import re

import zstandard

from millrace.llm import quality, toxicity
from millrace.llm.common import crc_fold


def some(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").limit(50).collect()
    extra = [(-1, None), (-2, ""), (-3, "YOU are an id10t!!! st*pid, you 1diot " * 30), (-4, "é" * 5000)]
    return docs, spark.createDataFrame([(r.doc_id, r.text) for r in rows] + extra, "doc_id long, text string")


def test_quality_scores(spark, sf):
    docs, sample = some(spark, sf)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"), lambda i: crc_fold(i, 5) != 0)
    texts = {r.doc_id: (r.text or "").encode() for r in sample.collect()}
    got = quality.score_quality(sample, model).collect()
    assert len(got) == len(texts) and len({round(r.score, 6) for r in got}) > 5
    for r in got:
        sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)).compress(texts[r.id])) for d in (model.good, model.bad)]
        gap = sizes[1] - sizes[0]
        x = [gap / max(min(sizes), 1), gap / (len(texts[r.id]) + 1)]
        z = model.weights[2] + sum(model.weights[k] * (x[k] - model.mean[k]) / model.scale[k] for k in (0, 1))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def plain_features(text, lexicon):
    words = []
    for w in "".join(" " if c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\n\t\r\x0b\x0c" else c for c in text.lower()).split():
        words.append(w)
    n, chars = len(words), max(len(text), 1)
    kinds = {"insult": [], "learned": [], "stem": []}
    for w in words:
        if w in toxicity.INSULTS:
            kinds["insult"].append(w)
        if w in lexicon.words:
            kinds["learned"].append(w)
        if any(w.startswith(s) for s in lexicon.stems):
            kinds["stem"].append(w)
    hits = {w for ws in kinds.values() for w in ws}
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND]
    near = sum(1 for i, w in enumerate(words) if w in hits and any(abs(i - s) <= toxicity.NEAR for s in second))
    leet = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}
    mixed = re.findall(r"[a-z]+[0-9@$!*]+[a-z][a-z0-9@$!*]*", text.lower()) if re.search(r"[a-zA-Z][0-9@$!*]+[a-zA-Z]", text) else []
    plain = ["".join(leet.get(c, c) for c in w) for w in mixed]
    found = sum(1 for w in plain if w in toxicity.INSULTS or w in lexicon.words or any(w.startswith(s) for s in lexicon.stems))
    capitals = sum(1 for c in text if c.isupper())
    shouted = sum(1 for w in text.split() if w.isupper())
    signs = sum(1 for c in text if c == "!")
    marks = sum(1 for c in text if c in ".,;:?#$%&*@!")
    a, b, c = (len(kinds[k]) for k in ("insult", "learned", "stem"))
    per = 1 / max(n, 1)
    return [math.log1p(n), a * per, math.log1p(a), b * per, math.log1p(b), c * per, math.log1p(c), math.log1p(len(hits)), near * per, capitals / chars, shouted * per, marks / chars, signs / chars, len(mixed) * per, math.log1p(found), float(a + b + c + found > 0)]


def plain_score(x, model):
    margin = model.trees.base
    for f, t, v in zip(model.trees.feature, model.trees.threshold, model.trees.value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if x[f[node]] > t[node] else 1)
        margin += v[node - len(f)]
    xs, ys = (list(map(float, k)) for k in model.knots)
    if margin <= xs[0]:
        return ys[0]
    for k in range(1, len(xs)):
        if margin <= xs[k]:
            return ys[k - 1] + (ys[k] - ys[k - 1]) * (margin - xs[k - 1]) / (xs[k] - xs[k - 1])
    return ys[-1]


def test_toxicity_scores(spark, sf):
    docs, sample = some(spark, sf.replace("sf0.001", "sf0.01"))
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet"), lambda i: crc_fold(i, 4) != 2)
    texts = {r.doc_id: r.text or "" for r in sample.collect()}
    got = toxicity.score_toxicity(sample, model).collect()
    assert len(got) == len(texts) and len(model.trees.feature) > 10
    for r in got:
        assert abs(r.score - plain_score(plain_features(texts[r.id], model.lexicon), model)) < 1e-9, r.id
