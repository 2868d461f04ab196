"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of lexicons (a short list of insults, and words and word stems learned from labelled texts), lexicon words
near second-person words, rates of capitals, punctuation and obfuscated words. The lexicon is counted in executors over the labelled sample;
only its bounded result and the sample's feature rows reach the driver, where the trees and the calibration are fitted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, cut, even, isotonic, labelled_ids, map_arrow, slices, table

#: Labelled rows per class that are learned from, and the size of the learned lexicon, a part of the model: the bounds of the fit. Words of 3 to 40 letters can be learned.
MAX_ROWS = 4000
MAX_WORDS = 400
STEMS = (4, 5, 6)
#: A document is rejected from this score on.
REJECT = 0.3

INSULTS = frozenset("idiot idiots stupid moron morons loser losers trash scum worthless disgusting pathetic dumb fool clown garbage jerk hate shut kill ugly freak creep filth vermin".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen sie ihr ihre tu te toi ton ta tes vous votre vos tú tus usted ustedes vosotros vuestro".split())
NEAR = 5
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None})
MIXED = re.compile(r"[a-z]+[0-9@$!*]+[a-z][a-z0-9@$!*]*")
SPACES = str.maketrans({c: " " for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\n\t\r\x0b\x0c"})
NAMES = ("words", "insults", "insults_n", "learned", "learned_n", "stems", "stems_n", "distinct", "near_second", "capitals", "shouted", "punctuation", "exclaimed", "mixed", "mixed_hits", "any")


@dataclass(frozen=True)
class Lexicon:
    words: frozenset = frozenset()
    stems: frozenset = frozenset()
    first: frozenset = field(default=frozenset())  # the first letters of the stems: a quick test


def words_of(text: str) -> list[str]:
    return text.lower().translate(SPACES).split()


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = words_of(text)
    n, chars = len(words), max(len(text), 1)
    rate = 1.0 / max(n, 1)
    first, stems = lexicon.first, lexicon.stems
    insults = [w for w in words if w in INSULTS]
    learned = [w for w in words if w in lexicon.words]
    by_stem = [w for w in words if w[:4] in first and any(w[:k] in stems for k in STEMS)] if first else []
    hits = {*insults, *learned, *by_stem}
    near = 0
    if hits:
        second = [i for i, w in enumerate(words) if w in SECOND]
        if second:
            at, k = np.asarray(second), np.array([i for i, w in enumerate(words) if w in hits])
            j = np.searchsorted(at, k)
            gap = np.minimum(np.abs(k - at[np.clip(j, 0, len(at) - 1)]), np.abs(k - at[np.clip(j - 1, 0, len(at) - 1)]))
            near = int((gap <= NEAR).sum())
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    shouted = sum(map(str.isupper, text.split())) if capitals else 0
    signs = text.count("!")
    marks = sum(map(text.count, ".,;:?#$%&*@")) + signs
    mixed = MIXED.findall(text.lower()) if re.search(r"[a-zA-Z][0-9@$!*]+[a-zA-Z]", text) else []
    mixed_hits = 0
    for w in mixed:
        plain = w.translate(LEET)
        mixed_hits += plain in INSULTS or plain in lexicon.words or any(plain[:k] in stems for k in STEMS)
    total = len(insults) + len(learned) + len(by_stem) + mixed_hits
    return [math.log1p(n), len(insults) * rate, math.log1p(len(insults)), len(learned) * rate, math.log1p(len(learned)), len(by_stem) * rate, math.log1p(len(by_stem)), math.log1p(len(hits)), near * rate, capitals / chars, shouted * rate, marks / chars, signs / chars, len(mixed) * rate, math.log1p(mixed_hits), float(total > 0)]


# --------------------------------------------------------------------------------------------- boosted trees


@dataclass(frozen=True)
class Trees:
    """Each tree is a full binary tree of one depth: feature and threshold by inner node, value by leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(math.log2(self.feature.shape[1] + 1)) if self.feature.size else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 3.0, ridge: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    """Second-order boosting of the logistic loss of weighted rows over quantile histograms."""
    c = even(weight, len(y))
    p = ((c * y).sum() + 0.5) / (len(y) + 1.0)
    base = math.log(p / (1 - p))
    empty = np.zeros((0, 2**depth - 1))
    if not len(y) or y.min() == y.max():
        return Trees(base, empty.astype(int), empty, np.zeros((0, 2**depth)))
    edges = [np.unique(np.concatenate([np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]), np.quantile(u, np.linspace(0, 1, bins // 2)) if len(u := x[x[:, k] > x[:, k].min(), k]) else []])) for k in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
    width = max(map(len, edges)) + 1
    flat = codes + np.arange(x.shape[1]) * width
    margin, all_f, all_t, all_v = np.full(len(y), base), [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = c * (q - y), c * np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(len(y), int)
        f, t = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = node == k
                if not mine.any():
                    continue
                gs, hs = (np.bincount(flat[mine].ravel(), np.repeat(v[mine], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1) for v in (g, h))
                gt, ht = g[mine].sum(), h[mine].sum()
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = -1
                for j, e in enumerate(edges):
                    gain[j, len(e) :] = -1
                j, at = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, at] > 1e-6:
                    f[k], t[k] = j, edges[j][at]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        leaf = node - len(f)
        v = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += v[leaf]
        all_f.append(f), all_t.append(t), all_v.append(v)
    return Trees(base, np.array(all_f), np.array(all_t), np.array(all_v))


# -------------------------------------------------------------------------------------------------- the model


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems far more frequent in toxic texts of the sample (text, y); copies of a text count once, by its 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            out: list[tuple[str, int, int]] = []
            for t, y in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py()
                mark = xxhash.xxh3_64_intdigest(text.encode()) - 2**63
                seen = {w for w in words_of(text) if 2 < len(w) <= 40}
                out += [(w, y.as_py(), mark) for w in seen | {w[:k] + "*" for w in seen for k in STEMS if len(w) >= k}]
            w, y, n = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(y, pa.int32()), pa.array(n, pa.int64())], ["w", "y", "n"])

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    counts = map_arrow(sample, run, "w string, y int, n long").distinct().groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    strong = counts.where((F.col("t") >= max(5, 0.015 * toxic)) & (odds >= 3)).withColumn("o", odds)
    top = strong.orderBy((F.col("o") * F.log1p("t")).desc(), "w").limit(MAX_WORDS).select("w").collect()
    stems = {r["w"][:-1] for r in top if r["w"][-1] == "*"}
    stems = frozenset(s for s in stems if not any(s[:k] in stems for k in STEMS if k < len(s)))
    words = frozenset(r["w"] for r in top if r["w"][-1] != "*")
    return Lexicon(words, stems, frozenset(s[:4] for s in stems))


def _rows(docs: DataFrame, others: list[str], make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = make()
        for b in slices(batches, 0):
            yield done(b.select(range(1, b.num_columns)), [t.as_py() or "" for t in b.column(0)])

    return map_arrow(docs.select("text", *others), run, schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn) -> ToxicityModel:
    """docs: (doc_id, text). learn: the ids that may be learned from. At most 2 * MAX_ROWS rows of features reach the driver.

    Labelled rows are few, so their texts are cut out once. A fifth of them calibrates. Without rows of both classes the score is the classes' rate.
    """
    ids = labelled_ids(labels, "toxic", learn, MAX_ROWS)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select(F.col("doc_id").alias("id"), text.alias("text")).join(F.broadcast(ids), "id").select("text", "y", "w", F.pmod(F.xxhash64("text"), F.lit(5)).cast("int").alias("fold"))
    sample = cut(sample)
    lexicon = learn_lexicon(sample.where("fold <> 0").select("text", "y"))

    def make():
        return lambda own, texts: pa.RecordBatch.from_arrays([*own.columns, pa.array([features(t, lexicon) for t in texts], pa.list_(pa.float64()))], ["y", "w", "fold", "x"])

    rows = _rows(sample, ["y", "w", "fold"], make, "y int, w double, fold int, x array<double>").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(NAMES))
    y, w, fold = np.array([r["y"] for r in rows], float), np.array([r["w"] for r in rows], float), np.array([r["fold"] for r in rows], int)
    order = np.lexsort([*x.T, y])  # the same model whatever the order of the rows
    x, y, w, fold = x[order], y[order], w[order], fold[order]
    trees = fit_trees(x[fold != 0], y[fold != 0], weight=w[fold != 0])
    own = fold == 0
    if y[own].sum() < 20 or (1 - y[own]).sum() < 20:
        own = np.ones(len(y), bool)
    knots = isotonic(trees.margin(x[own]), y[own], w[own]) if own.any() else (np.zeros(1), np.full(1, 0.5))
    return ToxicityModel(lexicon, trees, knots)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, score), or the keep columns and a column _toxicity: 0 to 1, higher: toxic likelier. Null texts count as empty. One row per row of docs, repeated ones too, no shuffle; extra columns play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["id"] if keep is None else keep
    last = "score" if keep is None else "_toxicity"

    def make():
        m = shared.value
        return lambda own, texts: pa.RecordBatch.from_arrays([*own.columns, pa.array(m.score(np.array([features(t, m.lexicon) for t in texts]).reshape(-1, len(NAMES))))], [*names, last])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(text, *([F.col(id_col).alias("id")] if keep is None else [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[1:]]
    schema = ", ".join([*[f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)], f"`{last}` double"])
    return _rows(rows, rows.columns[1:], make, schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(crc_fold(id_col, 4) == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents; rows with crc32(doc_id) mod 4 = 2 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), lambda i: crc_fold(i, 4) != 2)
    scored = score_toxicity(docs, model)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
