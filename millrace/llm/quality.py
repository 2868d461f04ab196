"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A whole text is compressed with each: the difference of the two
sizes, normalised by the text's size and by the smaller result, says which kind it is like. A logistic model turns the two normalised
differences into a calibrated score; nothing else of a text goes into it.

Null texts count as empty. Equal texts have equal scores. A text is held by its task as a whole, others of its Arrow batch wait in their buffers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, cut, fit_logistic, labelled_ids, slices, table

#: Labelled rows per class that are learned from, and the bytes of each that go into a dictionary, in PIECES from all over the text: the bound of the fit.
MAX_ROWS = 2000
MAX_ROW_BYTES = 16_384
PIECES = 4
DICTIONARY_BYTES = 112_640
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        def make(raw: bytes) -> zstandard.ZstdCompressor:
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)

        self.good, self.bad = make(good), make(bad)

    def features(self, text: bytes) -> tuple[float, float]:
        g, b = len(self.good.compress(text)), len(self.bad.compress(text))
        return (b - g) / max(min(g, b), 1), (b - g) / (len(text) + 1)


def material(text: bytes) -> bytes:
    """At most MAX_ROW_BYTES of a text: all of it, or PIECES at even distances from its start to its end."""
    if len(text) <= MAX_ROW_BYTES:
        return text
    size = MAX_ROW_BYTES // PIECES
    starts = [(len(text) - size) * k // (PIECES - 1) for k in range(PIECES)]
    return b"".join(text[s : s + size] for s in starts)


def _dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(parts)[-DICTIONARY_BYTES:]


def fit_quality(docs: DataFrame, labels: DataFrame, learn) -> QualityModel:
    """docs: (doc_id, text). learn: the ids that may be learned from. At most MAX_ROWS texts for the dictionaries reach the driver, MAX_ROW_BYTES of each, and of the others their features.

    Half of the rows build the dictionaries, the other half fit the score on whole texts, so that no text is scored by a dictionary made of it. Copies of a text count once a
    label; a text with both labels builds no dictionary. Without rows of both classes the score is the classes' rate.
    """
    spark = docs.sparkSession
    ids = labelled_ids(labels, "quality", learn, MAX_ROWS)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select(F.col("doc_id").alias("id"), text.alias("text")).join(F.broadcast(ids), "id").select("id", "y", "w", F.sha2("text", 256).alias("h"), "text")
    sample = cut(sample.dropDuplicates(["id", "h"]))
    key = lambda r: (hashlib.sha256(str(r["id"]).encode()).digest(), r["h"])
    rows: dict[tuple[str, int], dict] = {}
    for r in sorted(sample.select("id", "y", "w", "h").collect(), key=key):
        rows.setdefault((r["h"], r["y"]), r)
    build, fit = [], []
    for y in (0, 1):
        own = [r for r in rows.values() if r["y"] == y and (r["h"], 1 - y) not in rows]
        build += own[::2]
        fit += own[1::2]
    fit += [r for r in rows.values() if (r["h"], 1 - r["y"]) in rows]
    pick = lambda rs: sample.join(F.broadcast(spark.createDataFrame([(r["id"], r["h"]) for r in rs], sample.select("id", "h").schema)), ["id", "h"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([material(t.as_py().encode()) for t in b.column(2)], pa.binary())], ["h", "y", "t"])

    parts = pick(build).select("h", "y", "text").mapInArrow(pieces, "h string, y int, t binary").collect()
    order = {(r["h"], r["y"]): k for k, r in enumerate(build)}
    parts.sort(key=lambda r: order[r["h"], r["y"]])
    good, bad = (_dictionary([bytes(r["t"]) for r in parts if r["y"] == y]) for y in (1, 0))
    shared = spark.sparkContext.broadcast((good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Compressors(*shared.value)
        for b in slices(batches, 3):
            x = [made.features(t.as_py().encode()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["h", "y", "w", "x"])

    found = pick(fit).select("h", "y", "w", "text").mapInArrow(measure, "h string, y int, w double, x array<double>").collect()
    found.sort(key=lambda r: (r["h"], r["y"]))  # the same model whatever the order of the rows
    x = np.array([r["x"] for r in found], float).reshape(-1, 2)
    y, w = np.array([r["y"] for r in found], float), np.array([r["w"] for r in found], float)
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-9)) if len(x) else (np.zeros(2), np.ones(2))
    return QualityModel(good, bad, mean, scale, fit_logistic((x - mean) / scale, y, weight=w))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): 0 to 1, higher: good likelier. Null texts count as empty. One row per row of docs, repeated ones too, no shuffle; extra columns play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        made = Compressors(m.good, m.bad)
        for b in slices(batches, 1):
            x = np.array([made.features((t.as_py() or "").encode()) for t in b.column(1)]).reshape(-1, 2)
            z = np.column_stack([(x - m.mean) / m.scale, np.ones(len(x))]) @ m.weights
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def held_out(id_col: Column) -> Column:
    return F.coalesce(crc_fold(id_col, 5) == 0, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents; rows with crc32(doc_id) mod 5 = 0 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), lambda i: crc_fold(i, 5) != 0)
    scored = score_quality(docs, model)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
