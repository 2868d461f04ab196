"""Shared helpers of the training-data operators: checkpoints, private column names, labelled samples, small models.

Column clashes are avoided in one way everywhere: an operator first projects the columns it was told to use under
names of its own, so extra columns of the caller's frame can't collide with them.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpoint_dir, cut, scratch_path

__all__ = ["checkpoint_dir", "crc32_u32", "crc_fold", "cut", "fit_logistic", "isotonic", "labelled_ids", "map_arrow", "scratch_path", "slices", "spread_join", "table"]

#: The ASCII white space of the text contracts: [\x20\x09-\x0D].
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32(id as decimal text) mod folds; null ids have no fold."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row a key, so that no task gets all rows of a frequent key. how: inner, left or left_semi. Keys are not null.

    keyed's column of the name size says how many of the rows have the key, total how many rows there are; size is not in the result. Keys of more than
    a quarter of an even share of a shuffle partition are frequent: fewer than four times as many as there are partitions, however large the data, so
    theirs are broadcast, and a salt spreads their rows over the partitions in which all others meet. The salt is the rows' place in their partition, so rows must be a scan,
    a checkpoint, or rows of these with columns added or left out: a task that runs again must give its rows in the same order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = [c for c in keyed.columns if c not in (*keys, size)] if how != "left_semi" else []
    frequent = F.col(size) > total / (4 * parts)
    few = keyed.where(frequent).select(*keys, *[F.col(c).alias(f"_few_{c}") for c in added], F.lit(True).alias("_few"))
    none = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")  # always 0, but no constant: the planner drops constants from a join's keys, and the salt with them
    many = keyed.where(~frequent).select(*keys, *added, none.alias("_salt"), F.lit(True).alias("_many"))
    salt = F.when(F.col("_few"), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(0).cast("int")
    met = rows.join(F.broadcast(few), keys, "left").withColumn("_salt", salt).join(many, [*keys, "_salt"], "left")
    if how != "left":
        met = met.where("_few or _many")
    return met.select(*rows.columns, *[F.coalesce(f"_few_{c}", c).alias(c) for c in added])


def labelled_ids(labels: DataFrame, label: str, learn: Callable[[Column], Column], max_rows: int) -> DataFrame:
    """(id, y, w): at most max_rows learnable ids per class, chosen by a hash of the id, so the same rows at every run.

    w is the number of the class's learnable ids over those chosen, so that weighted rows have the classes' natural mix whatever the table's size.
    Rows with a null id or label take no part. An id labelled both ways counts as 1. The result has at most
    2 * max_rows rows, the bound behind every broadcast of it.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id is not null and y is not null")
    rows = rows.where(learn(F.col("id"))).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in rows.where(F.col("y").isin(0, 1)).groupBy("y").count().collect()}
    parts = [rows.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(max_rows).withColumn("w", F.lit(max(1.0, sizes.get(k, 0) / max_rows))) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows whose texts (column number text, UTF-8) have about so many bytes, whole rows each: what a worker holds in Python objects at a time."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))))
            yield b.slice(at, to - at)
            at = to


#: Bytes of a batch of rows on its way to a worker, one row at least.
ARROW_BYTES = 4 << 20


def map_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema) for rows with texts. Batches have about ARROW_BYTES, unless the session has a bound of its own (with Spark's 64 MB an executor and its workers hold whole input
    splits several times), and a worker gives the memory that it doesn't use back after each task: it lives on, and so would the most that any of its tasks took."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return rows.mapInArrow(bounded, schema)


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def crc32_u32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


# ---------------------------------------------------------------------------------------------- small models


def even(weight: np.ndarray | None, n: int) -> np.ndarray:
    """Row weights with a mean of 1, so that ridges and smoothing mean the same for every sample."""
    return np.ones(n) if weight is None or not n else np.asarray(weight, float) * (n / np.sum(weight))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for a logistic model of weighted rows; the last weight is the intercept. Constant answers when one class is missing."""
    c = even(weight, len(y))
    if len(y) == 0 or y.min() == y.max():
        rate = ((c * y).sum() + 1.0) / (len(y) + 2.0)
        return np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        s = c * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((a * s[:, None]).T @ a + ridge * np.eye(a.shape[1]), a.T @ (c * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, rate) of the best non-decreasing fit of weighted rows, smoothed by half a case each way."""
    order = np.argsort(score, kind="stable")
    xs, ys, cs = score[order], y[order].astype(float), even(weight, len(y))[order]
    ux, start = np.unique(xs, return_index=True)
    weight = np.add.reduceat(cs, start)
    mean = np.add.reduceat(cs * ys, start) / weight
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for m, w, v in zip(mean, weight, ux, strict=True):
        blocks.append([m, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    kx, ky = [], []
    for m, w, first, last in blocks:
        rate = (m * w + 0.5) / (w + 1.0)
        kx += [first] if first == last else [first, last]
        ky += [rate] if first == last else [rate, rate]
    return np.asarray(kx), np.maximum.accumulate(np.asarray(ky))
