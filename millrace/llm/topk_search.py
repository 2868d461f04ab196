"""Exact top-k search by a vector-approximation file.

1. Vectors become integer vectors floor(scale * x). Equal vectors collapse into one class that keeps its k + 1 smallest
   ids: no other id of the class can be among any query's k best, as ties go to the smaller id and a query excludes one id.
2. The file holds for each class a small cell code for each component, and the exact vector. It stays where it is: the query set comes to
   it, in batches of a bounded size. No pair of rows is ever shuffled, only each task's k + 1 best for a query.
3. The file is searched in rounds, each several times as large as the one before: a round starts with each query's (k + 1)-th best of the earlier ones, so the rows that
   tasks send grow with the logarithm of the file, not with tasks times queries.
4. A task scans a block of codes, which bounds every distance (here: an inner product, so the nearest have the largest upper bound), and rules out
   what can't reach the (k + 1)-th best so far. It reads the exact vectors of the others in the order of their bounds until the (k + 1)-th
   result is certain, that is until the next bound is worse than it.

Scores are exact: 64-bit integers where they can't overflow, else integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch_path, spread_join, table

#: Bits of a cell code; cells are equal slices of each component's own range.
BITS = 7
#: Rows of the file that are scanned as one block, and queries that are compared with it at a time.
BLOCK_ROWS = 8192
QUERY_ROWS = 256
#: Bytes, and number, of the query vectors that are broadcast at a time; a task keeps about 430 bytes of results a query at k = 5.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 65536
#: Blocks of the first round; each round has ROUND times as many as all before it.
ROUND = 8
LONG = 2**63 - 1


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, h, v array<long>, dim), h being a digest of v. Null, empty and non-finite vectors take no part; nor do null ids. Components that a long can't hold are the nearest long."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("x")).where("id is not null and size(x) > 0").where(~bad)
    rows = rows.select("id", F.transform("x", lambda c: F.greatest(F.floor(c * F.lit(scale)), F.lit(-LONG))).alias("v"))
    return rows.select("id", F.unhex(F.sha2(F.array_join("v", ","), 256)).alias("h"), "v", F.size("v").alias("dim"))


def vector_classes(vectors: DataFrame, k: int) -> DataFrame:
    """(h, v, dim, ids): one row per distinct vector with its k + 1 smallest ids.

    Vectors are merged, and ranks limited, in each task before the shuffle, so a vector that holds a third of all rows moves a row and k + 1 ids a task.
    """
    rank = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    few = vectors.select("h", "id").distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    ids = few.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return vectors.groupBy("h").agg(F.first("v").alias("v"), F.first("dim").alias("dim")).join(ids, "h")


# ------------------------------------------------------------------------------------------- the approximation file


def cell_limits(classes: DataFrame, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """dimension: (low, step, slack) of each component's cells. A row for each dimension and component reaches the driver, bounded by the widths of vectors."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for dim, _, v in _by_dim(b, 0, 1):
                low, high = v.min(axis=0), v.max(axis=0)
                if dim in found:
                    low, high = np.minimum(low, found[dim][0]), np.maximum(high, found[dim][1])
                found[dim] = low, high
        for dim, (low, high) in found.items():
            yield pa.RecordBatch.from_pydict({"dim": np.full(dim, dim, np.int32), "p": np.arange(dim, dtype=np.int32), "a": low, "b": high})

    made = classes.select("dim", "v").mapInArrow(ends, "dim int, p int, a long, b long")
    rows = made.groupBy("dim", "p").agg(F.min("a").alias("a"), F.max("b").alias("b")).collect()
    out = {}
    for dim in {r["dim"] for r in rows}:
        own = sorted((r["p"], r["a"], r["b"]) for r in rows if r["dim"] == dim)
        a, b = (np.array([r[k] for r in own], float) for k in (1, 2))
        slack = (np.abs(a) + np.abs(b)) * 2.0**-48  # rounding of the limits themselves
        out[dim] = (a, (b - a + 1 + slack) / 2**bits, slack)
    return out


def _by_dim(b: pa.RecordBatch, dim_col: int, vector_col: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows of the batch, their vectors) of a batch with a list column."""
    dims = b.column(dim_col).to_numpy()
    flat, ends = b.column(vector_col).flatten().to_numpy(), np.cumsum(dims)
    for dim in np.unique(dims):
        mine = np.flatnonzero(dims == dim)
        v = flat if len(mine) == len(dims) else np.concatenate([flat[e - dim : e] for e in ends[mine]])
        yield int(dim), mine, v.reshape(-1, dim)


def approximation_file(classes: DataFrame, limits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(h, dim, ids, codes, exact) of classes: a byte for each component, and its 64-bit number."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, mine, v in _by_dim(b, 1, 3):
                low, step, _ = limits[dim]
                codes = np.clip(np.floor((v - low) / step), 0, 255).astype(np.uint8)
                own = b.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([x.tobytes() for x in v.astype("<i8")], pa.binary())], ["h", "dim", "ids", "codes", "exact"])

    return classes.select("h", "dim", "ids", "v").mapInArrow(code, "h binary, dim int, ids array<long>, codes binary, exact binary")


# ------------------------------------------------------------------------------------------------- the search


@dataclass
class Best:
    """The n best classes so far of each of a dimension's queries: score, smallest id, all ids. A place without a class has no ids. floor: what a score must reach in any case."""

    score: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    count: np.ndarray
    floor: np.ndarray

    @classmethod
    def none(cls, queries: int, n: int, floor: np.ndarray | None = None) -> Best:
        floor = np.full(queries, -LONG - 1) if floor is None else floor
        return cls(np.full((queries, n), -LONG - 1), np.full((queries, n), LONG), np.zeros((queries, n, n), np.int64), np.zeros((queries, n), np.int64), floor)

    def bound(self, at: slice) -> np.ndarray:
        """What a score must reach to matter; minus infinity, or the floor, while places are free. A long is rounded to a double, which the slack of upper bounds allows for."""
        low = np.where(self.floor[at] > -LONG - 1, self.floor[at].astype(float), -np.inf)
        return np.maximum(low, np.where(self.count[at, -1] > 0, self.score[at, -1].astype(float), -np.inf))

    def add(self, at: int, q: np.ndarray, score: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Merges rows (query number from at on, score, ids, number of ids)."""
        who = np.unique(q)
        n = self.score.shape[1]
        rows = at + who
        q = np.concatenate([np.repeat(who, n), q])
        score = np.concatenate([self.score[rows].ravel(), score])
        ids = np.concatenate([self.ids[rows].reshape(-1, n), ids])
        count = np.concatenate([self.count[rows].ravel(), count])
        first = np.where(count > 0, ids[:, 0], LONG)
        order = np.lexsort((first, ~score, count == 0, q))  # ~ turns the order of all 64-bit numbers round
        q = q[order]
        start = np.searchsorted(q, who)
        take = order[(start[:, None] + np.arange(n)).ravel()]
        self.score[rows], self.first[rows] = score[take].reshape(-1, n), first[take].reshape(-1, n)
        self.ids[rows], self.count[rows] = ids[take].reshape(-1, n, n), count[take].reshape(-1, n)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows; those that a long can't hold are the nearest long."""
    top = (float(np.abs(q).max()) if q.size else 0.0) * (float(np.abs(v).max()) if v.size else 0.0) * q.shape[1]
    if top < 2.0**62:
        return np.einsum("ij,ij->i", q, v)
    return np.array([min(max(x, -LONG), LONG) for x in (q.astype(object) * v.astype(object)).sum(axis=1)], np.int64)


def search_block(best: Best, queries: np.ndarray, limits: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, exact: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
    """Brings a block's classes into the best of all queries."""
    low, step, slack = limits
    n, dim = best.score.shape[1], queries.shape[1]
    first, last = codes * step + low - slack, (codes + 1) * step + low + slack
    mid, half, most = (first + last) / 2, (last - first) / 2, max(np.abs(first).max(), np.abs(last).max())
    for at in range(0, len(queries), QUERY_ROWS):
        some = slice(at, at + QUERY_ROWS)
        part = queries[some].astype(float)
        size = np.abs(part)
        m, w = part @ mid.T, size @ half.T + (1e-6 + dim * 2.0**-48 * size.sum(axis=1) * most)[:, None]
        upper = m + w
        need = best.bound(some)
        if len(codes) >= n:  # so many of the block's classes reach their lower bounds
            need = np.maximum(need, -np.partition(w - m, n - 1, axis=1)[:, n - 1])
        q, c = np.nonzero(upper >= need[:, None])
        u = upper[q, c]
        order = np.lexsort((-u, q))
        q, c, u = q[order], c[order], u[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        done, more = 0, 2 * n
        while True:
            open_ = (place >= done) & (u >= best.bound(some)[q])
            if not open_.any():
                break
            now = np.flatnonzero(open_ & (place < done + more))
            if len(now):
                best.add(at, q[now], exact_scores(queries[at + q[now]], exact[c[now]]), ids[c[now]], count[c[now]])
            done, more = done + more, 2 * more


def search(limits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], shared, n: int):
    """Over rows of the file: (qh, score, ids) of each task's n best classes for each query of the broadcast batch, of those that reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {dim: (names, np.frombuffer(data, "<i8").reshape(-1, dim)) for dim, (names, data, _) in shared.value.items()}
        best = {dim: Best.none(len(names), n, floor) for dim, (names, _, floor) in shared.value.items()}
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in asked:
                    continue
                mine = np.flatnonzero(dims == dim)
                for at in range(0, len(mine), BLOCK_ROWS):
                    own = b.take(pa.array(mine[at : at + BLOCK_ROWS]))
                    codes, exact = (np.frombuffer(b"".join(own.column(c).to_pylist()), kind).reshape(-1, dim) for c, kind in ((2, np.uint8), (3, "<i8")))
                    ends = np.append(0, np.cumsum(own.column(1).value_lengths().to_numpy()))
                    flat, count = own.column(1).flatten().to_numpy(), np.diff(ends)
                    ids = np.zeros((len(count), n), np.int64)
                    ids[np.repeat(np.arange(len(count)), count), np.arange(len(flat)) - np.repeat(ends[:-1], count)] = flat
                    search_block(best[int(dim)], asked[int(dim)][1], limits[int(dim)], codes, exact, ids, count)
        for dim, (names, _) in asked.items():
            found = best[dim]
            for at in range(0, len(names), 1024):
                some = slice(at, at + 1024)
                q, place = np.nonzero((found.count[some] > 0) & (found.score[some] >= found.floor[some, None]))
                if len(q):
                    q = q + at
                    lists = pa.array([found.ids[i, p, : found.count[i, p]].tolist() for i, p in zip(q, place, strict=True)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], pa.binary()), pa.array(found.score[q, place]), lists], ["qh", "score", "ids"])

    return run


HIT = "qh binary, score long, ids array<long>"


def in_rounds(file: DataFrame, parts: int, first: int = ROUND) -> list[DataFrame]:
    """The rows of a file of at most so many partitions, written by rounds: `first` partitions, then ROUND times as many as all before, and so on. Each round reads its own folders alone."""
    spark, path = file.sparkSession, scratch_path(file.sparkSession, "cells")
    p = F.spark_partition_id()
    number = F.when(p < first, 0).otherwise(F.floor(F.log2(p / F.lit(first)) / F.lit(float(np.log2(1 + ROUND)))).cast("int") + 1)
    file.select("dim", "ids", "codes", "exact", number.alias("_round")).write.partitionBy("_round").parquet(path)
    rows = spark.read.schema("dim int, ids array<long>, codes binary, exact binary, _round int").parquet(path)
    last, ends = 0, first
    while ends < parts:
        last, ends = last + 1, ends * (1 + ROUND)
    return [rows.where(F.col("_round") == i).select("dim", "ids", "codes", "exact") for i in range(last + 1)]


def batch_hits(rounds: list[DataFrame], limits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], batch: dict[int, tuple[list[bytes], list[bytes]]], n: int) -> DataFrame:
    """(qh, score, ids) of rows among which are the n best classes of each query of a batch; a number a query comes to the driver between rounds."""
    sc, floors, found = rounds[0].sparkSession.sparkContext, {}, None
    for i, rows in enumerate(rounds):
        shared = sc.broadcast({dim: (hs, b"".join(vs), np.array([floors.get(h, -LONG - 1) for h in hs], np.int64)) for dim, (hs, vs) in batch.items()})
        made = cut(rows.mapInArrow(search(limits, shared, n), HIT))
        found = made if found is None else found.unionByName(made)
        if i + 1 < len(rounds):
            nth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(n - 1))  # a query has as many rows as tasks of the first round send, and few of later ones
            floors = {bytes(r["qh"]): r["s"] for r in found.groupBy("qh").agg(nth.alias("s")).where("s is not null").toLocalIterator()}
    return found


def exact_top_k(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 5, scale: float = 256.0, bits: int = BITS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(query_id, rank, id, score): each query's k best rows by integer inner product, itself excluded, ties to the smaller id.

    is_query: a condition on a column named "id". Vectors of different lengths are never compared. Null ids, null vectors
    and vectors with null or non-finite components take no part; empty vectors neither. A query with fewer than k other rows
    gets all of them, one without any gets no row. Rows repeated with the same id and vector count once; of an id with two vectors each is a row
    of its own. Components and scores beyond a long's range are the nearest long.
    """
    assert 1 <= bits <= 8
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vector_col, scale)
    queries = cut(vectors.where(is_query).select(F.col("id").alias("query_id"), "h").distinct())
    classes = cut(vector_classes(vectors, k))
    limits = cell_limits(classes, bits)
    file = approximation_file(classes, limits)
    # A task has a block or more of the file, unless there are cores to spare: each task sends k + 1 rows a query.
    blocks = max(spark.sparkContext.defaultParallelism, classes.count() // BLOCK_ROWS)
    file = cut(file.coalesce(blocks))
    names = cut(queries.groupBy("h").agg(F.count("*").alias("_n")))
    asked = cut(file.select("h", "dim", "exact").join(names, "h", "left_semi"))
    size = asked.agg(F.sum(F.col("dim").cast("long") * 8), F.count("*")).first()
    parts = 1 + max((size[0] or 0) // batch_bytes, size[1] // BATCH_ROWS)
    rounds = in_rounds(file, blocks)
    found = None
    for part in range(parts):  # about batch_bytes each: digests spread the queries evenly
        batch: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for r in asked.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == part).toLocalIterator():
            own = batch.setdefault(r["dim"], ([], []))
            own[0].append(bytes(r["h"])), own[1].append(bytes(r["exact"]))
        made = batch_hits(rounds, limits, batch, k + 1)
        found = made if found is None else found.unionByName(made)
    # The k + 1 best classes of a query hold its k best rows, its own row aside: each class has k + 1 ids at most.
    order = F.row_number().over(Window.partitionBy("qh").orderBy(F.col("score").desc(), "id"))
    ids = found.select("qh", "score", F.explode("ids").alias("id")).withColumn("r", order).where(F.col("r") <= k + 1)
    lists = ids.groupBy("qh").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id")))).alias("hits"))
    keyed = names.join(lists.withColumnRenamed("qh", "h"), "h")
    hits = spread_join(queries, keyed, ["h"], "_n", queries.count())
    hits = hits.select("query_id", F.posexplode(F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)).alias("p", "h"))
    return hits.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.id").alias("id"), (-F.col("h.s")).cast("long").alias("score"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 5 best of every vec_id divisible by 50, against all rows of embeddings."""
    hits = exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.pmod(F.col("id"), F.lit(50)) == 0, 5)
    return hits.withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
