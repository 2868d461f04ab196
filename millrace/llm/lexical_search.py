"""Ranked lexical search: an inverted index in shards, searched by MaxScore.

One scan writes the index: a shard is a run of neighbouring rows of one input partition, a row of a Parquet table with the documents' ids and
lengths and, for each term, its postings (places of documents, occurrences). No text is shuffled. Terms that no query has are left
out by a bitmap of fixed size, whose false hits cost space only.

A search takes queries in bounded blocks. In a shard, a query's lists are ordered by their upper bounds, and those whose bounds together can't
reach what the k-th best document has so far are non-essential: only documents in essential lists are candidates, and the
non-essential postings are probed from the highest bound down, as long as a candidate can still qualify. Scores are exact integers. A first pass
over a few shards gives each query a lower bound for its k-th result, which goes to all tasks with the block: most tasks then send next to nothing.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch_path, slices, table

TOP = 20
#: Rows of a shard, and about how many bytes of text.
SHARD_ROWS, SHARD_BYTES = 4096, 8 << 20
#: Bits of the map of terms that queries have: 1 MB, whatever the queries.
BITMAP_BITS = 1 << 23
#: Terms (with repeats) and queries of a block of queries: what is broadcast at once, and what a task holds results for.
BLOCK_TERMS, BLOCK_QUERIES = 1 << 18, 1 << 13
#: Input partitions whose shards give the first bounds.
FIRST_PARTS = 8
#: A term: ASCII letters and digits and all that isn't ASCII; A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for UTF-8 bytes: what is in no term becomes a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


# ------------------------------------------------------------------------------------------------------ index


@dataclass
class Index:
    """rows: one a shard. documents, terms: how many rows have a term, and all their terms."""

    rows: DataFrame
    documents: int
    terms: int


def bitmap_of(words: DataFrame, bits: int = BITMAP_BITS) -> bytes:
    """A bit for the CRC of each word of the column w; at most bits / 32 numbers reach the driver."""
    place = F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(bits)).cast("int")
    made = words.select(F.shiftright(place, 5).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31))).alias("bit"))
    out = np.zeros(bits // 32, "<u4")
    for r in made.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["at"]] = r["bits"]
    return out.tobytes()


class _Shard:
    """Rows gathered for one shard."""

    def __init__(self):
        self.ids, self.lengths, self.names, self.counts, self.sizes = [], [], [], [], []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        self.ids.append(ids)
        for t in texts:
            words = terms_of(t.as_py())
            found = Counter(words)
            self.lengths.append(len(words))
            self.names.extend(found.keys()), self.counts.extend(found.values()), self.sizes.append(len(found))

    def row(self, number: int, bitmap: bytes, bits: int) -> list:
        """number, ids, lengths, terms, documents of each term, places, occurrences. Places and occurrences by term, in the order of the terms."""
        coded = pa.array(self.names, pa.binary()).dictionary_encode()
        terms, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        asked = np.array([bitmap[(c := zlib.crc32(t) % bits) >> 3] >> (c & 7) & 1 for t in terms], bool) if terms else np.zeros(0, bool)
        keep = np.flatnonzero(asked[codes])
        keep = keep[np.argsort(codes[keep], kind="stable")]
        place = np.repeat(np.arange(len(self.sizes)), self.sizes)[keep]
        counts = np.array(self.counts, np.int64)[keep]
        sizes = np.bincount(codes[keep], minlength=len(terms))[asked]
        return [number, pa.concat_arrays(self.ids), np.array(self.lengths, "<i8").tobytes(), [t.decode() for t, a in zip(terms, asked.tolist(), strict=True) if a], sizes.tolist(), place.astype("<u4").tobytes(), counts.astype("<i8").tobytes()]


def build_index(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, bits: int = BITMAP_BITS) -> Index:
    """The index of all rows of docs, written below the shared folder, with the postings of all words in asked (w). Null texts have no terms; ids may be null or repeat."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(bitmap_of(asked, bits))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bitmap, made = TaskContext.get().partitionId(), shared.value, 0

        def closed(shard: _Shard) -> pa.RecordBatch:
            row = shard.row(part << 32 | made, bitmap, bits)
            types = [pa.int64(), pa.list_(row[1].type), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v.to_pylist() if isinstance(v, pa.Array) else v], t) for v, t in zip(row, types, strict=True)], ["shard", "ids", "lengths", "terms", "sizes", "places", "counts"])

        shard, held = _Shard(), 0
        for b in slices(batches, 1, min(500, shard_rows), shard_bytes // 4):
            size = pc.sum(pc.binary_length(b.column(1))).as_py() or 0
            if shard.lengths and (len(shard.lengths) + b.num_rows > shard_rows or held + size > shard_bytes):
                yield closed(shard)
                shard, held, made = _Shard(), 0, made + 1
            shard.add(b.column(0), b.column(1))
            held += size
        if shard.lengths:
            yield closed(shard)

    made = rows.mapInArrow(run, f"shard long, ids array<{kind}>, lengths binary, terms array<string>, sizes array<bigint>, places binary, counts binary")
    path = scratch_path(spark, "lexical-index")
    made.write.option("compression", "zstd").parquet(path)
    index = spark.read.parquet(path)
    return Index(index, *_totals(index))


def _totals(index: DataFrame) -> tuple[int, int]:
    """Rows with a term, and all terms, from the lengths alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for x in b.column(0):
                own = np.frombuffer(x.as_py(), "<i8")
                n, total = n + int((own > 0).sum()), total + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    got = index.select("lengths").mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return got["n"] or 0, got["total"] or 0


# ----------------------------------------------------------------------------------------------------- search


def _before(row: tuple) -> tuple:
    """Sorts (score, id) best first: higher scores, then smaller ids, null ids last."""
    score, i = row
    return (-score, i is None, i if i is not None else 0)


class Block:
    """Queries of a block: for each its terms' numbers and weights (times repeats), and its best rows so far."""

    def __init__(self, facts: dict, k: int):
        self.code, self.k, self.documents, self.terms = facts["code"], k, facts["documents"], facts["terms"]
        self.queries, self.bound = facts["queries"], facts["bound"]
        self.best: list[list[tuple]] = [[] for _ in self.queries]

    def least(self, q: int) -> tuple | None:
        """The row that a new one must come before: the k-th best so far or the one of the first pass, whichever is better."""
        own = self.best[q][self.k - 1] if len(self.best[q]) >= self.k else None
        first = self.bound[q]
        if own is None or first is None:
            return own or first
        return min(own, first, key=_before)

    def search(self, ids: pa.Array, lengths: np.ndarray, terms: list[str], sizes: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        """Brings a shard's documents into the best of all queries."""
        ends = np.cumsum(sizes)
        lists = {self.code[t]: j for j, t in enumerate(terms) if t in self.code}
        if not lists:
            return
        m = np.array([75 + 25 * n * self.documents // self.terms for n in lengths.tolist()], np.int64)
        impact = 1_000_000_000 * counts // (1000 * counts + 12 * m[places])
        most = np.maximum.reduceat(impact, ends - sizes)
        order = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        score = np.zeros(len(lengths), np.int64)
        for q, (codes, weights) in enumerate(self.queries):
            mine = [(w * int(most[j]), w, j) for c, w in zip(codes, weights, strict=True) if (j := lists.get(c)) is not None]
            least = self.least(q)
            need = least[0] if least else 1
            if not mine or sum(x[0] for x in mine) < need:
                continue
            mine.sort()
            bounds = np.cumsum([x[0] for x in mine]).tolist()
            essential = next(i for i, b in enumerate(bounds) if b >= need)
            score[:] = 0
            for _, w, j in mine[essential:]:
                own = slice(ends[j] - sizes[j], ends[j])
                score[places[own]] += w * impact[own]
            rows = np.flatnonzero(score)
            for i in range(essential - 1, -1, -1):
                rows = rows[score[rows] + bounds[i] >= need]
                if not len(rows):
                    break
                _, w, j = mine[i]
                own = places[ends[j] - sizes[j] : ends[j]]
                at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
                there = own[at] == rows
                score[rows[there]] += w * impact[ends[j] - sizes[j] + at[there]]
            rows = rows[score[rows] >= need]
            if len(rows):
                rows = rows[np.lexsort((order[rows], -score[rows]))][: self.k]
                new = [(int(score[r]), ids[int(r)].as_py()) for r in rows]
                if self.bound[q] is not None:
                    new = [x for x in new if _before(x) <= _before(self.bound[q])]
                self.best[q] = sorted(self.best[q] + new, key=_before)[: self.k]


def _search_rows(index: DataFrame, facts: dict, k: int) -> DataFrame:
    """(q, id, score): each task's best rows for the queries of a block."""
    shared = index.sparkSession.sparkContext.broadcast(facts)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    arrow = index.select("ids").limit(0).toArrow().schema.field("ids").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value, k)
        for b in batches:
            for r in range(b.num_rows):
                lengths, places, counts = (np.frombuffer(b.column(c)[r].as_py(), t) for c, t in ((1, "<i8"), (4, "<u4"), (5, "<i8")))
                block.search(b.column(0)[r].values, lengths, b.column(2)[r].as_py(), b.column(3)[r].values.to_numpy(), places.astype(np.int64), counts)
        for at in range(0, len(block.best), 512):
            found = [(q, i, s) for q, rows in enumerate(block.best[at : at + 512], at) for s, i in rows]
            if found:
                q, i, s = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, arrow), pa.array(s, pa.int64())], ["q", "id", "score"])

    return index.select("ids", "lengths", "terms", "sizes", "places", "counts").mapInArrow(run, f"q long, id {kind}, score long")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def search_block(index: Index, queries: list[dict[str, int]], k: int) -> DataFrame:
    """(q, id, score, rank): the k best rows of each query, a query being its terms and their repeats."""
    spark = index.rows.sparkSession
    vocabulary = spark.createDataFrame([(t,) for t in sorted({t for q in queries for t in q})], "term string")
    lists = index.rows.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("n"))
    df = {r["term"]: r["df"] for r in lists.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).collect()}  # terms of a block
    weight = {t: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1))) for t, n in df.items()}
    code = {t: c for c, (t, w) in enumerate(sorted(weight.items())) if w > 0}
    terms = [[(code[t], weight[t] * n) for t, n in q.items() if t in code] for q in queries]
    facts = {"code": code, "documents": index.documents, "terms": index.terms, "queries": [([c for c, _ in q], [w for _, w in q]) for q in terms], "bound": [None] * len(queries)}
    first = index.rows.where(F.col("shard") < FIRST_PARTS << 32)
    for r in _best_of(_search_rows(first, facts, k), k).where(F.col("rank") == k).collect():  # a row a query of the block
        facts["bound"][r["q"]] = (r["score"], r["id"])
    return _best_of(_search_rows(index.rows, facts, k), k)


def search(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, k: int = TOP, block_terms: int = BLOCK_TERMS, block_queries: int = BLOCK_QUERIES, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item, rank, id, score: the k rows of docs with the highest scores above 0 for each row of queries (all, if fewer).

    Equal scores go by id, null ids last; of rows with the same id each is a document of its own, and so is each row of queries, with its own ranks, also if items
    repeat or are null. Null texts have no terms: such documents are never found and don't count, such queries have no rows. A query of more than block_terms
    terms is a block of its own. Extra columns take no part.
    """
    spark = docs.sparkSession
    text = F.translate(F.coalesce(F.col(item_text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    asked = cut(queries.select(F.monotonically_increasing_id().alias("_q"), F.col(item_col).alias("_item"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("words")))
    words = asked.select(F.explode("words").alias("w"))
    index = build_index(docs, id_col, text_col, words, shard_rows, shard_bytes)
    path, kind = scratch_path(spark, "lexical-hits"), index.rows.schema["ids"].dataType.elementType.simpleString()
    spark.createDataFrame([], f"_q long, id {kind}, score long, rank int").write.parquet(path)
    numbers, block, held = [], [], 0

    def done() -> None:
        of = F.from_json(F.lit(json.dumps(numbers)), "array<bigint>")
        search_block(index, block, k).select(F.get(of, F.col("q").cast("int")).alias("_q"), "id", "score", "rank").write.mode("append").parquet(path)

    for r in asked.select("_q", "words").where(F.size("words") > 0).toLocalIterator():
        if block and (len(block) >= block_queries or held + len(r["words"]) > block_terms):
            done()
            numbers, block, held = [], [], 0
        numbers.append(r["_q"]), block.append(Counter(r["words"]))
        held += len(r["words"])
    if block and index.documents:
        done()
    hits = spark.read.parquet(path)
    return hits.join(asked.select("_q", "_item"), "_q").select(F.col("_item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 best rows of documents for each row of benchmark."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
qt AS (SELECT q, w, count(*) AS times FROM (SELECT q, unnest(ws) AS w FROM q) GROUP BY q, w),
sums AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT row, w, count(*) AS tf FROM (SELECT row, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM qt) GROUP BY row, w),
weight AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, sums GROUP BY w, n_docs),
part AS (SELECT row, w, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(ws) * n_docs) // n_terms)) AS part FROM tf JOIN d USING (row), sums),
scored AS (SELECT q, row, sum(times * weight * part)::BIGINT AS score FROM qt JOIN part USING (w) JOIN weight USING (w) GROUP BY q, row HAVING score > 0),
ranked AS (SELECT q, row, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, row) AS r FROM scored JOIN d USING (row))
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked JOIN q USING (q) JOIN d USING (row) WHERE r <= 20
"""
