"""Token-ID files: Parquet with a list column of ids.

Files are written in ascending id order: documents are range-partitioned before they are tokenized, so texts move once and
ids never do. Ids are dictionary- or delta-encoded (Parquet format version 2); row groups and pages have a fixed size and the page index is
written, so a reader fetches metadata without the ids, and the ids of a few documents without the rest.

Columns: doc_id, shard int (the file's place in the order), shard_start long (ids before the document within its shard), n_tokens long, tokens array<int>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_u32, scratch_path
from .word_tokens import id_table, map_ids

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer: str | None = None, row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES, dictionary: bool = True) -> None:
    """Writes every row's ids and end_id. Null and empty texts give end_id alone; null ids come first; rows with the same id are in the order of their texts."""

    def start():
        end, me, total = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0

        def make(own: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal total
            n = np.array([len(x) // 4 + 1 for x in ids], np.int64)
            ends = np.cumsum(n)
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.frombuffer(end.join([*ids, b""]), np.int32)))
            begin, total = pa.array(total + ends - n), total + int(ends[-1])
            return pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(len(n), me, np.int32)), begin, pa.array(n), tokens], ["doc_id", "shard", "shard_start", "n_tokens", "tokens"])

        return make

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_t")
    made = map_ids(dealt, "_t", ["doc_id"], start, f"doc_id {kind}, shard int, shard_start long, n_tokens long, tokens array<int>", tokenizer)
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.enable.dictionary": str(dictionary).lower(), "compression": "snappy"}
    made.write.mode("errorifexists").options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading any ids; start counts the ids of all documents before."""
    meta = spark.read.parquet(path).select("doc_id", "shard", "shard_start", "n_tokens")
    return meta.join(_bases(meta), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens")


def _bases(rows: DataFrame) -> DataFrame:
    """(shard, base): the ids before each shard. One total for each shard reaches the driver; shards are files, so their number bounds this."""
    totals = sorted((r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before, base = 0, []
    for shard, n in totals:
        base.append((shard, before))
        before += n
    return F.broadcast(rows.sparkSession.createDataFrame(base, "shard int, base long"))


def read_tokens(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens), of the given document ids alone if there are any: row groups and pages without them are skipped."""
    rows = spark.read.parquet(path)
    return (rows if ids is None else rows.where(F.col("doc_id").isin(ids))).select("doc_id", "n_tokens", "tokens")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what the files hold."""
    rows = spark.read.parquet(path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ends, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            n = np.diff(ends).astype(np.int64)
            crc = [crc32_u32(data[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    made = rows.select("doc_id", "shard", "shard_start", "tokens").mapInArrow(digest, f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return made.join(_bases(rows), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document, from the files written and read back."""
    path = scratch_path(spark, "tokens")
    write_token_files(id_table(spark, sf_dir), path)
    return read_digests(spark, path)
