"""Exact dedup by progressive refinement: length, then prefix hash, then a full hash of the surviving groups' content.

Texts are equal when they are the same after deleting ASCII white space. Each step keeps only rows whose group still has two
rows or more. Only thin rows (id, length, hash) are ever shuffled, never a text: the full hash is taken in a scan that a Bloom filter of the surviving ids
thins out. A row that passes it by chance is alone with its full hash, and so changes nothing. Grouping is always partial first; the joins
back spread the rows of a group that holds a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, cut, spread_join, table
from .url_filter import bloom_filter, might_contain

#: Code points of the normalised text that the prefix hash covers.
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def survivors(thin: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key occurs at least twice. thin is checkpointed."""
    many = cut(thin.groupBy(*keys).agg(F.count("*").alias("_size")).where("_size > 1"))
    return cut(spread_join(thin, many, keys, "_size", thin.count(), "left_semi"))


def full_hashes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """((id, points, full_hash) of every row that may have a duplicate; the test of an id for that).

    The test is a Bloom filter of bounded size. When it is full, rows without a duplicate pass it too: more texts are hashed than have to be, in the same scan.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    norm, name = normalised(F.col("text")), lambda i: F.coalesce(i.cast("string"), F.lit(""))
    thin = cut(docs.select(name(F.col("id")).alias("name"), F.octet_length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix")))
    thin = survivors(survivors(thin, ["len"]), ["len", "prefix"])
    left = cut(thin.select("name").distinct())
    blocks, words = bloom_filter(left, "name", left.count())

    def may(i: Column) -> Column:
        return might_contain(name(i), blocks, words)

    return docs.where(may(F.col("id"))).select("id", F.length("text").alias("points"), F.sha2(norm, 256).alias("full_hash")), may


def duplicate_groups(full: DataFrame) -> DataFrame:
    """(full_hash, keep_id, group_size, size) of every text that two rows or more have; all other rows are unique."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id"))).alias("b")
    groups = full.groupBy("full_hash").agg(best, F.count("*").alias("group_size")).where("group_size > 1")
    return groups.select("full_hash", F.col("b.id").alias("keep_id"), "group_size", F.col("group_size").alias("size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size, kept, text_sha256: of equal texts the one with most code points, then the smallest id, stays.

    Null texts count as empty, and empty texts equal each other. A null id sorts last. Rows that share an id count as one
    row of their group each; those with the kept id and text all carry kept, as the id is what stays. text_sha256 is that of
    the normalised text; it also tells rows apart that share an id. Extra columns of docs pass through, but for those named like the four.
    docs must be a scan or a checkpoint, see spread_join.
    """
    extra = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    groups = cut(duplicate_groups(full_hashes(docs, id_col, text_col)[0]))
    base = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(extra)], F.col(id_col).alias("_id"), F.sha2(normalised(F.col(text_col)), 256).alias("full_hash"))
    rest = spread_join(base, groups, ["full_hash"], "size", docs.count(), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    out = [F.col(f"_c{k}").alias(c) for k, c in enumerate(extra)]
    return rest.select(*out, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("_id")).alias("kept"), F.col("full_hash").alias("text_sha256"))


def without(docs: DataFrame, ident: Column, mark: Column, gone: DataFrame, may: Callable[[Column], Column]) -> DataFrame:
    """The rows of docs whose (ident, mark) isn't in gone (_gone, _hash). Rows whose ident fails the test may() stay where they are read; only the others are shuffled."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns)], ident.alias("_id"), mark.alias("_own"))
    out = [F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)]
    asked = rows.where(may(F.col("_id")))
    stay = asked.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_own") == F.col("_hash")), "left_anti")
    return rows.where(~may(F.col("_id"))).select(*out).union(stay.select(*out))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() calls kept. Only texts of rows that may have a duplicate are shuffled; all others stay where they are read.

    Rows are told apart by id and text: repeated rows stay or go together. docs must be a scan or a checkpoint, see spread_join.
    """
    full, may = full_hashes(docs, id_col, text_col)
    full = cut(full)
    found = spread_join(full, cut(duplicate_groups(full)), ["full_hash"], "size", full.count())
    gone = cut(found.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("_gone"), F.col("full_hash").alias("_hash")).distinct())
    return without(docs, F.col(id_col), F.sha2(normalised(F.col(text_col)), 256), gone, may)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents."""
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")  # the optimiser takes the text out before the join


ORACLE = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS p, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY p DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""
