"""Source files as frames of text columns with a row number, and their fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import csv_splits
from .checkpoint import cut, kept

# Texts that count as missing when a CSV is read.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def null_tokens(df: DataFrame, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if c != "source_row_number" else F.col(c) for c in df.columns])


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows on all cores where its files are too few or small to make a task for each; larger scans stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def number_rows(df: DataFrame, first: int = 2, block: list[Column] | None = None) -> DataFrame:
    """source_row_number in file order, from 2 (the header is line 1): rows are counted by partition, or by block of a file, then each row is its block's offset and its place in it.

    One count for each block reaches the driver. block: columns that name a row's block and order the blocks; a partition if there are none. The frame must be read in the same
    partitions twice, as files and checkpoints are.
    """
    df = df.drop("source_row_number")  # an exported file's own numbers are no identity
    block = block or [F.spark_partition_id()]
    keys = [f"_b{k}" for k in range(len(block))]
    tagged = df.select("*", *[c.alias(k) for c, k in zip(block, keys, strict=True)], F.monotonically_increasing_id().alias("_m"))
    sizes = tagged.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_m").alias("low")).orderBy(*keys)
    at, starts = first, []
    for r in sizes.collect():
        starts.append((*[r[k] for k in keys], at - r["low"]))  # a block's rows follow one another in a partition
        at += r["n"]
    kinds = [f"{k} {sizes.schema[k].dataType.simpleString()}" for k in keys]
    starts_df = df.sparkSession.createDataFrame(starts, ", ".join([*kinds, "_s long"]))
    out = tagged.join(F.broadcast(starts_df), keys)
    return out.select((F.col("_s") + F.col("_m")).alias("source_row_number"), *[F.col(f"`{c}`") for c in df.columns])


def quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether a line of the file has an odd number of quotes, so that a value may go on in the next line."""
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).where(odd % 2 == 1).limit(1).count() > 0


def read_csv(spark: SparkSession, path: str, tokens: tuple[str, ...] = NA_TOKENS, multiline: bool | None = None) -> DataFrame:
    """CSV files with a header: every column as text (leading zeros stay), missing tokens as nulls, rows numbered in the order of the files' names.

    Files are read in splits, also if values hold line breaks; these need a pass more. multiline says whether they do; by default the file is looked at.
    """
    multiline = quoted_newlines(spark, path) if multiline is None else multiline
    df = spark.read.options(header=True, multiLine=multiline, escape='"', inferSchema=False, mode="PERMISSIVE").csv(path)
    if multiline:
        rows = csv_splits.read_records(spark, path, [f"_c{k}" for k in range(len(df.columns))])
        return null_tokens(rows.select("source_row_number", *[F.col(f"_c{k}").alias(c) for k, c in enumerate(df.columns) if c != "source_row_number"]), tokens)
    return null_tokens(number_rows(df, block=[F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]), tokens)


def read_upload(spark: SparkSession, path: str, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """A CSV file that people have edited, with all its own columns as text: its source_row_number is a claim to be checked, and its lines aren't numbered."""
    multiline = quoted_newlines(spark, path)
    df = spark.read.options(header=True, multiLine=multiline, escape='"', inferSchema=False, mode="PERMISSIVE").csv(path)
    if multiline:
        rows = csv_splits.read_records(spark, path, [f"_c{k}" for k in range(len(df.columns))])
        df = rows.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(df.columns)])
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) for c in df.columns])


def numbered(rows: DataFrame, first: int = 2) -> DataFrame:
    """source_row_number of rows that are sorted within and between their partitions. They are written once: a row is its file's offset and its place in the file, however the file is split.

    One count for each file reaches the driver.
    """
    placed = kept(rows.drop("source_row_number"))
    tagged = placed.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    part = F.regexp_extract("_f", r"part-(\d+)[^/]*$", 1).cast("long")  # as a number: names have five digits at least
    starts, at = [], first
    for r in tagged.groupBy("_f").agg(F.count("*").alias("n")).orderBy(part, "_f").collect():
        starts.append((r["_f"], at))
        at += r["n"]
    out = tagged.join(F.broadcast(rows.sparkSession.createDataFrame(starts, "_f string, _s long")), "_f")
    return out.select((F.col("_s") + F.col("_i")).alias("source_row_number"), *[F.col(f"`{c}`") for c in placed.columns])


def ordered_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """source_row_number from 2 by a total order of the columns, by one range partitioning: no single-task sort."""
    return numbered(df.orderBy(*columns))


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """One UTF-8 file with a header for people; many for large results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, escape=chr(34), ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)  # quotes are doubled, as read_csv takes them; blanks stay


def export_csv(df: DataFrame, path: str, order: list[str], parts: int | None = None) -> list[int]:
    """df in a total order as numbered part files that make one CSV file when they are joined by their names: the header is in the first alone. Nulls sort first, as in the order's columns.

    Rows are range-partitioned and sorted within parts, so no task has all of them. Returns the rows of each part, which _parts.json has as well. Rows that are alike in the order stay together.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))  # written, so that parts are the same when counted and when exported
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    tagged = placed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), line.alias("line"))
    sizes = {r["part"]: r["count"] for r in tagged.groupBy("part").count().collect()}  # a number a part
    header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in df.columns)
    head = (F.col("part") == min(sizes, default=0)) & (F.col("at") == 0)
    made = tagged.select(F.when(head, F.concat(F.lit(header + "\n"), "line")).otherwise(F.col("line")).alias("value")) if sizes else spark.createDataFrame([(header,)], "value string").coalesce(1)
    made.write.mode("overwrite").text(path)
    rows = [n for _, n in sorted(sizes.items())]
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_parts.json")
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file, True)
    try:
        stream.write(bytearray(json.dumps({"columns": df.columns, "order": order, "rows": rows}).encode()))
    finally:
        stream.close()
    return rows


def row_fingerprint(columns: list[str]) -> Column:
    """SHA-256 of a row: its columns by name, as JSON with nulls."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def short_fingerprint(fingerprint: Column) -> Column:
    """The first 12 characters, for people."""
    return F.substring(fingerprint, 1, 12)


def text_fingerprint(columns: list[str]) -> Column:
    """SHA-256 of a row's columns in their order, joined with a unit separator; nulls as a mark of their own."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in columns]), "\x1f"), 256)


def file_fingerprint(df: DataFrame, columns: list[str], rows_a_block: int = 4096) -> DataFrame:
    """(fingerprint): a tree of SHA-256 over rows in order. Rows are hashed by blocks, blocks by blocks of blocks and so on, so no task holds more than a block of hashes."""
    level = df.select(F.col("source_row_number").alias("n"), text_fingerprint(columns).alias("h"))
    most = df.agg(F.max("source_row_number").alias("n")).first()["n"] or 0
    digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), ""), 256).alias("h")
    while True:
        level = level.groupBy(F.floor(F.col("n") / rows_a_block).cast("long").alias("b")).agg(digest).select(F.col("b").alias("n"), "h")
        most //= rows_a_block
        if most < rows_a_block:
            return level.agg(digest.alias("fingerprint"))


def bytes_fingerprint(path: str) -> str:
    """SHA-256 of a local file's bytes."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()


def latest_by_hash(runs: DataFrame, file_hash: str) -> DataFrame:
    """The newest run of a file, none if it is new."""
    return runs.where(F.col("source_file_hash") == file_hash).orderBy(F.col("id").desc()).limit(1)
