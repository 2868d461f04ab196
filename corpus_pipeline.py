"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, near_copies, packing, secrets, toxicity
from millrace.llm.common import crc_fold, scratch_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of REJECT or more go. The model learns from the labelled documents of the table, but for the held-out fold."""
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), lambda i: crc_fold(i, 4) != 2)
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), model, keep=COLUMNS)
    return scored.where(F.col("_toxicity") < toxicity.REJECT).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with most code points, then the smallest doc_id, stays."""
    return exact_dedup.first_of_each(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id.

    Near-duplicates have five-word shingle sets with a Jaccard similarity of 0.8 or more, and the sets decide. Candidates come from min-hash bands and sketches compared with the bit-sliced
    kernel of the SimHash operator, not from SimHash fingerprints: those can't tell 0.8 from 0.7 where passages were replaced, and lost 15 % of the pairs and 18 clean documents when tried.
    """
    return near_copies.representatives(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars follows the text."""
    found = secrets.scan_secrets(docs.select(*COLUMNS), "text", "_spans")
    text = secrets.redacted(F.col("text"), F.col("_spans"))
    changed = F.size("_spans") > 0
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_exact_copies), ("simhash near-dedup", drop_near_copies), ("secret scans", mask_secrets), ("best-fit packing", pack)]
#: SQL can't express the classifier, the fingerprints and the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
