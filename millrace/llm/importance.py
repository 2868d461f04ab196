"""Importance resampling towards a target: documents are drawn by how much likelier their hashed n-grams are in a target than in all documents.

Everything is DataFrame expressions. N-grams are exploded and hashed to buckets; grouped counts of the buckets of both tables give a table of one gain a bucket,
of as many rows as there are buckets, which is broadcast; a document's weight is the sum of its n-grams' gains, partly summed before thin rows
are shuffled. Gumbel noise from a hash of the id turns the highest scores into a draw without replacement. One distributed sort orders the
scores; the sizes of the partitions before it and a row's place in its own make its rank.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BUCKETS = 10_000
SHARE = 10  # in a hundred
MIN_WORDS = 20
SEED = 2024
#: A word: what is left between ASCII characters that are neither digits nor lower-case letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """array<string>: the words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def grams_of(words: Column, longest: int) -> Column:
    """All runs of 1 to longest consecutive words, joined by a space, repeats included."""
    if longest == 1:
        return words

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *[runs(n) for n in range(2, longest + 1)])


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): the n-grams of all rows in each bucket that has any."""
    grams = texts.select(F.explode(grams_of(words_of(F.col(text_col)), longest)).alias("gram"))
    return grams.groupBy(bucket_of(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain long) for every bucket that documents have: 1000 times the logarithm of its smoothed frequency in the target over that in the documents, floored."""
    source = cut(bucket_counts(docs, text_col, longest, buckets).withColumnRenamed("n", "s"))
    wanted = cut(bucket_counts(target, target_col, longest, buckets).withColumnRenamed("n", "t"))
    sums = [frame.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for frame, c in ((source, "s"), (wanted, "t"))]
    ratio = (F.coalesce("t", F.lit(0)).cast("double") + 1) * F.lit(float(sums[0] + buckets)) / ((F.col("s").cast("double") + 1) * F.lit(float(sums[1] + buckets)))
    return source.join(F.broadcast(wanted), "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(id_col: Column, seed: int) -> Column:
    """1000 times a Gumbel variate of the id, floored: the same for the same id and seed, wherever and whenever it runs. A null id is an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """id, n_features, weight, score, rank for each row of docs; rank is null for rows that aren't drawn.

    Of the N rows with min_words words or more, floor(share * N / 100) are drawn, highest scores first, equal scores by id, null ids last. Null and
    empty texts have no words and a weight of 0. Rows with the same id and text have the same score and a rank each. An empty target, or empty docs, is
    smoothed as any other. Extra columns take no part.
    """
    gain = gains(docs, target, text_col, target_col, longest, buckets)  # a row for each bucket at most: the bound of the broadcast
    # Row numbers hold within this one plan over a scan; they tell rows with the same id apart.
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"), F.monotonically_increasing_id().alias("row"))
    grams = rows.select("row", "id", F.size("words").alias("n_words"), F.explode_outer(grams_of(F.col("words"), longest)).alias("gram"))
    met = grams.select("row", "id", "n_words", bucket_of(F.col("gram"), buckets).alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    summed = met.groupBy("row", "id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = cut(summed.select("row", "id", (F.col("n_words") >= min_words).alias("enough"), "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score")))
    drawn = share * scored.where("enough").count() // 100
    return ranked(scored, drawn).select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("enough") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """scored with place: 1, 2, 3 and so on over rows with enough words, highest scores first. Beyond the drawn ones places say nothing."""
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order))  # written, so that a partition's number and order stay
    placed = placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a number for each partition
    before = list(accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)), initial=0))
    offsets = F.from_json(F.lit(str(before)), "array<bigint>")
    return placed.withColumn("place", F.get(offsets, F.col("part")) + F.col("at") + 1)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of documents, drawn towards benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words,
             row_number() OVER () AS n FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
bits AS (SELECT i, list_reduce([i::UBIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits),
raw AS (SELECT DISTINCT w FROM (SELECT unnest(words) AS w FROM d UNION ALL SELECT w FROM b)),
hashed AS (SELECT w, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, octet_length(encode(w)) + 1), lambda k: ('0x' || substr(hex(encode(w)), (2 * k - 1)::INT, 2))::UBIGINT)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM raw, crc_table),
dw AS (SELECT n, unnest(words) AS w FROM d),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM dw) AS big_s, (SELECT count(*) FROM b) AS big_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT n, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY n),
scored AS (SELECT n, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
           FROM d LEFT JOIN weights USING (n)),
placed AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM placed) THEN place END AS rank FROM scored LEFT JOIN placed USING (n)
"""
