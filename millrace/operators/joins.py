"""Looking values up in tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.checkpoint import cut

#: Distinct values whose targets are broadcast at most, counted before.
FEW_VALUES = 200_000


def crosswalk_targets(values: DataFrame, crosswalk: DataFrame, folded: bool) -> DataFrame:
    """(value, target, n): for each distinct value (with its count n) the target of its equal source_value, or else, if folded, of one that is equal without case and blanks around it.

    crosswalk: (source_value, target_value). Of a source_value given twice the smaller target holds, of several that fold alike the smallest one's. Values
    that aren't in the crosswalk have no row. Two equi-joins of distinct values.
    """
    pairs = crosswalk.select(F.col("source_value").cast("string").alias("_k"), F.col("target_value").cast("string").alias("_t")).where("_k is not null")
    exact = pairs.groupBy("_k").agg(F.min("_t").alias("_exact"))
    met = values.join(exact, F.col("value") == F.col("_k"), "left").drop("_k")
    if folded:
        fold = lambda c: F.lower(text.strip(c))
        loose = pairs.groupBy(fold(F.col("_k")).alias("_f")).agg(F.min(F.struct("_k", "_t"))["_t"].alias("_loose"))
        rest = met.where("_exact is null").withColumn("_vf", fold(F.col("value"))).join(loose, F.col("_vf") == F.col("_f")).select("value", "n", F.col("_loose").alias("target"))
        return met.where("_exact is not null").select("value", "n", F.col("_exact").alias("target")).unionByName(rest).where("target is not null")
    return met.where("_exact is not null").select("value", "n", F.col("_exact").alias("target"))


def look_up(rows: DataFrame, value: Column, crosswalk: DataFrame, folded: bool, into: str, few: int = FEW_VALUES) -> DataFrame:
    """rows with the column into: the target of each row's value, null where there is none or the value is null.

    The targets of the values that occur are worked out once each. Where they are few they are broadcast; else those of frequent values are (a value in more than a quarter
    of an even share of a partition: fewer than four times as many as there are partitions), whose rows are dealt out by a salt, and all other rows meet theirs by an equi-join.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    found = cut(crosswalk_targets(counted, crosswalk, folded))
    facts = found.agg(F.count("*").alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    keyed = rows.withColumn("_value", value)
    if facts["values"] <= few:
        return keyed.join(F.broadcast(found.select(F.col("value").alias("_value"), F.col("target").alias(into))), "_value", "left").drop("_value")
    frequent = F.col("n") > facts["rows"] / (4 * parts)
    hot = F.broadcast(found.where(frequent).select(F.col("value").alias("_value"), F.col("target").alias("_hot")))
    rest = found.where(~frequent).select(F.col("value").alias("_met"), F.col("target").alias("_target"))
    # Rows of frequent values, and those without one, get a key that no value has: values have no blanks around them.
    told = [F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, T.MapType)]
    spread = F.concat(F.lit(" "), F.pmod(F.xxhash64(*told), F.lit(4 * parts)).cast("string"))  # by the row itself, so that a task that runs again deals its rows out alike
    met = keyed.join(hot, "_value", "left").withColumn("_met", F.when(F.col("_hot").isNotNull() | F.col("_value").isNull(), spread).otherwise(F.col("_value")))
    return met.join(rest, "_met", "left").withColumn(into, F.coalesce("_hot", "_target")).drop("_value", "_met", "_hot", "_target")
