"""Profiles that merge: what is kept of a file is a row a column, and rows of several files add up to the profile of them all.

Counts, dates and enum words are exact. Distinct values are a HyperLogLog sketch, frequent values a sketch of at most ITEMS items (exact while a column has fewer
than three quarters as many distinct values), samples the first values by row number. No value is shuffled: a task sends a row a column, and a few samples.
A file that was sketched is never read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.contract import CROSSWALKS
from .profile import classified, enum_words, finish, measures, values_of

#: Frequent values that a sketch follows; a power of two.
ITEMS = 1024
#: Logarithm of the registers of a sketch of distinct values: 2 ** 14 have a standard error below 1 %.
REGISTERS = 14
_SUMS = ("rows", "non_null_count", "dates", "emails", "phones", "numbers")


def _tops(call: str, column: str, items: int):
    return F.expr(f"{call}({column}, {items})")


def sketch(df: DataFrame, columns: list[str] | None = None, top: int = ITEMS, samples: int = 0) -> DataFrame:
    """One row a column of what merge and to_profile need. top: items of the sketch of frequent values, 0 for none. samples: first distinct values to keep; they need source_row_number.

    Blank values count as rows and as nothing else. A table without rows gives no row.
    """
    columns = columns or [c for c in df.columns if c != "source_row_number"]
    long = classified(values_of(df, columns).withColumn("n", F.lit(1).cast("long")))
    more = [_tops("approx_top_k_accumulate", "v", top).alias("top_values")] if top else []
    words = [c.alias(f"enum_{k}") for k, c in enum_words().items()]
    made = long.groupBy("column_name").agg(*measures(), F.hll_sketch_agg("v", REGISTERS).alias("distinct_values"), *words, *more)
    return made.join(F.broadcast(_firsts(_task_samples(df, columns, samples), samples)), "column_name", "left") if samples else made  # a few values a column


def _task_samples(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(column_name, first_row, value): the n distinct values with the least row numbers of each task and column."""
    rows = df.select(F.col("source_row_number").cast("long").alias("r"), *[text.clean(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table | None] = [None] * len(columns)
        for b in batches:
            for i in range(len(columns)):
                t = pa.table({"value": b.column(i + 1), "first_row": b.column(0)}).filter(pc.is_valid(b.column(i + 1)))
                t = t.group_by("value").aggregate([("first_row", "min")]).rename_columns(["value", "first_row"])
                if kept[i] is not None:
                    t = pa.concat_tables([t, kept[i]]).group_by("value").aggregate([("first_row", "min")]).rename_columns(["value", "first_row"])
                kept[i] = t.sort_by([("first_row", "ascending"), ("value", "ascending")]).slice(0, n)
        for i, t in enumerate(kept):
            if t is not None and len(t):
                yield pa.RecordBatch.from_pydict({"column_name": [columns[i]] * len(t), "first_row": t["first_row"].combine_chunks(), "value": t["value"].combine_chunks()})

    return rows.mapInArrow(least, "column_name string, first_row long, value string")


def _firsts(found: DataFrame, n: int) -> DataFrame:
    """(column_name, samples): the first n distinct values of (column_name, first_row, value), in order."""
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("first_row", "value"))
    few = found.groupBy("column_name", "value").agg(F.min("first_row").alias("first_row")).withColumn("_r", rank).where(F.col("_r") <= n)
    return few.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("first_row", "value"))).alias("samples"))


def merge(sketches: DataFrame, samples: int = 5) -> DataFrame:
    """The sketches of one table, from those of its parts. Row numbers of the parts are taken to be of one count; with equal ones the smaller value is first."""
    words = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"enum_{k}")))).alias(f"enum_{k}") for k in CROSSWALKS]  # a set of sets of a crosswalk's words
    tops = [_tops("approx_top_k_combine", "top_values", ITEMS).alias("top_values")] if "top_values" in sketches.columns else []
    made = sketches.groupBy("column_name").agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"), F.hll_union_agg("distinct_values").alias("distinct_values"), *words, *tops,
    )
    if "samples" not in sketches.columns:
        return made
    return made.join(F.broadcast(_firsts(sketches.select("column_name", F.inline("samples")), samples)), "column_name", "left")


def to_profile(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """What profile gives, with estimates for unique_count and unique_rate; an estimate is never above the rows that have a value."""
    found = sketches.withColumn("unique_count", F.least(F.hll_sketch_estimate("distinct_values"), F.col("non_null_count")))
    return finish(found.withColumns({f"enum_{k}": F.array_join(f"enum_{k}", ",") for k in CROSSWALKS}), columns)


def top_values(sketches: DataFrame, n: int = 5) -> DataFrame:
    """(column_name, value, row_count, rank): most frequent first, equal counts by value. Counts are exact where the sketch never had to drop an item."""
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("row_count").desc(), "value"))
    items = sketches.select("column_name", F.inline(F.expr(f"approx_top_k_estimate(top_values, {ITEMS})")).alias("value", "row_count")).where("value is not null")
    return items.withColumn("rank", rank).where(F.col("rank") <= n)


def sample_values(sketches: DataFrame, n: int = 5) -> DataFrame:
    """(column_name, value, first_row, rank)."""
    few = sketches.select("column_name", F.posexplode(F.slice("samples", 1, n)).alias("p", "s"))
    return few.select("column_name", F.col("s.value").alias("value"), F.col("s.first_row").alias("first_row"), (F.col("p") + 1).alias("rank"))
