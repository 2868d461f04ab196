"""Column profiles: values counted by column, then all rates in one aggregate over the distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..plans.contract import CROSSWALKS
from ..plans.mapping import column_key

# Words of a header that tell a type.
TEXT_WORDS = ("first", "last", "middle", "name", "carrier", "payer")
ID_WORDS = ("id", "number", "code")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row a column: counts, rates, dates, enum words, inferred type. Rates are of values that aren't blank, to four places.

    Values are counted first, by column, so parsing is done once for each distinct value; approximate counts distinct values by a sketch and parses every value,
    and then no value goes through a shuffle.
    """
    columns = columns or [c for c in df.columns if c != "source_row_number"]
    if approximate:
        from .sketches import sketch

        found = sketch(df, columns, top=0).withColumn("unique_count", F.hll_sketch_estimate("distinct_values"))
        return finish(found.withColumns({f"enum_{k}": F.array_join(f"enum_{k}", ",") for k in CROSSWALKS}), columns)
    long = values_of(df, columns).groupBy("column_name", "v").agg(F.count("*").alias("n"))
    words = {k: F.array_join(c, ",") for k, c in enum_words().items()}
    return finish(classified(long).groupBy("column_name").agg(F.count("v").alias("unique_count"), *measures(), *[c.alias(f"enum_{k}") for k, c in words.items()]), columns)


def values_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, v): a row for each cell."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), text.clean(F.col(f"`{c}`")).alias("v")) for c in columns])))


def classified(long: DataFrame) -> DataFrame:
    """Values with n, the rows that have them: what each of them is."""
    v = F.col("v")
    return long.select("column_name", "v", "n", dates.free(v).alias("d"), text.token(v).alias("t"), F.coalesce(v.rlike(text.EMAIL), F.lit(False)).alias("e"), F.coalesce(F.length(text.digits(v)).isin(10, 11), F.lit(False)).alias("p"), text.number(v).isNotNull().alias("x"))


def measures() -> list[Column]:
    """Aggregates of classified values; those of parts of a table add up."""
    v, n = F.col("v"), F.col("n")
    some = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")
    return [
        F.sum(n).alias("rows"), some(v.isNotNull()).alias("non_null_count"), some(F.col("d").isNotNull()).alias("dates"), some(F.col("e")).alias("emails"), some(F.col("p")).alias("phones"), some(F.col("x")).alias("numbers"),
        F.min("d").alias("min_date"), F.max("d").alias("max_date"),
    ]


def enum_words() -> dict[str, Column]:
    """The words of each crosswalk that values stand for, in order; as many as it has at most."""
    return {kind: F.array_sort(F.collect_set(text.lookup(F.col("t"), pairs))) for kind, pairs in CROSSWALKS.items()}


def finish(p: DataFrame, columns: list[str]) -> DataFrame:
    """Profiles from counts: a row for each of the columns, also of a table without rows."""
    names = p.sparkSession.createDataFrame([(i, c, column_key(c)) for i, c in enumerate(columns)], "_i int, column_name string, normalized_name string")
    p = F.broadcast(names).join(p, "column_name", "left")  # a frame without rows has profiles too
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    whole, none = count("non_null_count"), lambda c: F.coalesce(F.col(c), F.lit(""))
    p = p.orderBy("_i").select(
        "column_name", "normalized_name", whole.alias("non_null_count"), F.when(count("rows") > 0, F.round(1 - whole / count("rows"), 4)).otherwise(0.0).alias("null_rate"), count("unique_count").alias("unique_count"), _rate(count("unique_count"), whole).alias("unique_rate"),
        _rate(count("dates"), whole).alias("date_parse_rate"), _rate(count("emails"), whole).alias("email_pattern_rate"), _rate(count("phones"), whole).alias("phone_pattern_rate"), _rate(count("numbers"), whole).alias("numeric_parse_rate"),
        *[none(f"enum_{k}").alias(f"enum_{k}") for k in CROSSWALKS], *[F.date_format(d, "yyyy-MM-dd").alias(d) for d in ("min_date", "max_date")],
    )
    return p.withColumn("inferred_type", inferred_type())


def inferred_type() -> Column:
    words = F.split("normalized_name", " ")
    has = lambda ws: F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws]))
    any_enum = F.concat(*[F.col(f"enum_{k}") for k in CROSSWALKS]) != ""
    return (
        F.when(F.col("email_pattern_rate") >= 0.6, "email").when(F.col("phone_pattern_rate") >= 0.6, "phone").when(F.col("date_parse_rate") >= 0.7, "date").when(any_enum, "enum")
        .when(has(TEXT_WORDS), "text").when(has(ID_WORDS), "identifier").when(F.col("numeric_parse_rate") >= 0.85, "numeric").when((F.col("non_null_count") > 0) & (F.col("unique_rate") <= 0.1), "enum").otherwise("text")
    )


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), text.clean(F.col(f"`{c}`")).alias("value")) for c in columns])
    return df.select("source_row_number", F.inline(pairs)).where("value is not null") if "source_row_number" in df.columns else df.select(F.inline(pairs)).where("value is not null")


def top_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """(column_name, value, row_count, rank): most frequent first, equal counts by value."""
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("row_count").desc(), "value"))
    return _long(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("row_count")).withColumn("rank", rank).where(F.col("rank") <= n)


def sample_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """(column_name, value, rank): the first n distinct values in row order."""
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("first_row", "value"))
    return _long(df, columns).groupBy("column_name", "value").agg(F.min("source_row_number").alias("first_row")).withColumn("rank", rank).where(F.col("rank") <= n)


def display(p: DataFrame) -> DataFrame:
    """Rates as percentages to one place, for people."""
    rates = ["null_rate", "unique_rate", "date_parse_rate", "email_pattern_rate", "phone_pattern_rate", "numeric_parse_rate"]
    return p.select("column_name", "normalized_name", "inferred_type", "unique_count", *[F.round(F.col(r) * 100, 1).alias(r) for r in rates])


def profiles_for_mapping(df: DataFrame, columns: list[str] | None = None) -> list[dict]:
    """Profiles as the mapping functions take them; a row and ten values a column reach the driver."""
    columns = columns or [c for c in df.columns if c != "source_row_number"]
    values: dict[str, list[str]] = {}
    for r in [*sample_values(df, columns).orderBy("column_name", "rank").collect(), *top_values(df, columns).orderBy("column_name", "rank").collect()]:
        values.setdefault(r["column_name"], []).append(r["value"])
    rows = [r.asDict() for r in profile(df, columns).collect()]
    return [r | {"samples": values.get(r["column_name"], []), "known_enum_matches": {k: r[f"enum_{k}"].split(",") for k in CROSSWALKS if r[f"enum_{k}"]}} for r in rows]
