"""Fan-out of accepted rows to keyed tables, with coalescing by business key; rejected rows; field lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.contract import Contract, Field, Table
from ..plans.mapping import Mapping
from ..sources.checkpoint import kept
from .pipeline import TRACE, Flat
from .rules import FEW_ROWS, accepted, error_rows

#: Fields of a default contract's generated ids.
COVERAGE_INPUTS = ("member_id", "plan_id", "coverage_start_date")


def as_text(c: Column, data_type: str) -> Column:
    """The value as text: dates as yyyy-MM-dd."""
    return F.date_format(c, "yyyy-MM-dd") if data_type == "date" else c.cast("string")


def missing(f: Field) -> Column:
    c = F.col(f.name)
    return c.isNull() if f.data_type in ("date", "numeric", "boolean") else text.blank(c)


def generated_id(f: Field, contract: Contract, legacy: bool = False) -> Column:
    """An id from the declared inputs: prefix and 12 hex digits of their SHA-256. legacy, or no inputs: from every value of the row that isn't blank."""
    names = contract.by_name
    if f.name == "coverage_id" or (f.inputs and not legacy):
        prefix = "COV" if f.name == "coverage_id" else (f.name.replace("_id", "").upper()[:8] or "ID")
        parts = [F.coalesce(text.strip(as_text(F.col(i), names[i].data_type)), F.lit("")) for i in (f.inputs or COVERAGE_INPUTS)]
    else:
        prefix = f.name.replace("_id", "").upper()[:8] or "ID"
        parts = [text.clean(as_text(F.col(n), g.data_type)) for n, g in names.items() if not g.generated]
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)))


def candidates(rows: DataFrame, table: Table, contract: Contract) -> DataFrame:
    """A table's columns of the accepted rows, and source_row_number."""
    out = [generated_id(f, contract).alias(f.name) if f.generated else F.col(f.name) for f in table.fields]
    return rows.select("source_row_number", *out)


def key_facts(df: DataFrame, table: Table, statistics: bool = True) -> DataFrame:
    """One row for each business key, without values: _at, its least row number; _n_<column>, the least one with a filled value; for statistics _rows, _conflict and _missing.

    Null keys are a group. All buffers are numbers, so this is a hash aggregate on either side of the shuffle. Texts differ if their two 64-bit hashes do.
    """
    order = F.col("source_row_number")
    others = [f for f in table.fields if f.name not in table.business_key]
    first = [F.min(F.when(~missing(f), order)).alias(f"_n_{f.name}") for f in others]
    if not statistics:
        return df.groupBy(*table.business_key).agg(F.min(order).alias("_at"), *first)
    conflict = F.lit(False)
    for f in others:
        v = F.col(f.name)
        told = [v] if f.data_type in ("date", "numeric", "boolean") else [F.xxhash64(v), F.xxhash64(F.lit("again"), v)]
        for t in told:  # least and greatest differ exactly if there are two distinct ones
            filled = F.when(~missing(f), t)
            conflict = conflict | F.coalesce(F.min(filled) != F.max(filled), F.lit(False))
    lacking = F.lit(False)
    for f in table.fields:
        if f.required:
            lacking = lacking | missing(f)
    return df.groupBy(*table.business_key).agg(F.min(order).alias("_at"), *first, F.count("*").alias("_rows"), conflict.alias("_conflict"), F.count_if(lacking).alias("_missing"))


def coalesce_by_key(df: DataFrame, table: Table, statistics: bool = True) -> DataFrame:
    """One row for each business key: of each other column the first value that isn't blank, in row order; null if there is none. Null keys are a group.

    Row numbers, which are unique, are aggregated first. Values come late: a key's first row is met by its number, and only what it lacks is fetched from the later rows
    that have it, so no text is ever in an aggregate's buffer. df is read again for each step and must give the same rows. Has the columns _rows, _conflict and _missing of
    key_facts if statistics are asked for.
    """
    others = [f.name for f in table.fields if f.name not in table.business_key]
    told = ["_rows", "_conflict", "_missing"] if statistics else []
    facts = kept(key_facts(df, table, statistics))
    values = df.select(F.col("source_row_number").alias("_row"), *[F.col(c).alias(f"_v_{c}") for c in others])
    if not others:
        return facts.select(*[f.name for f in table.fields], *told)
    merged = facts.join(values, F.col("_at") == F.col("_row")).drop("_row")
    later = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"_n_{c}") > F.col("_at"), F.col(f"_n_{c}")) for c in others])))
    asked = kept(facts.select("_at", F.explode(later).alias("_later")))
    count = asked.count()
    if count:  # few rows go to the values, which then aren't shuffled once more
        found = values.join(F.broadcast(asked) if count <= FEW_ROWS else asked, F.col("_later") == F.col("_row"))
        merged = merged.join(found.groupBy("_at").agg(F.collect_list(F.struct("_row", *[f"_v_{c}" for c in others])).alias("_found")), "_at", "left")  # fewer rows a key than columns

    def value(c: str) -> Column:
        n = F.col(f"_n_{c}")
        first = F.when(n == F.col("_at"), F.col(f"_v_{c}"))
        return first if not count else first.when(n.isNotNull(), F.get(F.filter("_found", lambda x: x["_row"] == n), F.lit(0))[f"_v_{c}"])

    return merged.select(*[(F.col(f.name) if f.name in table.business_key else value(f.name)).alias(f.name) for f in table.fields], *told)


def table_stats(facts: DataFrame, table: Table) -> DataFrame:
    """One row: target_table and the counts of candidates, keys, exact and conflicting duplicates, and rows without a required value. facts: of key_facts, or coalesced rows."""
    return facts.agg(
        F.lit(table.name).alias("target_table"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("candidate_count"),
        F.count("*").alias("unique_business_key_count"),
        F.coalesce(F.sum(F.when(~F.col("_conflict"), F.col("_rows") - 1)), F.lit(0)).alias("exact_duplicate_count"),
        F.coalesce(F.sum(F.when(F.col("_conflict") & (F.col("_rows") > 1), F.col("_rows"))), F.lit(0)).alias("conflicting_duplicate_count"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_output_count"),
    )


def tables(typed: DataFrame, issues: DataFrame, contract: Contract, names: list[str] | None = None, statistics: bool = True) -> dict[str, DataFrame]:
    """table: its coalesced rows with the _ columns of coalesce_by_key; of all tables, or those named. typed is read more than once: it should be written, or narrow work on what is."""
    rows = accepted(typed, issues)
    return {t.name: coalesce_by_key(candidates(rows, t, contract), t, statistics) for t in contract.tables if names is None or t.name in names}


def facts(typed: DataFrame, issues: DataFrame, contract: Contract) -> dict[str, DataFrame]:
    """table: its key_facts, which is all that statistics need."""
    rows = accepted(typed, issues)
    return {t.name: key_facts(candidates(rows, t, contract), t) for t in contract.tables}


def output(merged: DataFrame, table: Table) -> DataFrame:
    return merged.select(*[f.name for f in table.fields])


def full_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """For tables without a key: rows once each."""
    return df.select(*columns).dropDuplicates()


# ------------------------------------------------------------------------------------------------- rejected rows


def _distinct_join(issues: str, severity: str, key: str) -> Column:
    """Distinct values in first-seen order, joined by '; '."""
    rows = F.filter(F.col(issues), lambda i: i["severity"] == severity)
    values = F.transform(rows, lambda i: F.trim(i[key]))
    return F.array_join(F.filter(F.array_distinct(values), lambda v: v != ""), "; ")


def issue_rollup(issues: DataFrame) -> DataFrame:
    """(source_row_number, issues): each row's issues in order. A row has at most as many as there are rules and pipelines."""
    fields = F.struct("issue_seq", "severity", "issue_code", "issue_message", "target_field", "source_column")
    return issues.groupBy("source_row_number").agg(F.sort_array(F.collect_list(fields)).alias("_issues"))


def rejected_rows(source: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows with an error: counts, codes, fields, source columns and messages of errors and warnings, then original__<column>."""
    bad = issue_rollup(issues.join(error_rows(issues), "source_row_number", "left_semi"))
    out = [F.col("source_row_number"), F.lit("rejected").alias("row_status")]
    for severity, s in (("error", "error"), ("warning", "warning")):
        out.append(F.size(F.filter("_issues", _has(severity))).cast("long").alias(f"{s}_count"))
        out += [_distinct_join("_issues", severity, k).alias(n) for k, n in (("issue_code", f"{s}_codes"), ("target_field", f"{s}_target_fields"), ("source_column", f"{s}_source_columns"), ("issue_message", f"{s}s"))]
    columns = [c for c in source.columns if c != "source_row_number"]
    return bad.join(source, "source_row_number").select(*out, *[F.col(f"`{c}`").alias(f"original__{c}") for c in columns])


def _has(severity: str):
    return lambda i: i["severity"] == severity


# ------------------------------------------------------------------------------------------------- field lineage


def _description(f: Field, source: str) -> str:
    # What is said of a field without steps of its own.
    if f.generated:
        return "Generated from member_id, plan_id, and coverage_start_date."
    if not source:
        return "No approved source mapping."
    return {
        "date": "Parse source value to a canonical date.",
        "enum": f"Normalize source value to the {f.kind} allowed vocabulary.",
        "email": "Lowercase and validate email format.",
        "phone": "Normalize phone digits to ###-###-####.",
        "identifier": "Trim whitespace and preserve identifier value.",
        "text": "Trim whitespace and preserve text value.",
    }.get(f.data_type, "Normalize source value for the target field.")


def record_id(file_hash: str, row_number: Column) -> Column:
    return F.concat(F.lit("SRC-"), F.upper(F.substring(F.sha2(F.concat(F.lit(file_hash + ":"), row_number.cast("string")), 256), 1, 20)))


LINEAGE = ["source_row_number", "source_record_id", "row_status", "lineage_status", "target_table", "target_field", "target_data_type", "target_validation_kind", "source_column", "source_columns", "source_values_json", "corrected_values_json", "original_value", "normalized_value", "final_value", "transformation_applied", "transformation_trace_json", "contract_version", "mapping_template_version", "parent_import_run_id", "issue_codes", "issue_messages"]


ISSUES = "array<struct<issue_seq:int,severity:string,issue_code:string,issue_message:string,target_field:string,source_column:string>>"


def _joined(rows: DataFrame, issues: DataFrame, corrections: DataFrame | None) -> DataFrame:
    """rows with _issues and _fixed, the corrected values by source column."""
    df = rows.join(issue_rollup(issues), "source_row_number", "left").withColumn("_issues", F.coalesce("_issues", F.array().cast(ISSUES)))
    if corrections is None:
        return df.withColumn("_fixed", F.lit(None).cast("map<string,string>"))
    fixed = corrections.groupBy("source_row_number").agg(F.map_from_entries(F.collect_list(F.struct("source_column", "corrected_value"))).alias("_fixed"))
    return df.join(fixed, "source_row_number", "left")


def _clustered(rows: DataFrame, issues: DataFrame, corrections: DataFrame | None, record: Column, part: tuple[int, int]) -> DataFrame:
    """As _joined, of one part of the records, in the order of record ids. Rows, issues and corrections are dealt by ranges of the ids, so that they meet where they are sorted and each is shuffled once."""
    parts = [rows.select("source_row_number", F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_line"))]
    parts.append(issues.select("source_row_number", F.struct("issue_seq", "severity", "issue_code", "issue_message", "target_field", "source_column").alias("_issue")))
    if corrections is not None:
        parts.append(corrections.select("source_row_number", F.struct("source_column", "corrected_value").alias("_fix")))
    dealt = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("_id", record)
    if part[1] > 1:  # ids are hashes: their first 16 bits after SRC- tell the part
        dealt = dealt.where(F.floor(F.conv(F.substring("_id", 5, 4), 16, 10).cast("long") * part[1] / 65536) == part[0])
    dealt = dealt.repartitionByRange("_id")
    own = Window.partitionBy("_id", "source_row_number")
    fixed = F.map_from_entries(F.collect_list("_fix").over(own)) if corrections is not None else F.lit(None).cast("map<string,string>")
    met = dealt.withColumns({"_issues": F.sort_array(F.collect_list("_issue").over(own)).cast(ISSUES), "_fixed": fixed}).where("_line is not null")
    return met.sortWithinPartitions("_id", "source_row_number").select("_line.*", "_issues", "_fixed")


def lineage(flat: Flat, typed: DataFrame, issues: DataFrame, file_hash: str = "", corrections: DataFrame | None = None, template_version: str = "", parent_run: int | None = None, clustered: bool = False, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """One row for each source row and target field, 22 columns: where a value came from, what was done to it, and its state.

    The issues of a row are joined once as an array. A row is then repeated for each field's number; what is fixed for a field is looked up by the number, and
    what comes from the row is chosen by it. So a query of a few columns works out no others. corrections: (source_row_number, source_column, corrected_value).
    clustered: rows are put in the order of their record ids, before they are repeated, so that what is stored can be looked up by record. part, of clustered lineage: (k, n), the
    k-th of n parts of the records, by ranges of their ids.
    """
    contract = flat.contract
    fields = contract.fields
    place = {(m.table, m.field): k for k, m in enumerate(flat.mappings)}
    mapped = [flat.mappings[place[f.table, f.name]] if (f.table, f.name) in place else None for f in fields]
    inputs = [list(m.columns) if m else [] for m in mapped]
    thin = ["source_row_number", *[f"src__{c}" for c in dict.fromkeys(c for cs in inputs for c in cs)], *[n for n, f in contract.by_name.items() if not f.generated and n in typed.columns], *[f"_p{k}" for k, m in enumerate(flat.mappings) if m.steps]]
    rows = typed.select(*[F.col(f"`{c}`") for c in thin])
    df = _clustered(rows, issues, corrections, record_id(file_hash, F.col("source_row_number")), part) if clustered else _joined(rows, issues, corrections)
    null, number = F.lit(None).cast("string"), F.col("_k")

    def fixed_by_field(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), number)

    def chosen(values: list[Column | None], other: Column) -> Column:
        """values[k] for field number k; other where it is None."""
        out = None
        for k, v in enumerate(values):
            if v is not None:
                out = F.when(number == k, v) if out is None else out.when(number == k, v)
        return other if out is None else out.otherwise(other)

    sources = fixed_by_field([m.source if m else "" for m in mapped])
    rejected = F.exists("_issues", _has("error"))
    df = df.withColumn("_rejected", rejected)
    df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(fields) - 1))))
    name = fixed_by_field([f.name for f in fields])

    def state(m: Mapping, part: str) -> Column:
        """A pipeline's value or trace; of one without steps they are its first source column and nothing."""
        if m.steps:
            return F.col(f"_p{place[m.table, m.field]}")[part]
        return F.array().cast(TRACE) if part == "trace" else F.col(f"`src__{m.columns[0]}`") if m.columns else null

    df = df.withColumns({
        "_mine": F.filter("_issues", lambda i: i["target_field"] == name),
        "_value": chosen([F.when(~F.col("_rejected"), generated_id(f, contract)) if f.generated else as_text(F.col(f.name), f.data_type) for f in fields], null),
        "_trace": chosen([state(m, "trace") if m and m.steps else None for m in mapped], F.array().cast(TRACE)),
        "_before": chosen([state(m, "v") if m and not f.generated else None for f, m in zip(fields, mapped, strict=True)], null),
        "_generated": number.isin(*[k for k, f in enumerate(fields) if f.generated]) if any(f.generated for f in fields) else F.lit(False),
    })
    value, made = F.col("_value"), F.col("_generated")
    said = F.when(made, "Generated from the target table business values.").otherwise("Applied target data type and validation vocabulary normalization.")
    note = F.struct(F.when(made, "generate_deterministic_id").otherwise("canonical_normalize").alias("operation"), F.col("_before").alias("input"), value.alias("output"), F.lit("applied").alias("status"), said.alias("message"))
    noted = (made & value.isNotNull()) | (~made & ~F.col("_before").eqNullSafe(value))
    df = df.withColumns({
        "_trace": F.when(noted, F.concat("_trace", F.array(note))).otherwise(F.col("_trace")),
        "_errors": F.exists("_mine", _has("error")), "_warnings": F.exists("_mine", _has("warning")),
        "_ordered": F.concat(F.filter("_mine", _has("error")), F.filter("_mine", _has("warning"))),
    })

    def joined(key: str) -> Column:
        return F.array_join(F.filter(F.array_distinct(F.transform("_ordered", lambda i: F.trim(i[key]))), lambda v: v != ""), "; ")

    whole = {"ignoreNullFields": "false"}
    values = [F.to_json(F.struct(*[F.col(f"src__{c}").alias(c) for c in cs]), whole) if cs else None for cs in inputs]
    corrected = [F.coalesce(F.to_json(F.map_filter("_fixed", lambda c, _: c.isin(cs)), whole), F.lit("{}")) if cs else None for cs in inputs]  # noqa: B023
    applied = F.array_join(F.transform("_trace", lambda t: t["operation"]), ", ")
    out = {
        "source_record_id": record_id(file_hash, F.col("source_row_number")), "row_status": F.when(F.col("_rejected"), "rejected").otherwise("accepted"),
        "lineage_status": F.when(F.col("_errors"), "error").when(F.col("_warnings"), "warning").when(F.col("_rejected"), "not_published_row_rejected").otherwise("accepted"),
        "target_table": fixed_by_field([f.table for f in fields]), "target_field": name, "target_data_type": fixed_by_field([f.data_type for f in fields]), "target_validation_kind": fixed_by_field([f.kind for f in fields]),
        "source_column": sources, "source_columns": sources, "source_values_json": chosen(values, F.lit("{}")), "corrected_values_json": chosen(corrected, F.lit("{}")),
        "original_value": chosen([F.col(f"src__{cs[0]}") if cs else None for cs in inputs], null), "normalized_value": value, "final_value": value,
        "transformation_applied": F.when(applied != "", applied).otherwise(fixed_by_field([_description(f, m.source if m else "") for f, m in zip(fields, mapped, strict=True)])),
        "transformation_trace_json": F.to_json("_trace"), "issue_codes": joined("issue_code"), "issue_messages": joined("issue_message"),
        "contract_version": F.lit(contract.version), "mapping_template_version": F.lit(template_version), "parent_import_run_id": F.lit(parent_run).cast("long"),
    }
    return df.select("source_row_number", *[c.alias(n) for n, c in out.items()]).select(*LINEAGE)


#: Rows that a part of lineage has at least, and parts at most: what is shuffled at once is an eighth of a large file.
PART_ROWS, PARTS = 2_000_000, 8


def lineage_parts(flat: Flat, typed: DataFrame, *more, **options) -> list[DataFrame]:
    """Clustered lineage in parts that together are the whole, to be stored one after the other (Store.append). The rows are read again for each."""
    n = min(PARTS, 1 + typed.count() // PART_ROWS)
    return [lineage(flat, typed, *more, **options, clustered=True, part=(k, n)) for k in range(n)]
