"""Quality rules: one long issue table.

Rules of a row are one array of structs in a single scan; rules over groups of rows are partial aggregates joined back by their key, so
no group is ever gathered in one task. Issue columns: source_row_number, issue_seq (order within a row), severity, issue_code, issue_message, target_field, source_column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..plans.contract import Contract, Field
from ..sources.checkpoint import kept
from .pipeline import Flat, conflicting_fields, step_issues

ISSUE = ["source_row_number", "issue_seq", "severity", "issue_code", "issue_message", "target_field", "source_column"]
GROUP_SEQ = 100_000
#: Issues of pipelines come before those of rules.
STEP_SEQ = -100_000
CLASH = "conflicting_duplicate_target_field"


class Issues:
    """Collects the row rules of a contract in their order."""

    def __init__(self):
        self.rows: list[Column] = []

    def add(self, when: Column, severity: str, code: str, message: str, field: str) -> None:
        self.rows.append(F.when(when, F.struct(F.lit(len(self.rows)).alias("issue_seq"), F.lit(severity).alias("severity"), F.lit(code).alias("issue_code"), F.lit(message).alias("issue_message"), F.lit(field).alias("target_field"))))


def _null_or_blank(field: Field) -> Column:
    c = F.col(field.name)
    return c.isNull() if field.data_type in ("date", "numeric", "boolean") else text.blank(c)


#: Fields whose invalid values have warnings of their own.
OWN_WARNINGS = ("email", "phone", "gender", "plan_type")


def field_rules(out: Issues, f: Field, asof: Column) -> None:
    gone, raw = _null_or_blank(f), F.col(f"raw__{f.name}")
    if f.required:
        out.add(gone, "error", f"{f.name}_missing_or_invalid", f"{f.name} is missing or invalid.", f.name)
    elif f.name not in OWN_WARNINGS:
        severity = f.rules[0]["severity"] if f.rules else "warning"
        out.add(~text.blank(raw) & gone, severity, f"{f.name}_invalid_{f.data_type}", f"{f.name} could not be normalized as {f.data_type}.", f.name)
    for r in f.rules:
        if r["kind"] == "not_future":
            out.add(F.col(f.name) > asof, r["severity"], f"{f.name}_future", f"{f.name} is in the future.", f.name)
        if r["kind"] == "numeric_range":
            low, high = r["parameters"].get("minimum"), r["parameters"].get("maximum")
            bad = F.lit(False)
            bad = bad | (F.col(f.name) < low) if low is not None else bad
            bad = bad | (F.col(f.name) > high) if high is not None else bad
            out.add(F.coalesce(bad, F.lit(False)), r["severity"], f"{f.name}_out_of_range", f"{f.name} is outside the configured numeric range.", f.name)


def _birth_date(out: Issues, asof: Column) -> None:
    born = F.col("date_of_birth")
    out.add(born > asof, "error", "date_of_birth_future", "date_of_birth is in the future.", "date_of_birth")
    out.add((born <= asof) & (dates.age(born, asof) > 120), "error", "date_of_birth_age_out_of_range", "Member age is outside the supported 0-120 range.", "date_of_birth")


def _coverage_dates(out: Issues, asof: Column) -> None:
    out.add(F.col("coverage_end_date") < F.col("coverage_start_date"), "error", "coverage_end_before_start", "coverage_end_date is before coverage_start_date.", "coverage_end_date")


def _dependents(out: Issues, asof: Column) -> None:
    dependent = (F.col("relationship_to_subscriber") != "self") & text.blank(F.col("subscriber_id"))
    out.add(dependent, "error", "dependent_missing_subscriber_id", "Dependent row is missing subscriber_id.", "subscriber_id")


def _email(out: Issues, asof: Column) -> None:
    raw = text.blank(F.col("raw__email"))
    out.add(raw, "warning", "email_missing", "email is missing.", "email")
    out.add(~raw & F.col("email").isNull(), "warning", "email_invalid", "email format is invalid.", "email")


def _phone(out: Issues, asof: Column) -> None:
    out.add(~text.blank(F.col("raw__phone")) & F.col("phone").isNull(), "warning", "phone_invalid", "phone format is invalid.", "phone")


def _gender(out: Issues, asof: Column) -> None:
    out.add(F.col("gender").isNull(), "warning", "gender_unknown", "gender is missing or unknown.", "gender")


def _plan_type(out: Issues, asof: Column) -> None:
    out.add(F.col("plan_type").isNull(), "warning", "plan_type_unknown", "plan_type is missing or unknown.", "plan_type")


def _terminated(out: Issues, asof: Column) -> None:
    out.add((F.col("coverage_status") == "terminated") & F.col("coverage_end_date").isNull(), "warning", "terminated_missing_coverage_end_date", "coverage_status is terminated but coverage_end_date is blank.", "coverage_end_date")


ROW_PRESETS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "birth_date": (("date_of_birth",), _birth_date),
    "coverage_dates": (("coverage_start_date", "coverage_end_date"), _coverage_dates),
    "dependents": (("relationship_to_subscriber", "subscriber_id"), _dependents),
    "email": (("email",), _email),
    "phone": (("phone",), _phone),
    "gender": (("gender",), _gender),
    "plan_type": (("plan_type",), _plan_type),
    "terminated": (("coverage_status", "coverage_end_date"), _terminated),
}


def row_issues(df: DataFrame, contract: Contract, asof: Column) -> DataFrame:
    """Issues that a row shows by itself: one scan, one generator."""
    out, names = Issues(), contract.by_name
    for f in names.values():
        if not f.generated:
            field_rules(out, f, asof)
    for name in contract.presets:
        if name in ROW_PRESETS and all(f in names for f in ROW_PRESETS[name][0]):
            ROW_PRESETS[name][1](out, asof)
    return df.select("source_row_number", F.inline(F.array_compact(F.array(*out.rows))))


def missing_subscribers(df: DataFrame) -> DataFrame:
    """Rows of dependents whose subscriber is no member of the file; rejected rows count as members."""
    members = df.select(F.col("member_id").alias("_m")).where("_m is not null").distinct()
    asked = df.where((F.col("relationship_to_subscriber") != "self") & F.col("subscriber_id").isNotNull())
    lost = asked.join(members, F.col("subscriber_id") == F.col("_m"), "left_anti")
    return _issue(lost, GROUP_SEQ, "error", "subscriber_id_not_found", F.lit("subscriber_id references no known member in the file."), "subscriber_id")


def _issue(rows: DataFrame, seq: int, severity: str, code: str, message: Column, field: str) -> DataFrame:
    return rows.select("source_row_number", F.lit(seq).alias("issue_seq"), F.lit(severity).alias("severity"), F.lit(code).alias("issue_code"), message.alias("issue_message"), F.lit(field).alias("target_field"))


def _several(df: DataFrame, key: str, of: list[str]) -> DataFrame:
    """Rows whose key stands with more than one combination of the other columns; nulls are values. Least and greatest tell, so each task passes on one row a key."""
    s = F.struct(*of)
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.min(s) != F.max(s)).alias("_several")).where("_several").select(key)
    return df.join(keys, key, "left_semi")


def identity_conflicts(df: DataFrame) -> DataFrame:
    message = F.concat(F.lit("member_id "), F.col("member_id"), F.lit(" appears with conflicting identity values."))
    return _issue(_several(df, "member_id", ["first_name", "last_name", "date_of_birth"]), GROUP_SEQ + 1, "error", "duplicate_member_id_conflicting_identity", message, "member_id")


def duplicate_coverage(df: DataFrame) -> DataFrame:
    """Rows with the same member, plan, start and end; a missing end equals another missing end."""
    keys = ["member_id", "plan_id", "coverage_start_date"]
    full = df.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("_end", F.coalesce(F.col("coverage_end_date").cast("string"), F.lit("")))
    many = full.groupBy(*keys, "_end").count().where("count > 1").drop("count")
    return _issue(full.join(many, [*keys, "_end"], "left_semi"), GROUP_SEQ + 2, "warning", "duplicate_coverage_period", F.lit("Same member appears more than once with the same plan/date range."), "member_id")


def plan_conflicts(df: DataFrame) -> DataFrame:
    message = F.concat(F.lit("plan_id "), F.col("plan_id"), F.lit(" has conflicting plan_name or plan_type values."))
    return _issue(_several(df, "plan_id", ["plan_name", "plan_type"]), GROUP_SEQ + 3, "warning", "plan_id_conflicting_attributes", message, "plan_id")


SET_PRESETS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
    "dependents": (("member_id", "relationship_to_subscriber", "subscriber_id"), missing_subscribers),
    "identity_conflicts": (("member_id", "first_name", "last_name", "date_of_birth"), identity_conflicts),
    "duplicate_coverage": (("member_id", "plan_id", "coverage_start_date", "coverage_end_date"), duplicate_coverage),
    "plan_conflicts": (("plan_id", "plan_name", "plan_type"), plan_conflicts),
}


def with_sources(found: DataFrame, contract: Contract, flat: Flat | None) -> DataFrame:
    sources = {f: flat.field_source(f) for f in contract.by_name} if flat else {}
    return found.withColumn("source_column", F.coalesce(text.lookup(F.col("target_field"), {k: v for k, v in sources.items() if v}), F.lit("")))


def set_presets(contract: Contract) -> list[str]:
    """The contract's rules over groups of rows."""
    names = contract.by_name
    return [name for name in contract.presets if name in SET_PRESETS and all(f in names for f in SET_PRESETS[name][0])]


def own_issues(typed: DataFrame, contract: Contract, flat: Flat | None, asof: Column) -> DataFrame:
    """Issues that each row has by itself: those of the row rules and of failed pipelines."""
    found = with_sources(row_issues(typed, contract, asof), contract, flat).select(*ISSUE)
    if flat is None:
        return found
    if all(f"_p{k}" in typed.columns for k in range(len(flat.mappings))):
        flat = replace(flat, df=typed)  # the pipelines' results are there: the source isn't read again
    return found.unionByName(step_issues(flat).withColumn("issue_seq", F.col("issue_seq") + STEP_SEQ).select(*ISSUE))


def clash_issues(typed: DataFrame, contract: Contract, flat: Flat) -> DataFrame:
    """An error in every row for each field that two tables map to different values in some row."""
    own = replace(flat, df=typed) if all(f"_p{k}" in typed.columns for k in range(len(flat.mappings))) else flat
    clash = typed.select("source_row_number").join(F.broadcast(conflicting_fields(own)), how="cross")  # as many rows as fields at most
    message = F.concat("target_field", F.lit(" has conflicting values from different target tables."))
    clash = clash.select("source_row_number", F.lit(STEP_SEQ + 10_000).alias("issue_seq"), F.lit("error").alias("severity"), F.lit(CLASH).alias("issue_code"), message.alias("issue_message"), "target_field")
    return with_sources(clash, contract, flat).select(*ISSUE)


def validate(typed: DataFrame, contract: Contract, flat: Flat | None = None, asof: Column | None = None, more: DataFrame | None = None) -> DataFrame:
    """The issue table of a normalised frame. flat adds failed pipelines, conflicting fields and source columns; more: issues from elsewhere. asof defaults to today."""
    found = own_issues(typed, contract, flat, F.current_date() if asof is None else asof)
    for name in set_presets(contract):
        found = found.unionByName(with_sources(SET_PRESETS[name][1](typed), contract, flat).select(*ISSUE))
    if flat is not None:
        found = found.unionByName(clash_issues(typed, contract, flat))
    return found if more is None else found.unionByName(more.select(*ISSUE))


# ------------------------------------------------------------------------------------------------- summaries


def summary(issues: DataFrame) -> DataFrame:
    """(severity, issue_code, row_count): rows that have it."""
    return issues.groupBy("severity", "issue_code").agg(F.count_distinct("source_row_number").alias("row_count"))


def by_type(issues: DataFrame, severity: str) -> DataFrame:
    return summary(issues.where(F.col("severity") == severity)).select("issue_code", "row_count").orderBy(F.col("row_count").desc(), "issue_code")


def counts(typed: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: source_count, accepted_count, rejected_count, warning_row_count, reject_rate."""
    bad = issues.agg(F.count_distinct(F.when(F.col("severity") == "error", F.col("source_row_number"))).alias("rejected_count"), F.count_distinct(F.when(F.col("severity") == "warning", F.col("source_row_number"))).alias("warning_row_count"))
    rows = typed.agg(F.count("*").alias("source_count"))
    rate = F.when(F.col("source_count") > 0, F.col("rejected_count") / F.col("source_count")).otherwise(0.0)
    return rows.join(bad, how="cross").select("source_count", (F.col("source_count") - F.col("rejected_count")).alias("accepted_count"), "rejected_count", "warning_row_count", rate.alias("reject_rate"))  # one row each


def error_rows(issues: DataFrame) -> DataFrame:
    return issues.where("severity = 'error'").select("source_row_number").distinct()


#: Row numbers that are broadcast at most, counted before: some 30 MB.
FEW_ROWS = 1_000_000


def accepted(typed: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows without an error. The numbers of the others are written once; where they are few they go to the rows, which then aren't shuffled."""
    bad = kept(error_rows(issues))
    return typed.join(F.broadcast(bad) if bad.count() <= FEW_ROWS else bad, "source_row_number", "left_anti")
