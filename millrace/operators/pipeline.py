"""The transformation catalogue compiled to column expressions.

Each target field's pipeline is a chain of structs (value, failed, operation, message, trace), one projection for each step rank, so
expressions don't nest. A failed step stops the chain. Values travel as text; dates as yyyy-MM-dd.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..plans.contract import Contract
from ..plans.mapping import ConfigurationError, Mapping, Step, check
from .joins import look_up

TRACE = "array<struct<operation:string,input:string,output:string,status:string,message:string>>"


def _null() -> Column:
    return F.lit(None).cast("string")


def _when_filled(v: Column, out: Column) -> Column:
    return F.when(~text.blank(v), out)


def apply(step: Step, v: Column, row: dict[str, Column], columns: tuple[str, ...], target: Column | None = None) -> tuple[Column, Callable[[Column], Column] | None, str]:
    """(value, test of the value for failure or None where it can't fail, message) of one step on the running value v. target: what a crosswalk table has for it."""
    p, op = step.parameters, step.operation
    filled = ~text.blank(v)
    lost = lambda out: filled & out.isNull()
    inputs = [row[c] for c in p.get("source_columns") or columns]
    if op == "trim":
        return text.clean(v), None, ""
    if op == "null_if":
        drop = [str(x).strip().lower() for x in p.get("values") or []]
        return F.when(filled & ~F.lower(text.strip(v)).isin(drop), v) if drop else _when_filled(v, v), None, ""
    if op in ("uppercase", "lowercase", "title_case"):
        return _when_filled(v, {"uppercase": F.upper, "lowercase": F.lower, "title_case": text.title_case}[op](v)), None, ""
    if op == "regex_replace":
        return _when_filled(v, F.regexp_replace(v, F.lit(text.java_pattern(str(p["pattern"]))), F.lit(text.java_replacement(str(p["replacement"]))))), None, ""
    if op == "parse_date":
        given = [dates.spark_format(str(f)) for f in p.get("accepted_formats") or []]
        out = F.date_format(dates.parse(v, given or list(dict.fromkeys([*dates.PIPELINE, *dates.FREE]))), "yyyy-MM-dd")
        return out, lost, "Value does not match an accepted date format." if given else "Value could not be parsed as a date."
    if op == "parse_numeric":
        t = text.strip(v)
        for symbol in p.get("currency_symbols") or ["$", "GBP", "EUR"]:
            t = F.replace(t, F.lit(str(symbol)), F.lit(""))
        if group := str(p.get("grouping_separator", ",")):
            t = F.replace(t, F.lit(group), F.lit(""))
        if (point := str(p.get("decimal_separator", "."))) not in ("", "."):
            t = F.replace(t, F.lit(point), F.lit("."))
        t = text.strip(t)
        out = F.when(filled & t.rlike(text.NUMBER), t)
        return out, lost, "Value could not be parsed as numeric."
    if op == "normalize_phone":
        out = text.phone(v)
        return out, lost, "Phone value does not contain ten digits."
    if op == "normalize_email":
        return F.lower(text.clean(v)), None, ""
    if op == "map_values":
        pairs = {str(k): str(x) for k, x in (p.get("mapping") or {}).items()}
        out = text.lookup(text.strip(v), pairs) if target is None else target
        if target is None and p.get("case_insensitive", True):
            folded: dict[str, str] = {}
            for k, x in pairs.items():
                folded.setdefault(k.strip().lower(), x)
            out = F.coalesce(out, text.lookup(F.lower(text.strip(v)), folded))
        out = _when_filled(v, out)
        if p.get("passthrough_unknown"):
            return _when_filled(v, F.coalesce(out, v)), None, ""
        return out, lost, "Value is not present in the configured crosswalk."
    if op == "default":
        return F.when(filled, v).otherwise(F.lit(p.get("value")).cast("string")), None, ""
    if op == "coalesce":
        return F.coalesce(*[_when_filled(c, c) for c in inputs]) if inputs else _null(), None, ""
    if op == "concatenate":
        joined = F.array_join(F.array_compact(F.array(*[text.clean(c) for c in inputs])), str(p.get("separator", " "))) if inputs else F.lit("")
        if p.get("skip_nulls", True):
            return joined, None, ""
        any_blank = F.lit(False)
        for c in inputs:
            any_blank = any_blank | text.blank(c)
        return F.when(~any_blank, joined), None, ""
    if op == "split":
        parts, k = F.split(v, r"\Q" + str(p["delimiter"]).replace(r"\E", r"\E\\E\Q") + r"\E", -1), int(p.get("part_index", 0))
        out = F.when(filled, text.strip(F.try_element_at(parts, F.lit(k + 1 if k >= 0 else k))))
        return out, lost, "Split value does not contain the requested part."
    if op == "generate_deterministic_id":
        return deterministic_id([row[c] for c in p.get("input_fields") or []], str(p.get("prefix") or "ID"), int(p.get("length", 12)))
    raise ConfigurationError(f"Unsupported transformation operation: {op}.")


def deterministic_id(inputs: list[Column], prefix: str, length: int) -> tuple[Column, Callable[[Column], Column], str]:
    missing = F.lit(False)
    for c in inputs:
        missing = missing | text.blank(c)
    digest = F.upper(F.substring(F.sha2(F.concat_ws("|", *[text.strip(c) for c in inputs]), 256), 1, length))
    return F.when(~missing, F.concat(F.lit(prefix + "-"), digest)), lambda _: missing, "Generated ID input is missing."


def _with_targets(df: DataFrame, rank: int, mappings: list[Mapping], crosswalks: dict[str, DataFrame]) -> DataFrame:
    """df with _x<k> for each mapping whose step of this rank maps values by a table."""
    for k, m in enumerate(mappings):
        name = m.steps[rank].parameters.get("crosswalk") if rank < len(m.steps) and m.steps[rank].operation == "map_values" else None
        if name is not None:
            if name not in crosswalks:
                raise ConfigurationError(f"The crosswalk {name} is missing.")
            running = F.when(~F.col(f"_p{k}")["failed"], text.clean(F.col(f"_p{k}")["v"]))
            df = look_up(df, running, crosswalks[name], bool(m.steps[rank].parameters.get("case_insensitive", True)), f"_x{k}")
    return df


def pipeline_columns(df: DataFrame, mappings: list[Mapping], trace: bool, row: dict[str, str], crosswalks: dict[str, DataFrame] | None = None) -> DataFrame:
    """df with a struct column _p<k> (v, failed, op, msg, trace) for the k-th mapping. row: source column to column of df. crosswalks: tables (source_value, target_value) that map_values names by its parameter crosswalk."""
    cols = {name: F.col(f"`{c}`").cast("string") for name, c in row.items()}
    empty = F.array().cast(TRACE)

    def state(v, failed, op, msg, steps) -> Column:
        return F.struct(v.alias("v"), failed.alias("failed"), op.alias("op"), msg.alias("msg"), steps.alias("trace"))

    df = df.withColumns({f"_p{k}": state(cols[m.columns[0]] if m.columns else _null(), F.lit(False), _null(), _null(), empty) for k, m in enumerate(mappings)})
    for rank in range(max((len(m.steps) for m in mappings), default=0)):
        df = _with_targets(df, rank, mappings, crosswalks or {})
        tried, made = {}, {}  # a step's value is a column of its own, as much hangs off it
        for k, m in enumerate(mappings):
            if rank >= len(m.steps):
                continue
            s, step = F.col(f"_p{k}"), m.steps[rank]
            tried[f"_t{k}"], failed, message = apply(step, s["v"], cols, m.columns, F.col(f"_x{k}") if f"_x{k}" in df.columns else None)
            value = F.col(f"_t{k}")
            fallback = {"warning_keep_original": s["v"], "use_default": F.lit(m.default).cast("string")}.get(m.policy, _null())
            if failed is None:
                after, bad = value, F.lit(False)
            else:
                bad = F.coalesce(failed(value), F.lit(False))
                after = F.when(bad, fallback).otherwise(value)
            note = F.struct(F.lit(step.operation).alias("operation"), s["v"].alias("input"), after.alias("output"), F.when(bad, "failed").otherwise("applied").alias("status"), F.when(bad, message).otherwise("").alias("message"))
            steps = F.concat(s["trace"], F.array(note)) if trace else empty
            made[f"_p{k}"] = F.when(s["failed"], s).otherwise(state(after, bad, F.when(bad, step.operation), F.when(bad, message), steps))
        df = df.withColumns(tried).withColumns(made).drop(*tried, *[f"_x{k}" for k in range(len(mappings))])
    return df


@dataclass(frozen=True)
class Flat:
    """The canonical flat frame: source_row_number, one text column for each logical field, a struct _p<k> for each mapping, and source columns as src__<name>."""

    df: DataFrame
    mappings: list[Mapping]
    contract: Contract
    columns: list[str]

    def field_source(self, field: str) -> str:
        """The source columns of a logical field; the last mapping that names it counts."""
        return next((m.source for m in reversed(self.mappings) if m.field == field), "")


def approved(mappings: list[Mapping]) -> list[Mapping]:
    return [m for m in mappings if m.approved and (m.columns or m.steps)]


def build_flat(source: DataFrame, mappings: list[Mapping], contract: Contract, trace: bool = False, crosswalks: dict[str, DataFrame] | None = None) -> Flat:
    """Source rows projected to the contract's logical fields. source: text columns and source_row_number. crosswalks: tables for steps that map values, by name.

    Faulty pipelines raise before a plan is made. A field two tables map to different values is settled by conflicting_fields().
    """
    used = approved(mappings)
    fields = {(f.table, f.name): f for f in contract.fields}
    columns = [c for c in source.columns if c != "source_row_number"]
    # A mapping of a generated field only matters when it generates.
    used = [m for m in used if (m.table, m.field) in fields]
    faults = [f"{m.table}.{m.field}: {e}" for m in used for e in check(m, fields[m.table, m.field], columns)]
    if faults:
        raise ConfigurationError("\n".join(faults))
    df = source.select("source_row_number", *[F.col(f"`{c}`").cast("string").alias(f"src__{c}") for c in columns])
    df = pipeline_columns(df, used, trace, {c: f"src__{c}" for c in columns}, crosswalks)
    first: dict[str, int] = {}
    for k, m in enumerate(used):
        first.setdefault(m.field, k)
    out = df.withColumns({f: F.col(f"_p{k}")["v"] for f, k in first.items()}) if first else df
    return Flat(out, used, contract, columns)


def conflicting_fields(flat: Flat) -> DataFrame:
    """(target_field): logical fields that two tables map to values that differ in some row. One aggregate over one scan."""
    by: dict[str, list[int]] = {}
    for k, m in enumerate(flat.mappings):
        by.setdefault(m.field, []).append(k)
    twice = {f: ks for f, ks in by.items() if len(ks) > 1}
    spark = flat.df.sparkSession
    if not twice:
        return spark.createDataFrame([], "target_field string")
    differ = [F.array(*[F.max(~F.col(f"_p{ks[0]}")["v"].eqNullSafe(F.col(f"_p{k}")["v"])) for k in ks[1:]]).alias(f) for f, ks in twice.items()]
    flags = flat.df.agg(*differ).select(F.array(*[F.when(F.array_contains(F.col(f), True), F.lit(f)) for f in twice]).alias("f"))
    return flags.select(F.explode(F.array_compact("f")).alias("target_field"))


def step_issues(flat: Flat) -> DataFrame:
    """One row for each failed pipeline: source_row_number, severity, issue_code, issue_message, target_field, source_column."""
    spark = flat.df.sparkSession
    rows = []
    for k, m in enumerate(flat.mappings):
        if m.steps:
            s = F.col(f"_p{k}")
            severity = "error" if m.policy == "error" else "warning"
            code = F.concat(F.lit("transformation_"), s["op"], F.lit("_failed"))
            message = F.concat(F.lit(f"{m.field} transformation "), s["op"], F.lit(" failed: "), s["msg"])
            rows.append(F.when(s["failed"], F.struct(F.lit(k).alias("issue_seq"), F.lit(severity).alias("severity"), code.alias("issue_code"), message.alias("issue_message"), F.lit(m.field).alias("target_field"), F.lit(m.source).alias("source_column"))))
    if not rows:
        return spark.createDataFrame([], "source_row_number long, issue_seq int, severity string, issue_code string, issue_message string, target_field string, source_column string")
    return flat.df.select("source_row_number", F.inline(F.array_compact(F.array(*rows))))


def preview(source: DataFrame, mapping: Mapping, contract: Contract, limit: int = 10) -> DataFrame:
    """source_row_number, final_value, status, message, transformation_trace of the first rows."""
    flat = build_flat(source.orderBy("source_row_number").limit(limit), [mapping], contract, trace=True)
    s = F.col("_p0")
    return flat.df.select("source_row_number", s["v"].alias("final_value"), F.when(s["failed"], "failed").otherwise("ready").alias("status"), F.coalesce(s["msg"], F.lit("")).alias("message"), F.to_json(s["trace"]).alias("transformation_trace")).orderBy("source_row_number")
