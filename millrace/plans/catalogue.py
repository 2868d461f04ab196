"""Named queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import corrections, normalize, outputs, pipeline, profile, reconcile, revalidate, rules, sketches
from ..sources import ingest
from ..sources.checkpoint import cut, kept, scratch_path
from ..sources.store import KINDS, ReconciliationError, Store
from .contract import CROSSWALKS, Field, Table
from .fixtures import COLUMNS, CONTRACT, ELIG_SQL, LINE_ORDER, ORDER_BOOK_SQL, PAIRS, STEPS, book_mappings, elig, identity_mappings, order_book, order_book_contract, table
from .mapping import Mapping, Step, suggest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2026-01-01"
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _asof():
    return F.lit(AS_OF).cast("date")



def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ------------------------------------------------------------------------------------------------- SQL pieces


def _case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _token(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[-_/.]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _date(c: str) -> str:
    formats = "['%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d', '%m-%d-%Y', '%d-%b-%Y', '%Y%m%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M:%S.%f']"
    return f"CAST(try_strptime(trim({c}), {formats}) AS DATE)"


def _clean(c: str) -> str:
    return f"nullif(trim({c}), '')"


_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
_TEN = f"CASE WHEN length({_DIGITS}) = 11 AND starts_with({_DIGITS}, '1') THEN substr({_DIGITS}, 2) ELSE {_DIGITS} END"
_PHONE = f"CASE WHEN length({_TEN}) = 10 THEN substr({_TEN}, 1, 3) || '-' || substr({_TEN}, 4, 3) || '-' || substr({_TEN}, 7, 4) END"
_EMAIL = "CASE WHEN regexp_matches(lower(trim(email_address)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN lower(trim(email_address)) END"
TYPED = {
    "member_id": _clean("member_number"), "first_name": _clean('"first"'), "last_name": _clean('"last"'), "date_of_birth": _date("dob"), "gender": _case(_token("sex"), CROSSWALKS["gender"]), "email": _EMAIL, "phone": _PHONE,
    "plan_id": _clean("plan_code"), "plan_name": _clean("plan_name"), "plan_type": _case(_token("plan_type"), CROSSWALKS["plan_type"]), "carrier_name": _clean("carrier"), "coverage_start_date": _date("effective_date"), "coverage_end_date": _date("term_date"),
    "coverage_status": _case(_token("status"), CROSSWALKS["coverage_status"]), "relationship_to_subscriber": _case(_token("relation"), CROSSWALKS["relationship_to_subscriber"]), "subscriber_id": _clean("subscriber_id"),
}
N = f"WITH e AS ({ELIG_SQL}), n AS (SELECT source_row_number, {', '.join(f'{x} AS {c}' for c, x in TYPED.items())}, email_address AS raw_email, phone AS raw_phone, term_date AS raw_end, carrier AS raw_carrier, subscriber_id AS raw_subscriber FROM e)"


def _rule(when: str, severity: str, code: str, field: str, message: str, seq: int, rows: str = "n") -> str:
    return f"SELECT source_row_number, {seq} AS issue_seq, '{severity}' AS severity, '{code}' AS issue_code, {message} AS issue_message, '{field}' AS target_field FROM {rows} WHERE {when}"


def _lit(s: str) -> str:
    return f"'{s}'"


def _issues_sql() -> str:
    out, k = [], 0

    def add(when: str, severity: str, code: str, field: str, message: str) -> None:
        nonlocal k
        out.append(_rule(when, severity, code, field, _lit(message), k))
        k += 1

    raws = {"carrier_name": "raw_carrier", "coverage_end_date": "raw_end", "subscriber_id": "raw_subscriber"}
    for f in CONTRACT.by_name.values():
        if f.generated:
            continue
        if f.required:
            add(f"{f.name} IS NULL", "error", f"{f.name}_missing_or_invalid", f.name, f"{f.name} is missing or invalid.")
        elif f.name in raws:
            add(f"trim({raws[f.name]}) <> '' AND {f.name} IS NULL", "error", f"{f.name}_invalid_{f.data_type}", f.name, f"{f.name} could not be normalized as {f.data_type}.")
    asof = "DATE '2026-01-01'"
    add(f"date_of_birth > {asof}", "error", "date_of_birth_future", "date_of_birth", "date_of_birth is in the future.")
    add(f"date_of_birth <= {asof} AND date_of_birth + INTERVAL 121 YEAR <= {asof}", "error", "date_of_birth_age_out_of_range", "date_of_birth", "Member age is outside the supported 0-120 range.")
    add("coverage_end_date < coverage_start_date", "error", "coverage_end_before_start", "coverage_end_date", "coverage_end_date is before coverage_start_date.")
    add("relationship_to_subscriber <> 'self' AND subscriber_id IS NULL", "error", "dependent_missing_subscriber_id", "subscriber_id", "Dependent row is missing subscriber_id.")
    add("trim(raw_email) = ''", "warning", "email_missing", "email", "email is missing.")
    add("trim(raw_email) <> '' AND email IS NULL", "warning", "email_invalid", "email", "email format is invalid.")
    add("trim(raw_phone) <> '' AND phone IS NULL", "warning", "phone_invalid", "phone", "phone format is invalid.")
    add("gender IS NULL", "warning", "gender_unknown", "gender", "gender is missing or unknown.")
    add("plan_type IS NULL", "warning", "plan_type_unknown", "plan_type", "plan_type is missing or unknown.")
    add("coverage_status = 'terminated' AND coverage_end_date IS NULL", "warning", "terminated_missing_coverage_end_date", "coverage_end_date", "coverage_status is terminated but coverage_end_date is blank.")
    g = 100_000
    out.append(_rule("relationship_to_subscriber <> 'self' AND subscriber_id IS NOT NULL AND subscriber_id NOT IN (SELECT member_id FROM n WHERE member_id IS NOT NULL)", "error", "subscriber_id_not_found", "subscriber_id", _lit("subscriber_id references no known member in the file."), g))
    several = "{k} IN (SELECT {k} FROM (SELECT DISTINCT {k}, {of} FROM n WHERE {k} IS NOT NULL) GROUP BY {k} HAVING count(*) > 1)"
    out.append(_rule(several.format(k="member_id", of="first_name, last_name, date_of_birth"), "error", "duplicate_member_id_conflicting_identity", "member_id", "'member_id ' || member_id || ' appears with conflicting identity values.'", g + 1))
    dup = "(SELECT *, count(*) OVER (PARTITION BY member_id, plan_id, coverage_start_date, coverage_end_date) AS q FROM n WHERE member_id IS NOT NULL AND plan_id IS NOT NULL AND coverage_start_date IS NOT NULL)"
    out.append(_rule("q > 1", "warning", "duplicate_coverage_period", "member_id", _lit("Same member appears more than once with the same plan/date range."), g + 2, dup))
    out.append(_rule(several.format(k="plan_id", of="plan_name, plan_type"), "warning", "plan_id_conflicting_attributes", "plan_id", "'plan_id ' || plan_id || ' has conflicting plan_name or plan_type values.'", g + 3))
    return " UNION ALL ".join(out)


_SOURCES = {f: c for _, f, c in PAIRS}
I = f"{N}, i0 AS ({_issues_sql()}), i AS (SELECT i0.*, coalesce({_case('target_field', _SOURCES)}, '') AS source_column FROM i0), bad AS (SELECT DISTINCT source_row_number FROM i WHERE severity = 'error'), acc AS (SELECT n.* FROM n WHERE source_row_number NOT IN (SELECT source_row_number FROM bad))"  # noqa: E741


# ------------------------------------------------------------------------------------------------- shared frames


class Run:
    """The frames of one import of the eligibility view. The typed frame is written once; rules, tables, rejects and lineage hang off it."""

    def __init__(self, spark: SparkSession, sf_dir: str, trace: bool = False):
        self.source = elig(spark, sf_dir)
        self.flat = pipeline.build_flat(self.source, identity_mappings(), CONTRACT, trace)
        self.typed = normalize.written(self.flat, CONTRACT)
        self.issues = kept(rules.validate(self.typed, CONTRACT, self.flat, _asof()))  # tables, rejects, checks and lineage all read them

    def merged(self, name: str) -> DataFrame:
        return outputs.tables(self.typed, self.issues, CONTRACT, [name])[name]


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[(F.date_format(c, "yyyy-MM-dd") if k == "date" else F.col(c)).alias(c) for c, k in df.dtypes])


# ------------------------------------------------------------------------------------------------- flat and typed


@query(f"SELECT source_row_number, {_clean('member_number')} AS member_id, upper({_clean(chr(34) + 'first' + chr(34))}) AS first_name, strftime({_date('dob')}, '%Y-%m-%d') AS date_of_birth, lower({_clean('email_address')}) AS email, {_PHONE} AS phone FROM ({ELIG_SQL})")
def elig_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped projection with pipelines: trim, case, date, phone, e-mail."""
    flat = pipeline.build_flat(elig(spark, sf_dir), identity_mappings(STEPS | {"member_id": [Step("trim", {})]}), CONTRACT)
    return flat.df.select("source_row_number", "member_id", "first_name", "date_of_birth", "email", "phone")


@query(f"{N} SELECT source_row_number, {', '.join(f'strftime({c}, {chr(39)}%Y-%m-%d{chr(39)}) AS {c}' if CONTRACT.by_name[c].data_type == 'date' else c for c in TYPED)} FROM n")
def elig_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = pipeline.build_flat(elig(spark, sf_dir), identity_mappings(), CONTRACT)
    return _text(normalize.normalize(flat.df, CONTRACT).select("source_row_number", *TYPED))


def _clashing() -> list[Mapping]:
    """member_id mapped to two sources."""
    return [m if (m.table, m.field) != ("member_coverage", "member_id") else Mapping("member_coverage", "member_id", ("subscriber_id",)) for m in identity_mappings()]


@query("SELECT 'clashing' AS mappings, 'member_id' AS target_field")
def elig_conflicting_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that two tables map to different values: none of the identity mappings, one where member_id has two sources."""
    source = elig(spark, sf_dir)
    found = [pipeline.conflicting_fields(pipeline.build_flat(source, m, CONTRACT)).select(F.lit(n).alias("mappings"), "target_field") for n, m in (("identity", identity_mappings()), ("clashing", _clashing()))]
    return found[0].unionByName(found[1])


@query(f"SELECT CAST(count(*) AS BIGINT) AS row_count FROM ({ELIG_SQL})")
def elig_clashing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member_id mapped to two sources: an error on every row."""
    flat = pipeline.build_flat(elig(spark, sf_dir), _clashing(), CONTRACT)
    found = rules.validate(normalize.normalize(flat.df, CONTRACT), CONTRACT, flat, _asof())
    return found.where("issue_code = 'conflicting_duplicate_target_field'").agg(F.count("*").alias("row_count"))


# ------------------------------------------------------------------------------------------------- operations


def _operation(name: str, src: str, columns: dict[str, str], steps: list[Step], sql: str, inputs: tuple[str, ...] = ("v",), **more) -> None:
    """A query of one pipeline over a driver table, and its SQL: key, value, status."""
    key = {"customer": "c_custkey", "part": "p_partkey", "events": "event_id", "orders": "o_orderkey"}[src]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, src).select(F.col(key).alias("key"), *[F.expr(e).cast("string").alias(n) for n, e in columns.items()])
        out = pipeline.pipeline_columns(df, [Mapping("t", "f", inputs, tuple(steps), **more)], False, {c: c for c in columns})
        return out.select("key", F.col("_p0.v").alias("value"), F.when(F.col("_p0.failed"), "failed").otherwise("ready").alias("status"))

    inner = f"SELECT {key} AS key, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {src}"
    query(f"SELECT key, value, status FROM (SELECT key, {sql} FROM ({inner}))", name)(run)


_NAME = {"v": "CASE WHEN c_custkey % 11 = 0 THEN '   ' WHEN c_custkey % 13 = 0 THEN NULL ELSE '  ' || c_name || ' x' || CAST(c_custkey % 7 AS STRING) || ' ' END"}
_OK = "'ready' AS status"
_FILLED = "nullif(trim(v), '') IS NOT NULL"
_operation("op_trim", "customer", _NAME, [Step("trim", {})], f"nullif(trim(v), '') AS value, {_OK}")
_operation("op_null_if", "customer", {"v": "c_mktsegment"}, [Step("null_if", {"values": ["building", " Machinery "]})], f"CASE WHEN lower(v) NOT IN ('building', 'machinery') THEN v END AS value, {_OK}")
_operation("op_case", "customer", _NAME, [Step("trim", {}), Step("uppercase", {}), Step("lowercase", {})], f"lower(nullif(trim(v), '')) AS value, {_OK}")
_operation("op_title_case", "customer", {"v": "'o''neil mc-donald ' || lower(c_mktsegment)"}, [Step("title_case", {})], f"'O''Neil Mc-Donald ' || upper(substr(v, 18, 1)) || substr(v, 19) AS value, {_OK}")
_operation("op_regex_replace", "customer", {"v": "replace(c_name, 'Customer', 'Çüstömer ' || c_mktsegment || ' é')"}, [Step("regex_replace", {"pattern": r"(\w+)#0*(\d+)", "replacement": r"\2-\1"})], f"regexp_replace(v, '([\\p{{L}}\\p{{N}}_]+)#0*(\\d+)', '\\2-\\1', 'g') AS value, {_OK}")
_DATES = {"v": "CASE WHEN o_orderkey % 5 = 0 THEN 'not-a-date' WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderkey % 5 = 2 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"}
_VD = f"strftime({_date('v')}, '%Y-%m-%d')"
_FD = f"CASE WHEN {_FILLED} AND {_date('v')} IS NULL THEN 'failed' ELSE 'ready' END AS status"
_PD = [Step("parse_date", {"accepted_formats": []})]
_operation("op_parse_date", "orders", _DATES, _PD, f"{_VD} AS value, {_FD}")
_operation("op_parse_date_formats", "orders", _DATES, [Step("parse_date", {"accepted_formats": ["%m/%d/%Y"]})], "strftime(try_strptime(v, '%m/%d/%Y'), '%Y-%m-%d') AS value, CASE WHEN v <> '' AND try_strptime(v, '%m/%d/%Y') IS NULL THEN 'failed' ELSE 'ready' END AS status")
_operation("policy_error", "orders", _DATES, [*_PD, Step("default", {"value": "x"})], f"CASE WHEN {_FILLED} AND {_date('v')} IS NULL THEN NULL ELSE coalesce({_VD}, 'x') END AS value, {_FD}", policy="error")
_operation("policy_set_null", "orders", _DATES, _PD, f"{_VD} AS value, {_FD}", policy="warning_set_null")
_operation("policy_keep_original", "orders", _DATES, [Step("trim", {}), *_PD], f"CASE WHEN {_FILLED} THEN coalesce({_VD}, v) END AS value, {_FD}", policy="warning_keep_original")
_operation("policy_default", "orders", _DATES, _PD, f"CASE WHEN {_FILLED} THEN coalesce({_VD}, '1900-01-01') END AS value, {_FD}", policy="use_default", default="1900-01-01")
_operation("op_parse_numeric", "customer", {"v": "CASE WHEN c_custkey % 4 = 0 THEN 'n/a' WHEN c_custkey % 4 = 1 THEN ' $1,' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '.50 ' ELSE 'EUR ' || CAST(c_custkey AS STRING) END"}, [Step("parse_numeric", {})], "nullif(trim(replace(replace(replace(v, '$', ''), 'EUR', ''), ',', '')), 'n/a') AS value, CASE WHEN v = 'n/a' THEN 'failed' ELSE 'ready' END AS status")
_PH = {"v": "CASE c_custkey % 4 WHEN 0 THEN '(555) 010-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 1 THEN '1-555-010-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 2 THEN '12345' ELSE ' ' END"}
_operation("op_phone", "customer", _PH, [Step("normalize_phone", {})], "CASE WHEN key % 4 < 2 THEN '555-010-' || lpad(CAST(key % 10000 AS STRING), 4, '0') END AS value, CASE WHEN key % 4 = 2 THEN 'failed' ELSE 'ready' END AS status")
_operation("op_email", "customer", {"v": "' User' || CAST(c_custkey AS STRING) || '@Example.COM '"}, [Step("normalize_email", {})], f"lower(trim(v)) AS value, {_OK}")
_MAP = {"BUILDING": "B", "machinery": "M", "AUTOMOBILE": "A"}
_MAPPED = "CASE v WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' WHEN 'AUTOMOBILE' THEN 'A' END"
_operation("op_map_values", "customer", {"v": "c_mktsegment"}, [Step("map_values", {"mapping": _MAP})], f"{_MAPPED} AS value, CASE WHEN {_MAPPED} IS NULL THEN 'failed' ELSE 'ready' END AS status")
_operation("op_map_values_passthrough", "customer", {"v": "c_mktsegment"}, [Step("map_values", {"mapping": _MAP, "passthrough_unknown": True})], f"coalesce({_MAPPED}, v) AS value, {_OK}")
_operation("op_default", "customer", _NAME, [Step("default", {"value": "nobody"})], f"CASE WHEN {_FILLED} THEN v ELSE 'nobody' END AS value, {_OK}")
_TWO = {"v": "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END", "w": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE ' ' || c_mktsegment END"}
_operation("op_coalesce", "customer", _TWO, [Step("coalesce", {"source_columns": ["v", "w"]})], f"CASE WHEN trim(v) <> '' THEN v WHEN trim(w) <> '' THEN w END AS value, {_OK}", ("v", "w"))
_operation("op_concatenate", "customer", _TWO, [Step("concatenate", {"separator": "-"})], f"concat_ws('-', nullif(trim(v), ''), nullif(trim(w), '')) AS value, {_OK}", ("v", "w"))
_operation("op_concatenate_strict", "customer", _TWO, [Step("concatenate", {"skip_nulls": False})], f"CASE WHEN trim(v) <> '' AND trim(w) <> '' THEN trim(v) || ' ' || trim(w) END AS value, {_OK}", ("v", "w"))
_operation("op_split", "part", {"v": "p_type"}, [Step("split", {"delimiter": " ", "part_index": -1})], f"trim(string_split(v, ' ')[-1]) AS value, {_OK}")
_operation("op_split_missing", "customer", {"v": "c_name"}, [Step("split", {"delimiter": "#0000000", "part_index": 1})], "nullif(string_split(v, '#0000000')[2], '') AS value, CASE WHEN len(string_split(v, '#0000000')) < 2 THEN 'failed' ELSE 'ready' END AS status")
_operation("op_deterministic_id", "customer", _TWO, [Step("generate_deterministic_id", {"input_fields": ["v", "w"], "prefix": "CU", "length": 10})], "CASE WHEN trim(v) <> '' AND trim(w) <> '' THEN 'CU-' || upper(substr(sha256(trim(v) || '|' || trim(w)), 1, 10)) END AS value, CASE WHEN trim(v) <> '' AND trim(w) <> '' THEN 'ready' ELSE 'failed' END AS status", ("v", "w"))


_CUST = "CASE WHEN o_orderkey % 17 = 0 THEN '  ' WHEN o_orderkey % 3 = 0 THEN ' CUST-' || CAST(o_custkey AS STRING) || ' ' WHEN o_orderkey % 5 = 0 THEN 'Cust-1' ELSE 'Cust-' || CAST(o_custkey AS STRING) END"


@query(f"WITH o AS (SELECT o_orderkey AS key, {_CUST} AS v FROM orders), w AS (SELECT 'Cust-' || CAST(c_custkey AS STRING) AS k, c_name AS t FROM customer WHERE c_custkey % 10 <> 0) SELECT key, t AS value, CASE WHEN trim(v) = '' OR t IS NOT NULL THEN 'ready' ELSE 'failed' END AS status, CASE WHEN trim(v) <> '' AND t IS NULL THEN 'Value is not present in the configured crosswalk.' END AS message FROM o LEFT JOIN w ON lower(trim(v)) = lower(k)")
def op_map_values_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values mapped by a crosswalk of one row a customer, equal ones first, then without case; one value is in a fifth of all rows."""
    walk = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.concat(F.lit("Cust-"), F.col("c_custkey").cast("string")).alias("source_value"), F.col("c_name").alias("target_value"))
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.expr(_CUST).alias("v"))
    out = pipeline.pipeline_columns(df, [Mapping("t", "f", ("v",), (Step("map_values", {"crosswalk": "customers"}),))], False, {"v": "v"}, {"customers": walk})
    return out.select("key", F.col("_p0.v").alias("value"), F.when(F.col("_p0.failed"), "failed").otherwise("ready").alias("status"), F.col("_p0.msg").alias("message"))


@query("WITH o AS (SELECT o_orderkey AS k, " + _DATES["v"] + " AS v FROM orders) SELECT k AS key, 'trim:applied,parse_date:' || CASE WHEN nullif(trim(v), '') IS NOT NULL AND " + _date("v") + " IS NULL THEN 'failed' ELSE 'applied,default:applied' END AS steps FROM o")
def pipeline_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations and states of a traced pipeline; a failed step ends it."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.expr(_DATES["v"]).alias("v"))
    out = pipeline.pipeline_columns(df, [Mapping("t", "f", ("v",), (Step("trim", {}), *_PD, Step("default", {"value": "x"})))], True, {"v": "v"})
    return out.select("key", F.array_join(F.transform("_p0.trace", lambda t: F.concat(t["operation"], F.lit(":"), t["status"])), ",").alias("steps"))


# ------------------------------------------------------------------------------------------------- issues


@query(f"{I} SELECT source_row_number, severity, issue_code, issue_message, target_field, source_column FROM i")
def elig_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Run(spark, sf_dir).issues.drop("issue_seq")


def _code(name: str, code: str) -> None:
    @query(f"{I} SELECT source_row_number, issue_message FROM i WHERE issue_code = '{code}'", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Run(spark, sf_dir).issues.where(F.col("issue_code") == code).select("source_row_number", "issue_message")


_code("elig_identity_conflicts", "duplicate_member_id_conflicting_identity")
_code("elig_duplicate_coverage", "duplicate_coverage_period")
_code("elig_plan_conflicts", "plan_id_conflicting_attributes")
_code("elig_subscriber_missing", "subscriber_id_not_found")
_code("elig_birth_date_future", "date_of_birth_future")


@query(f"{I} SELECT severity, issue_code, count(DISTINCT source_row_number) AS row_count FROM i GROUP BY ALL")
def elig_issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.summary(Run(spark, sf_dir).issues)


@query(f"{I} SELECT issue_code, count(DISTINCT source_row_number) AS row_count FROM i WHERE severity = 'warning' GROUP BY ALL")
def elig_issues_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.by_type(Run(spark, sf_dir).issues, "warning")


@query(f"{I} SELECT s AS source_count, s - r AS accepted_count, r AS rejected_count, w AS warning_row_count, round(r / s, 6) AS reject_rate FROM (SELECT (SELECT count(*) FROM n) AS s, (SELECT count(*) FROM bad) AS r, (SELECT count(DISTINCT source_row_number) FROM i WHERE severity = 'warning') AS w)")
def elig_accept_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir)
    return rules.counts(r.typed, r.issues).withColumn("reject_rate", F.round("reject_rate", 6))


@query(f"WITH e AS ({ELIG_SQL}) SELECT source_row_number, 'error' AS severity, 'transformation_parse_date_failed' AS issue_code, 'date_of_birth transformation parse_date failed: Value could not be parsed as a date.' AS issue_message FROM e WHERE {_date('dob')} IS NULL")
def elig_step_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = pipeline.build_flat(elig(spark, sf_dir), identity_mappings({"date_of_birth": _PD}), CONTRACT)
    return pipeline.step_issues(flat).select("source_row_number", "severity", "issue_code", "issue_message")


# ------------------------------------------------------------------------------------------------- outputs


def _first(c: str) -> str:
    return f"arg_min({c}, source_row_number) FILTER ({c} IS NOT NULL) AS {c}"


_COV = "'COV-' || upper(substr(sha256(coalesce(member_id, '') || '|' || coalesce(plan_id, '') || '|' || coalesce(strftime(coverage_start_date, '%Y-%m-%d'), '')), 1, 12))"


def _table_sql(name: str) -> str:
    t = CONTRACT.table(name)
    key = t.business_key[0]
    names = [f.name for f in t.fields]
    day = lambda f, c: f"strftime({c}, '%Y-%m-%d')" if f.data_type == "date" else c
    cols = ", ".join(f"{key}" if n == key else _first(n) for n in names)
    return f"{I}, c AS (SELECT *, {_COV} AS coverage_id FROM acc), m AS (SELECT {cols} FROM c GROUP BY {key}) SELECT {', '.join(f'{day(f, f.name)} AS {f.name}' for f in t.fields)} FROM m"


def _output(name: str, of: str) -> None:
    @query(_table_sql(of), name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _text(outputs.output(Run(spark, sf_dir).merged(of), CONTRACT.table(of)))


_output("elig_members", "members")
_output("elig_plans", "plans")
_output("elig_coverage", "member_coverage")


def _stats_sql() -> str:
    parts = []
    for t in CONTRACT.tables:
        key, rest = t.business_key[0], [f.name for f in t.fields if f.name not in t.business_key]
        lacking = " OR ".join(f"{f.name} IS NULL" for f in t.fields if f.required)
        differ = " OR ".join(f"count(DISTINCT {c}) > 1" for c in rest)
        parts.append(f"SELECT '{t.name}' AS target_table, CAST(sum(r) AS BIGINT) AS candidate_count, count(*) AS unique_business_key_count, CAST(coalesce(sum(r - 1) FILTER (NOT x), 0) AS BIGINT) AS exact_duplicate_count, CAST(coalesce(sum(r) FILTER (x AND r > 1), 0) AS BIGINT) AS conflicting_duplicate_count, CAST(sum(z) AS BIGINT) AS missing_output_count FROM (SELECT {key}, count(*) AS r, ({differ}) AS x, count(*) FILTER ({lacking}) AS z FROM c GROUP BY {key})")
    return f"{I}, c AS (SELECT *, {_COV} AS coverage_id FROM acc) " + " UNION ALL ".join(parts)


@query(_stats_sql())
def elig_table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir)
    made = outputs.facts(r.typed, r.issues, CONTRACT)
    parts = [outputs.table_stats(made[t.name], t) for t in CONTRACT.tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _agg(severity: str, key: str) -> str:
    return f"coalesce((SELECT string_agg(v, '; ' ORDER BY q) FROM (SELECT {key} AS v, min(issue_seq) AS q FROM i WHERE i.source_row_number = bad.source_row_number AND severity = '{severity}' AND {key} <> '' GROUP BY {key})), '')"


_REJ = ", ".join(f"(SELECT count(*) FROM i WHERE i.source_row_number = bad.source_row_number AND severity = '{s}') AS {s}_count, {_agg(s, 'issue_code')} AS {s}_codes, {_agg(s, 'target_field')} AS {s}_target_fields, {_agg(s, 'source_column')} AS {s}_source_columns, {_agg(s, 'issue_message')} AS {s}s" for s in ("error", "warning"))


@query(f"{I} SELECT source_row_number, 'rejected' AS row_status, {_REJ}, {', '.join(f'e.{chr(34)}{c}{chr(34)} AS original__{c}' for c in COLUMNS)} FROM bad JOIN e USING (source_row_number)")
def elig_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir)
    return outputs.rejected_rows(r.source, r.issues)


_RID = "'SRC-' || upper(substr(sha256('demo:' || source_row_number), 1, 20))"


@query(f"{I} SELECT {_RID} AS source_record_id, source_row_number, dob AS original__dob, dob AS corrected__dob, '' AS correction_comment FROM bad JOIN e USING (source_row_number)")
def elig_correction_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir)
    queue = corrections.work_queue(outputs.rejected_rows(r.source, r.issues), r.source, "demo")
    return queue.select("source_record_id", "source_row_number", "original__dob", "corrected__dob", "correction_comment")


def _lineage_sql(columns: str) -> str:
    names = CONTRACT.by_name
    parts = []
    for f in CONTRACT.fields:
        value = f"CASE WHEN b.source_row_number IS NULL THEN {_COV} END" if f.generated else f"strftime({f.name}, '%Y-%m-%d')" if names[f.name].data_type == "date" else f.name
        src = _SOURCES.get(f.name, "") if not f.generated else ""
        parts.append(f"SELECT n.source_row_number, '{f.table}' AS target_table, '{f.name}' AS target_field, '{src}' AS source_column, {value} AS final_value, CASE WHEN b.source_row_number IS NULL THEN 'accepted' ELSE 'rejected' END AS row_status FROM n LEFT JOIN bad b USING (source_row_number)")
    rolled = "r AS (SELECT source_row_number, target_field, max(severity = 'error') AS err, max(severity = 'warning') AS warn FROM i GROUP BY ALL)"
    return f"{I}, l AS ({' UNION ALL '.join(parts)}), {rolled}, x AS (SELECT l.*, {_RID.replace('source_row_number', 'l.source_row_number')} AS source_record_id, CASE WHEN err THEN 'error' WHEN warn THEN 'warning' WHEN row_status = 'rejected' THEN 'not_published_row_rejected' ELSE 'accepted' END AS lineage_status FROM l LEFT JOIN r USING (source_row_number, target_field)) SELECT {columns}"


@query(_lineage_sql("source_row_number, source_record_id, row_status, lineage_status, target_table, target_field, source_column, final_value FROM x"))
def elig_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir, trace=True)
    return outputs.lineage(r.flat, r.typed, r.issues, "demo").select("source_row_number", "source_record_id", "row_status", "lineage_status", "target_table", "target_field", "source_column", "final_value")


_CORRECTED = """CASE WHEN source_column = 'dob' AND source_row_number IN (SELECT source_row_number FROM e WHERE dob = '1979-02-30') THEN '{"dob":"1979-02-28"}' ELSE '{}' END AS corrected_values_json"""


@query(_lineage_sql(f"source_row_number, source_record_id, target_table, target_field, lineage_status, final_value, {_CORRECTED} FROM x"))
def elig_lineage_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage with corrections of birth dates, stored in the order of its records and read back."""
    r, store = Run(spark, sf_dir, trace=True), Store(spark, scratch_path(spark, "lineage"))
    fixed = r.source.where("dob = '1979-02-30'").select("source_row_number", F.lit("dob").alias("source_column"), F.lit("1979-02-28").alias("corrected_value"))
    store.append("lineage", outputs.lineage_parts(r.flat, r.typed, r.issues, "demo", fixed), 1)
    return store.audit("lineage", 1).select("source_row_number", "source_record_id", "target_table", "target_field", "lineage_status", "final_value", "corrected_values_json")


@query(_lineage_sql("target_table, target_field, lineage_status, count(*) AS row_count FROM x GROUP BY ALL"))
def elig_lineage_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir)
    return outputs.lineage(r.flat, r.typed, r.issues, "demo").groupBy("target_table", "target_field", "lineage_status").agg(F.count("*").alias("row_count"))


# ------------------------------------------------------------------------------------------------- natural conflicts

_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
_LINES = Table("lines", tuple(Field("lines", c, "text" if c == "l_returnflag" else "numeric", "", c in ("l_orderkey", "l_linenumber"), c not in ("l_orderkey", "l_linenumber")) for c in ["l_orderkey", "l_linenumber", *_LINE]), ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, numbered by a total order of its columns."""
    return cut(ingest.ordered_rows(ingest.spread(table(spark, sf_dir, "lineitem").select(*LINE_ORDER)), LINE_ORDER))


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'arg_min({c}, o) AS {c}' for c in _LINE)} FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS o FROM lineitem) GROUP BY ALL")
def lineitem_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.output(outputs.coalesce_by_key(_lines(spark, sf_dir), _LINES), _LINES)


@query("SELECT CAST(sum(r) AS BIGINT) AS candidate_count, count(*) AS unique_business_key_count, CAST(coalesce(sum(r - 1) FILTER (NOT x), 0) AS BIGINT) AS exact_duplicate_count, CAST(sum(r) FILTER (x) AS BIGINT) AS conflicting_duplicate_count FROM (SELECT count(*) AS r, " + " OR ".join(f"count(DISTINCT {c}) > 1" for c in _LINE) + " AS x FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def lineitem_dup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.table_stats(outputs.key_facts(_lines(spark, sf_dir), _LINES), _LINES).drop("target_table", "missing_output_count")


@query("SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY ALL")
def lineitem_ship_before_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.where("l_shipdate < o_orderdate").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("row_count"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def lineitem_full_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.full_distinct(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


# ------------------------------------------------------------------------------------------------- reconciliation


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def orders_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    return reconcile.orphans(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 20 = 0")
def orders_orphans_with_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return reconcile.orphans(table(spark, sf_dir, "orders"), "o_custkey", c.where("c_custkey % 10 <> 0"), "c_custkey", c.where("c_custkey % 20 = 10")).select("o_orderkey")


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.when(F.expr("c_custkey % 7 = 0"), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))


_OLD = "old AS (SELECT * REPLACE (CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal) FROM customer WHERE c_custkey % 5 <> 0)"
_FORE = f"WITH {_OLD}, f AS (SELECT c.c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN c.c_name IS NOT DISTINCT FROM o.c_name AND c.c_nationkey IS NOT DISTINCT FROM o.c_nationkey AND c.c_acctbal IS NOT DISTINCT FROM o.c_acctbal AND c.c_mktsegment IS NOT DISTINCT FROM o.c_mktsegment THEN 'unchanged' ELSE 'update' END AS outcome FROM customer c LEFT JOIN old o ON c.c_custkey = o.c_custkey)"


@query(f"{_FORE} SELECT * FROM f")
def customer_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.forecast(table(spark, sf_dir, "customer"), _existing(spark, sf_dir), ["c_custkey"], _CUSTOMER[1:]).select("c_custkey", "outcome")


@query(f"{_FORE} SELECT outcome, count(*) AS row_count FROM f GROUP BY ALL")
def customer_forecast_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.forecast_counts(table(spark, sf_dir, "customer"), _existing(spark, sf_dir), ["c_custkey"], _CUSTOMER[1:])


@query(f"WITH {_OLD}, new AS (SELECT * FROM customer WHERE c_custkey % 3 = 0) SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal FROM new n FULL JOIN old o ON n.c_custkey = o.c_custkey")
def customer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return reconcile.upsert(_existing(spark, sf_dir), new, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query(f"{_FORE} SELECT c_custkey FROM f WHERE outcome <> 'unchanged'")
def post_publish_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.mismatches(table(spark, sf_dir, "customer"), _existing(spark, sf_dir), ["c_custkey"], _CUSTOMER[1:]).select("c_custkey")


@query(f"""{_stats_sql().replace(" SELECT 'members' AS target_table", ", st AS (SELECT 'members' AS target_table", 1)}), k AS (SELECT (SELECT count(*) FROM bad) AS r, (SELECT count(*) FROM n) AS s)
SELECT 'source_row_accounting' AS code, 'error' AS severity, s = r + (SELECT count(*) FROM acc) AS passed FROM k UNION ALL SELECT 'maximum_reject_rate', 'warning', r / s <= 0.1 FROM k
UNION ALL SELECT target_table || '_conflicting_business_keys', 'error', conflicting_duplicate_count = 0 FROM st UNION ALL SELECT target_table || '_required_outputs', 'error', missing_output_count = 0 FROM st
UNION ALL SELECT target_table || '_foreign_key_orphans', 'error', target_table <> 'member_coverage' OR NOT EXISTS (SELECT 1 FROM acc WHERE plan_id NOT IN (SELECT plan_id FROM acc WHERE plan_id IS NOT NULL) OR member_id NOT IN (SELECT member_id FROM acc WHERE member_id IS NOT NULL)) FROM st""")
def reconcile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir)
    made = outputs.tables(r.typed, r.issues, CONTRACT)
    plain = {t.name: outputs.output(made[t.name], t) for t in CONTRACT.tables}
    stats = [outputs.table_stats(made[t.name], t).first().asDict() for t in CONTRACT.tables]
    lost = {t.name: reconcile.orphan_count(plain, t) for t in CONTRACT.tables}
    checks = reconcile.transform_checks(rules.counts(r.typed, r.issues).first().asDict(), stats, lost, CONTRACT)
    return spark.createDataFrame([(c.code, c.severity, c.passed) for c in checks], "code string, severity string, passed boolean")


# ------------------------------------------------------------------------------------------------- identity and replay


_MONEY = "printf('%.2f', c_acctbal)"
_ROW = f"CAST(c_custkey AS STRING) || chr(31) || c_name || chr(31) || CAST(c_nationkey AS STRING) || chr(31) || {_MONEY} || chr(31) || c_mktsegment"


def _customer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with its balance as text of two places, which all engines write alike."""
    return table(spark, sf_dir, "customer").withColumn("c_acctbal", F.format_string("%.2f", "c_acctbal"))


@query(f"SELECT c_custkey, sha256({_ROW}) AS fingerprint FROM customer")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_text(spark, sf_dir).select("c_custkey", ingest.text_fingerprint(_CUSTOMER).alias("fingerprint"))


@query(f"""SELECT c_custkey, sha256('{{"c_acctbal":"' || {_MONEY} || '","c_custkey":"' || c_custkey || '","c_mktsegment":' || coalesce('"' || nullif(c_mktsegment, 'BUILDING') || '"', 'null') || ',"c_name":"' || replace(c_name || ' "\\', '\\', '\\\\').replace('"', '\\"') || '","c_nationkey":"' || c_nationkey || '"}}') AS fingerprint FROM customer""")
def json_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What corrections hold rows to: columns by name as JSON, with quotes, backslashes and nulls."""
    rows = _customer_text(spark, sf_dir).withColumn("c_name", F.concat("c_name", F.lit(' "\\'))).withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return rows.select("c_custkey", ingest.row_fingerprint(_CUSTOMER).alias("fingerprint"))


@query(f"SELECT CAST(o_orderkey + 2 AS BIGINT) AS source_row_number, {_RID.replace('source_row_number', '(o_orderkey + 2)')} AS source_record_id FROM orders")
def source_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") + 2).cast("long")
    return table(spark, sf_dir, "orders").select(n.alias("source_row_number"), outputs.record_id("demo", n).alias("source_record_id"))


@query(f"WITH r AS (SELECT c_custkey + 1 AS n, sha256({_ROW}) AS h FROM customer), b AS (SELECT n // 4096 AS b, sha256(string_agg(h, '' ORDER BY n)) AS h FROM r GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM b")
def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.file_fingerprint(_customer_text(spark, sf_dir).withColumn("source_row_number", F.col("c_custkey") + 1), _CUSTOMER)


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 1")
def replay_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("source_file_hash"), F.col("o_orderstatus").alias("status"))
    return ingest.latest_by_hash(runs, "7").select("id", "status")


@query("SELECT CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) + 1 AS BIGINT) AS source_row_number, o_orderkey FROM orders")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ordered_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]).select("source_row_number", "o_orderkey")


# ------------------------------------------------------------------------------------------------- corrections


def _queue_and_upload(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source, expected queue, upload): rejected birth dates corrected, with some rows spoilt; the upload has gone through a file."""
    source = elig(spark, sf_dir).select("source_row_number", "member_number", "dob")
    bad = source.where("dob = '1979-02-30'").select("source_row_number", F.col("member_number").alias("original__member_number"), F.col("dob").alias("original__dob"))
    queue = corrections.work_queue(bad, source, "demo")
    n = F.col("source_row_number")
    up = queue.select("source_record_id", n, F.when(n % 5 == 1, "tampered").otherwise(F.col("original_row_fingerprint")).alias("original_row_fingerprint"), F.when(n % 5 == 2, F.col("original__dob")).otherwise("1979-02-28").alias("corrected__dob"), F.when(n % 5 == 3, "").otherwise("checked").alias("correction_comment"))
    path = scratch_path(spark, "upload")
    ingest.write_csv(up, path, single=False)
    return source, queue, ingest.read_upload(spark, path)


_UP = f"WITH e AS ({ELIG_SQL}), u AS (SELECT *, {_RID} AS source_record_id FROM e WHERE dob = '1979-02-30')"


@query(f"{_UP} SELECT source_record_id, CASE source_row_number % 5 WHEN 1 THEN 'Original row fingerprint mismatch.' WHEN 2 THEN 'No changes.' WHEN 3 THEN 'A comment is required.' END AS error FROM u")
def corrections_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, queue, up = _queue_and_upload(spark, sf_dir)
    return corrections.checked_upload(up, queue, corrections.source_columns(source)).select("source_record_id", "error")


@query(f"{_UP} SELECT source_row_number, member_number, CASE WHEN dob = '1979-02-30' AND source_row_number % 5 IN (0, 4) THEN '1979-02-28' ELSE dob END AS dob FROM e")
def corrections_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, queue, up = _queue_and_upload(spark, sf_dir)
    found = corrections.overlays(corrections.checked_upload(up, queue, corrections.source_columns(source)))
    return corrections.apply_overlays(source, found)


@query(f"{_UP} SELECT source_record_id, source_row_number, 'dob' AS source_column, dob AS original_value, '1979-02-28' AS corrected_value, 'checked' AS comment FROM u WHERE source_row_number % 5 IN (0, 4)")
def corrections_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, queue, up = _queue_and_upload(spark, sf_dir)
    found = corrections.overlays(corrections.checked_upload(up, queue, corrections.source_columns(source)))
    return corrections.audit(found, source)


@query(f"{I}, u AS (SELECT source_row_number FROM e WHERE dob = '1979-02-30' AND source_row_number % 5 IN (0, 4)) SELECT source_row_number, CASE WHEN source_row_number IN (SELECT source_row_number FROM i WHERE severity = 'error' AND issue_code NOT IN ('date_of_birth_missing_or_invalid', 'duplicate_member_id_conflicting_identity')) THEN 'still_rejected' ELSE 'recovered' END AS recovery_status FROM u")
def recovery_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected rows after the whole corrected file was validated again, without the rule on identities: both halves of a member's rows may differ."""
    source, queue, up = _queue_and_upload(spark, sf_dir)
    found = corrections.overlays(corrections.checked_upload(up, queue, corrections.source_columns(source)))
    full = elig(spark, sf_dir)
    fixed = full.drop("dob").join(corrections.apply_overlays(source, found).select("source_row_number", "dob"), "source_row_number")
    flat = pipeline.build_flat(fixed.select("source_row_number", *COLUMNS), identity_mappings(), CONTRACT)
    typed = cut(normalize.normalize(flat.df, CONTRACT))
    issues = rules.validate(typed, CONTRACT, flat, _asof()).where("issue_code <> 'duplicate_member_id_conflicting_identity'")
    return corrections.recovery(found, corrections.recovered_subset(issues, found))


_FIX = "CASE WHEN source_row_number % 50 = 0 THEN {x} ELSE {c} END"
_FIXED = {"dob": "'1979-02-28'", "member_number": "'MEM' || lpad(CAST(source_row_number % 7 AS STRING), 6, '0')", "last": "'Fixed'", "plan_type": "'HMO'", "subscriber_id": "'MEM' || lpad(CAST(source_row_number % 11 AS STRING), 6, '0')"}
_FIXED_ELIG = f"SELECT source_row_number, {', '.join(_FIX.format(x=_FIXED[c], c=chr(34) + c + chr(34)) + f' AS {chr(34)}{c}{chr(34)}' if c in _FIXED else chr(34) + c + chr(34) for c in COLUMNS)} FROM ({ELIG_SQL})"


@query(f"{I.replace(ELIG_SQL, _FIXED_ELIG)} SELECT source_row_number, severity, issue_code, issue_message, target_field, source_column FROM i")
def revalidated_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues after every fiftieth row got another birth date, member, name, plan type and subscriber: only those rows and the groups they touch are judged again."""
    r = Run(spark, sf_dir)
    fixed = r.source.where("source_row_number % 50 = 0").withColumns({c: F.expr(x) for c, x in _FIXED.items()})
    flat = pipeline.build_flat(fixed.select("source_row_number", *COLUMNS), identity_mappings(), CONTRACT)
    changed = normalize.normalize(flat.df, CONTRACT)
    found = revalidate.revalidate(r.typed, r.issues, changed, CONTRACT, flat, _asof())
    return found.select("source_row_number", "severity", "issue_code", "issue_message", "target_field", "source_column")


# ------------------------------------------------------------------------------------------------- profiles


def _profile_sql(rows: str, columns: list[str]) -> str:
    from .mapping import column_key

    parts = []
    for c in columns:
        q = f'"{c}"'
        enum = lambda kind: f"coalesce((SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT DISTINCT {_case(_token('v'), CROSSWALKS[kind])} AS w FROM t) WHERE w IS NOT NULL), '')"
        rate = lambda x: f"CASE WHEN count(v) > 0 THEN round({x} / count(v), 4) ELSE 0.0 END"
        digits = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
        parts.append(
            f"(WITH t AS (SELECT nullif(trim(CAST({q} AS VARCHAR)), '') AS v FROM {rows}) SELECT '{c}' AS column_name, '{column_key(c)}' AS normalized_name, count(v) AS non_null_count, round(1 - count(v) / count(*), 4) AS null_rate, count(DISTINCT v) AS unique_count, {rate('count(DISTINCT v)')} AS unique_rate, "
            f"{rate('count(' + _date('v') + ')')} AS date_parse_rate, {rate(chr(99) + 'ount(*) FILTER (regexp_matches(v, ' + chr(39) + '^[^@ ]+@[^@ ]+[.][^@ ]+$' + chr(39) + '))')} AS email_pattern_rate, {rate(f'count(*) FILTER ({digits} IN (10, 11))')} AS phone_pattern_rate, {rate('count(TRY_CAST(v AS DOUBLE))')} AS numeric_parse_rate, "
            + ", ".join(f"{enum(k)} AS enum_{k}" for k in CROSSWALKS)
            + f", strftime(min({_date('v')}), '%Y-%m-%d') AS min_date, strftime(max({_date('v')}), '%Y-%m-%d') AS max_date FROM t)"
        )
    words = "string_split(normalized_name, ' ')"
    any_enum = " || ".join(f"enum_{k}" for k in CROSSWALKS)
    kind = f"CASE WHEN email_pattern_rate >= 0.6 THEN 'email' WHEN phone_pattern_rate >= 0.6 THEN 'phone' WHEN date_parse_rate >= 0.7 THEN 'date' WHEN {any_enum} <> '' THEN 'enum' WHEN list_has_any({words}, {list(profile.TEXT_WORDS)}) THEN 'text' WHEN list_has_any({words}, {list(profile.ID_WORDS)}) THEN 'identifier' WHEN numeric_parse_rate >= 0.85 THEN 'numeric' WHEN non_null_count > 0 AND unique_rate <= 0.1 THEN 'enum' ELSE 'text' END"
    return f"SELECT *, {kind} AS inferred_type FROM ({' UNION ALL '.join(parts)})"


_EVENTS = ["event_id", "user_id", "event_type", "ts", "value", "props"]


@query(_profile_sql("customer", _CUSTOMER))
def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "customer"), _CUSTOMER)


@query(_profile_sql("events", _EVENTS))
def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "events"), _EVENTS)


@query(_profile_sql(f"({ELIG_SQL})", COLUMNS))
def profile_elig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(elig(spark, sf_dir), COLUMNS)


@query(f"SELECT column_name, round(null_rate * 100, 1) AS null_rate, inferred_type FROM ({_profile_sql('customer', _CUSTOMER)})")
def profile_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.display(profile.profile(table(spark, sf_dir, "customer"), _CUSTOMER)).select("column_name", "null_rate", "inferred_type")


def _ranked(columns: list[str], order: str, measure: str, rows: str) -> str:
    union = " UNION ALL ".join(f"SELECT '{c}' AS column_name, nullif(trim(CAST(\"{c}\" AS VARCHAR)), '') AS value, source_row_number FROM {rows}" for c in columns)
    return f"SELECT * FROM (SELECT column_name, value, {measure}, CAST(row_number() OVER (PARTITION BY column_name ORDER BY {order}) AS INT) AS rank FROM ({union}) WHERE value IS NOT NULL GROUP BY column_name, value) WHERE rank <= 5"


@query(_ranked(COLUMNS, "count(*) DESC, value", "count(*) AS row_count", f"({ELIG_SQL})"))
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(elig(spark, sf_dir), COLUMNS)


@query(_ranked(COLUMNS, "min(source_row_number), value", "min(source_row_number) AS first_row", f"({ELIG_SQL})"))
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_values(elig(spark, sf_dir), COLUMNS)


def _events_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged sketches of all events: two files' worth, each sketched once and stored."""
    events, store = table(spark, sf_dir, "events"), Store(spark, scratch_path(spark, "sketches"))
    late = F.coalesce(F.col("ts") >= F.lit("2024-01-16").cast("timestamp"), F.lit(False))
    for run, part in enumerate((events.where(~late), events.where(late)), 1):
        store.append("profile_sketches", sketches.sketch(part, _EVENTS), run)
    return sketches.merge(store.audit("profile_sketches"))


@query(f"SELECT * EXCLUDE (unique_count, unique_rate) FROM ({_profile_sql('events', _EVENTS)})")
def profile_events_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of events from stored sketches of parts; all but the estimates of distinct values, which a test holds to their bound."""
    return sketches.to_profile(_events_in_parts(spark, sf_dir), _EVENTS).drop("unique_count", "unique_rate")


@query("SELECT value, row_count, CAST(row_number() OVER (ORDER BY row_count DESC, value) AS INT) AS rank FROM (SELECT event_type AS value, count(*) AS row_count FROM events WHERE nullif(trim(event_type), '') IS NOT NULL GROUP BY ALL) QUALIFY rank <= 5")
def profile_events_top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent values from the same sketches; event_type has few values, so its counts are exact."""
    return sketches.top_values(_events_in_parts(spark, sf_dir)).where("column_name = 'event_type'").drop("column_name")


@query(f"SELECT DISTINCT word, kind FROM (SELECT {_case(_token('plan_type'), CROSSWALKS['plan_type'])} AS word, 'plan_type' AS kind FROM ({ELIG_SQL}) UNION ALL SELECT {_case(_token('status'), CROSSWALKS['coverage_status'])}, 'coverage_status' FROM ({ELIG_SQL})) WHERE word IS NOT NULL")
def profile_enum_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elig(spark, sf_dir)
    parts = [e.select(text.lookup(text.token(F.col(c)), CROSSWALKS[k]).alias("word"), F.lit(k).alias("kind")) for c, k in (("plan_type", "plan_type"), ("status", "coverage_status"))]
    return parts[0].unionByName(parts[1]).where("word is not null").distinct()


# ------------------------------------------------------------------------------------------------- second contract


def _book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = order_book_contract()
    flat = pipeline.build_flat(order_book(spark, sf_dir), book_mappings(c), c)
    typed = normalize.written(flat, c, ingest.numbered)
    return typed, rules.validate(typed, c, flat, _asof())


_B = f"WITH b AS ({ORDER_BOOK_SQL}), acc AS (SELECT * FROM b WHERE TRY_CAST(quantity AS DOUBLE) BETWEEN 1 AND 50)"


def _book_table(name: str, of: str, select: str, group: str) -> None:
    @query(f"{_B} SELECT {select} FROM acc GROUP BY {group}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = order_book_contract()
        return _text(outputs.output(outputs.tables(*_book(spark, sf_dir), c, [of], statistics=False)[of], c.table(of)))


def _pick(c: str, as_double: bool = False) -> str:
    e = f"arg_min({c}, source_row_number)"
    return f"CAST({e} AS DOUBLE) AS {c}" if as_double else f"{e} AS {c}"


_book_table("order_book_customers", "customers", f"customer_id, {_pick('customer_name')}, {_pick('segment')}, {_pick('balance', True)}", "customer_id")
_book_table("order_book_orders", "orders", f"order_id, {_pick('customer_id')}, {_pick('order_date')}, {_pick('order_status')}, {_pick('total', True)}", "order_id")
_book_table("order_book_lines", "order_lines", f"order_id, CAST(line_number AS DOUBLE) AS line_number, {_pick('ship_date')}, {_pick('quantity', True)}, {_pick('price', True)}", "order_id, line_number")


@query(f"{_B} SELECT issue_code, count(*) AS row_count FROM (SELECT CASE WHEN CAST(balance AS DOUBLE) < 0 THEN 'balance_out_of_range' END AS issue_code FROM b UNION ALL SELECT CASE WHEN CAST(order_date AS DATE) > DATE '2026-01-01' THEN 'order_date_future' END FROM b UNION ALL SELECT CASE WHEN CAST(quantity AS DOUBLE) NOT BETWEEN 1 AND 50 THEN 'quantity_out_of_range' END FROM b) WHERE issue_code IS NOT NULL GROUP BY ALL")
def order_book_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir)[1].groupBy("issue_code").agg(F.count("*").alias("row_count"))


# ------------------------------------------------------------------------------------------------- scalars

_SCALAR = "' ' || lower(c_mktsegment) || '-' || CAST(c_custkey AS STRING) || '. X/Y '"


@query(f"SELECT c_custkey, {_token('s')} AS token, length(regexp_replace(s, '[^0-9]', '', 'g')) AS digits, CAST(CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS BOOLEAN) AS flag, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) END AS num FROM (SELECT c_custkey, {_SCALAR} AS s FROM customer)")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, digits, booleans and numbers."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SCALAR).alias("s"), F.expr("CASE c_custkey % 3 WHEN 0 THEN ' Yes' WHEN 1 THEN 'n' ELSE 'maybe' END").alias("b"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) || '.0' ELSE CAST(c_custkey AS STRING) || 'd' END").alias("x"))
    return df.select("c_custkey", text.token(F.col("s")).alias("token"), F.length(text.digits(F.col("s"))).cast("long").alias("digits"), text.boolean(F.col("b")).alias("flag"), text.number(F.col("x")).alias("num"))


@query("SELECT o_orderkey, CAST(CASE WHEN d > DATE '2026-01-01' THEN -1 ELSE date_diff('year', d, DATE '2026-01-01') - CASE WHEN strftime(d, '%m%d') > '0101' THEN 1 ELSE 0 END END AS INT) AS age FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def age_in_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(d > _asof(), -1).otherwise(dates.age(d, _asof())).cast("int").alias("age"))




# ------------------------------------------------------------------------------------------------- suggestion, store


#: Expected suggestions, by the fixed points: an alias 70; 30 for clear evidence, 20 for texts, 10 and 5 for ids that repeat; 20 off for a vague header.
_SUGGESTED = """
('members', 'member_id', 'member_number', 80, 'suggested', 'weak_type_alignment', true, 'weak'),
('members', 'first_name', 'first', 90, 'strong_suggestion', '', false, 'aligned'),
('members', 'last_name', 'last', 90, 'strong_suggestion', '', false, 'aligned'),
('members', 'date_of_birth', 'dob', 100, 'strong_suggestion', '', false, 'aligned'),
('members', 'gender', 'sex', 100, 'strong_suggestion', '', false, 'aligned'),
('members', 'email', 'email_address', 100, 'strong_suggestion', '', false, 'aligned'),
('members', 'phone', 'phone', 100, 'strong_suggestion', '', false, 'aligned'),
('plans', 'plan_id', 'plan_code', 100, 'strong_suggestion', '', false, 'aligned'),
('plans', 'plan_name', 'plan_name', 90, 'strong_suggestion', '', false, 'aligned'),
('plans', 'plan_type', 'plan_type', 100, 'strong_suggestion', '', false, 'aligned'),
('plans', 'carrier_name', 'carrier', 90, 'strong_suggestion', '', false, 'aligned'),
('member_coverage', 'member_id', 'member_number', 80, 'suggested', 'weak_type_alignment', true, 'weak'),
('member_coverage', 'plan_id', 'plan_code', 100, 'strong_suggestion', '', false, 'aligned'),
('member_coverage', 'coverage_start_date', 'effective_date', 100, 'strong_suggestion', '', false, 'aligned'),
('member_coverage', 'coverage_end_date', 'term_date', 100, 'strong_suggestion', '', false, 'aligned'),
('member_coverage', 'coverage_status', 'status', 80, 'suggested', 'ambiguous_status', true, 'aligned'),
('member_coverage', 'relationship_to_subscriber', 'relation', 100, 'strong_suggestion', '', false, 'aligned'),
('member_coverage', 'subscriber_id', 'subscriber_id', 55, 'weak_suggestion', 'ambiguous_subscriber_id,weak_type_alignment', true, 'weak')
"""


@query(f"SELECT * FROM (VALUES {_SUGGESTED}) AS v(target_table, target_field, source_column, confidence, status, review_flags, needs_review, alignment)")
def elig_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested mappings of the eligibility columns."""
    found = suggest(profile.profiles_for_mapping(elig(spark, sf_dir), COLUMNS), CONTRACT)
    rows = [(m.table, m.field, m.source, m.confidence, m.status, ",".join(m.flags), m.needs_review, m.alignment) for m in found]
    return spark.createDataFrame(rows, "target_table string, target_field string, source_column string, confidence int, status string, review_flags string, needs_review boolean, alignment string")


@query("SELECT * FROM (VALUES ('carrier', 'unused', false), ('dob', 'approved_mapped', false), ('email_address', 'unused', true), ('sex', 'suggested_mapped', false)) AS v(column_name, status, needs_review)")
def elig_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The use of four source columns by mappings of which one is approved, one is not, and two are missing."""
    from .mapping import source_coverage

    used = [replace(m, approved=m.field != "gender") for m in identity_mappings() if m.field in ("date_of_birth", "gender")]
    found = source_coverage(profile.profiles_for_mapping(elig(spark, sf_dir), ["carrier", "dob", "email_address", "sex"]), used)
    return spark.createDataFrame([(c["column_name"], c["status"], c["needs_review"]) for c in found], "column_name string, status string, needs_review boolean")


@query(f"WITH e AS ({ELIG_SQL}) SELECT source_row_number, strftime({_date('dob')}, '%Y-%m-%d') AS final_value, CASE WHEN {_date('dob')} IS NULL THEN 'failed' ELSE 'ready' END AS status, CASE WHEN {_date('dob')} IS NULL THEN 'Value could not be parsed as a date.' ELSE '' END AS message FROM e ORDER BY source_row_number LIMIT 10")
def elig_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of a pipeline, as its editor shows them."""
    return pipeline.preview(elig(spark, sf_dir), Mapping("members", "date_of_birth", ("dob",), tuple(_PD)), CONTRACT).drop("transformation_trace")


@query("SELECT row_number() OVER (ORDER BY c_custkey) + 1 AS source_row_number, CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'a \"b\", ' || c_name END AS c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV and read back: quotes, commas, missing tokens, numbered in file order."""
    k, path = F.col("c_custkey"), scratch_path(spark, "csv")
    name = F.when(k % 3 != 0, F.concat(F.lit('a "b", '), "c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("c_name"), F.when(k % 7 == 0, "N/A").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    ingest.write_csv(rows.orderBy("c_custkey"), path, single=False)
    return ingest.read_csv(spark, path)


@query("SELECT row_number() OVER (ORDER BY c_custkey) + 1 AS source_row_number, CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'line 1,' || chr(10) || chr(10) || 'a \"b\" ' || c_name || chr(10) ELSE c_name END AS c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with line breaks, written as CSV and read back in splits, numbered in file order."""
    path, name = scratch_path(spark, "csv"), F.expr("CASE WHEN c_custkey % 3 <> 0 THEN 'line 1,\n\na \"b\" ' || c_name || '\n' ELSE c_name END")
    ingest.write_csv(table(spark, sf_dir, "customer").select("c_custkey", name.alias("c_name"), "c_mktsegment", "c_nationkey").orderBy("c_custkey"), path, single=False)
    return ingest.read_csv(spark, path)


@query("SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) AS position, c_nationkey || ',' || c_custkey || ',\"a \"\"' || c_name || '\"\"\"' AS line FROM customer UNION ALL SELECT 0, 'c_nationkey,c_custkey,c_name'")
def sorted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an export in parts, in the order of the files: the header, then rows by nation and key."""
    path = scratch_path(spark, "export")
    ingest.export_csv(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit('a "'), "c_name", F.lit('"')).alias("c_name")), path, ["c_nationkey", "c_custkey"])
    lines = ingest.number_rows(spark.read.text(path), 0, [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")])
    return lines.select(F.col("source_row_number").alias("position"), F.col("value").alias("line"))


@query(f"{I} SELECT CAST(r AS INT) AS import_run_id, severity, count(*) AS row_count FROM i, (VALUES (1), (2)) AS v(r) GROUP BY ALL")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of two runs, appended to a store and read back."""
    issues, store = Run(spark, sf_dir).issues, Store(spark, scratch_path(spark, "audit"))
    for run in (1, 2):
        store.append("issues", issues, run)
    return store.audit("issues").groupBy("import_run_id", "severity").agg(F.count("*").alias("row_count"))


@query(f"SELECT 1 AS import_run_id, column_name AS source_column, inferred_type, null_rate, unique_rate, 'approved_mapped' AS coverage_status FROM ({_profile_sql(f'({ELIG_SQL})', COLUMNS)})")
def audit_source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of source columns, appended to a store and read back with its types."""
    from .mapping import source_columns

    found, store = profile.profiles_for_mapping(elig(spark, sf_dir), COLUMNS), Store(spark, scratch_path(spark, "audit"))
    store.append("source_columns", spark.createDataFrame(source_columns(found, identity_mappings()), KINDS["source_columns"]), 1)
    return store.audit("source_columns").select("import_run_id", "source_column", "inferred_type", "null_rate", "unique_rate", "coverage_status")


@query(f"{I} SELECT source_row_number FROM bad WHERE source_row_number IN (SELECT source_row_number FROM i WHERE severity = 'error' AND contains(issue_code, 'date_of_birth'))")
def elig_queue_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir)
    return corrections.with_code(outputs.rejected_rows(r.source, r.issues), "date_of_birth").select("source_row_number")


@query(f"SELECT c_custkey, substr(sha256({_ROW}), 1, 12) AS fingerprint FROM customer")
def short_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_text(spark, sf_dir).select("c_custkey", ingest.short_fingerprint(ingest.text_fingerprint(_CUSTOMER)).alias("fingerprint"))


@query("SELECT 'customers' AS target_table, CASE WHEN c_custkey % 4 = 0 THEN 'insert' WHEN c_custkey % 4 = 1 THEN 'update' ELSE 'unchanged' END AS outcome, count(*) AS row_count FROM customer GROUP BY ALL")
def publish_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two publishes to a fresh store: what the second expected, against what the first left."""
    c = replace(order_book_contract(), tables=order_book_contract().tables[:1])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    k = F.col("customer_id").cast("long") % 4
    store = Store(spark, scratch_path(spark, "store"))
    store.publish({"customers": rows.where(k != 0).withColumn("balance", F.when(k == 1, F.col("balance") + 1).otherwise(F.col("balance")))}, c, file_hash="1", checks=[])
    second = store.publish({"customers": rows}, c, file_hash="2", checks=[])
    return spark.createDataFrame([(t, o, n) for t, x in second.expected.items() for o, n in x.items()], "target_table string, outcome string, row_count long")


def _stored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, c_mktsegment AS segment, CASE WHEN c_custkey % 100 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 100 = 0 THEN 2 ELSE 1 END AS import_run_id FROM customer")
def publish_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers are published, then one in a hundred anew: the stored table in its buckets, with the run that wrote each row."""
    c, rows = replace(order_book_contract(), tables=order_book_contract().tables[:1]), _stored_customers(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "store"), bucket_rows=500)
    store.publish({"customers": rows}, c, file_hash="1", checks=[])
    store.publish({"customers": rows.where("customer_id % 100 = 0").withColumn("balance", F.col("balance") + 1)}, c, file_hash="2", checks=[])
    return store.table("customers").withColumn("import_run_id", F.col("import_run_id").cast("int"))


@query("SELECT 'not_null' AS failed, CAST(count(*) AS VARCHAR) AS actual FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'repeated_business_keys', CAST(count(*) AS VARCHAR) FROM customer WHERE c_custkey % 11 = 0")
def publish_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the write finds in rows without a required value, and in rows with a key that is there twice."""
    c, rows = replace(order_book_contract(), tables=order_book_contract().tables[:1]), _stored_customers(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "store"))
    for bad in (rows.withColumn("customer_name", F.expr("CASE WHEN customer_id % 7 <> 0 THEN customer_name END")), rows.unionByName(rows.where("customer_id % 11 = 0"))):
        try:
            store.publish({"customers": bad}, c, file_hash="1", checks=[])
        except ReconciliationError:
            pass
    found = store.audit("reconciliation").where("stage = 'failed' and not passed")
    return found.select(F.replace("code", F.lit("customers_"), F.lit("")).alias("failed"), F.regexp_replace("actual", "^.*: ", "").alias("actual"))
