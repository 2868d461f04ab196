"""Every operation with blank, ordinary and failing input, under every failure policy."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, text
from millrace.operators import pipeline
from millrace.plans.mapping import Mapping, Step


pytestmark = pytest.mark.usefixtures("interpreted")
CASES = [
    ("trim", {}, "\t a b \n", "a b"), ("trim", {}, "  ", None), ("trim", {}, " x ", "x"),
    ("null_if", {"values": ["n/a", "X"]}, " N/A ", None), ("null_if", {"values": ["n/a"]}, " keep ", " keep "), ("null_if", {"values": []}, "a", "a"),
    ("uppercase", {}, " aé", " AÉ"), ("lowercase", {}, "ABC ", "abc "),
    ("title_case", {}, "o'neil mc-donald 3rd", "O'Neil Mc-Donald 3Rd"), ("title_case", {}, "", None),
    ("regex_replace", {"pattern": r"(\d+)-(\d+)", "replacement": r"\2/\1"}, "12-34", "34/12"), ("regex_replace", {"pattern": "x", "replacement": "$1"}, "axb", "a$1b"),
    ("regex_replace", {"pattern": r"(?P<a>\w)-", "replacement": r"\g<a>+"}, "q-r", "q+r"),
    ("regex_replace", {"pattern": r"\w+", "replacement": "W"}, "Ünïted Zürich-5", "W W-W"), ("regex_replace", {"pattern": r"(?a)\w+", "replacement": "W"}, "Ünïx", "ÜWïW"),
    ("parse_date", {"accepted_formats": []}, "13/01/2024", "2024-01-13"), ("parse_date", {"accepted_formats": []}, "20240101", "2024-01-01"), ("parse_date", {"accepted_formats": []}, "1979-02-30", "failed"),
    ("parse_date", {"accepted_formats": ["%m/%d/%y"]}, "1/2/70", "1970-01-02"), ("parse_date", {"accepted_formats": ["%m/%d/%Y"]}, "2024-01-02", "failed"), ("parse_date", {"accepted_formats": ["%d-%b-%Y"]}, "05-Jan-2024", "2024-01-05"),
    ("parse_numeric", {}, " $1,234.50", "1234.50"), ("parse_numeric", {"grouping_separator": ".", "decimal_separator": ","}, "1.234,50", "1234.50"), ("parse_numeric", {}, "7d", "failed"), ("parse_numeric", {}, "1e3", "1e3"),
    ("normalize_phone", {}, "1 (555) 010-1234", "555-010-1234"), ("normalize_phone", {}, "555010123", "failed"), ("normalize_phone", {}, "25550101234", "failed"),
    ("normalize_email", {}, " A@B.Co ", "a@b.co"),
    ("map_values", {"mapping": {"A": "1", "a": "2"}}, " A ", "1"), ("map_values", {"mapping": {"Yes": "y"}}, "YES", "y"), ("map_values", {"mapping": {"Yes": "y"}, "case_insensitive": False}, "YES", "failed"), ("map_values", {"mapping": {}, "passthrough_unknown": True}, "q", "q"),
    ("default", {"value": "d"}, " ", "d"), ("default", {"value": "d"}, None, "d"), ("default", {"value": "d"}, "x", "x"),
    ("coalesce", {"source_columns": ["w", "v"]}, "x", "x"), ("coalesce", {"source_columns": ["w"]}, "x", None),
    ("concatenate", {"source_columns": ["v", "w"], "separator": "-"}, " x ", "x"), ("concatenate", {"source_columns": ["w"]}, "x", ""), ("concatenate", {"source_columns": ["v", "w"], "skip_nulls": False}, "x", None),
    ("split", {"delimiter": "."}, "a.b", "a"), ("split", {"delimiter": ".", "part_index": -1}, "a. b ", "b"), ("split", {"delimiter": ".", "part_index": 2}, "a.b", "failed"), ("split", {"delimiter": ".", "part_index": -3}, "a.b", "failed"),
    ("generate_deterministic_id", {"input_fields": ["v"], "prefix": "P", "length": 6}, " x ", "P-2D7116"), ("generate_deterministic_id", {"input_fields": ["v", "w"]}, "x", "failed"),
]


def run(spark, step, value, **more):
    df = spark.createDataFrame([(value, None)], "v string, w string")
    return pipeline.pipeline_columns(df, [Mapping("t", "f", ("v",), (step,), **more)], True, {"v": "v", "w": "w"}).first()["_p0"]


def test_operations(spark):
    """All cases as one row: one projection for all of them."""
    values = {f"c{i}": v for i, (_, _, v, _) in enumerate(CASES)}
    df = spark.createDataFrame([tuple(values.values()) + (None,)], ", ".join(f"{c} string" for c in [*values, "w"]))
    rows = {c: c for c in df.columns}
    mappings = []
    for i, (op, p, _, _) in enumerate(CASES):
        p = {k: [f"c{i}" if c == "v" else c for c in v] if k in ("source_columns", "input_fields") else v for k, v in p.items()}
        mappings.append(Mapping("t", f"f{i}", (f"c{i}",), (Step(op, p),)))
    got = pipeline.pipeline_columns(df, mappings, False, rows).first()
    for i, (op, p, v, want) in enumerate(CASES):
        s = got[f"_p{i}"]
        assert ("failed" if s.failed else s.v) == want, (op, p, v)


@pytest.mark.parametrize("policy,want", [("error", None), ("warning_set_null", None), ("warning_keep_original", "bad"), ("use_default", "dflt")])
def test_policies(spark, policy, want):
    s = run(spark, Step("parse_date", {"accepted_formats": []}), "bad", policy=policy, default="dflt")
    assert s.failed and s.v == want and s.op == "parse_date"
    assert s.trace[-1].status == "failed" and s.trace[-1].output == want


def test_first_failure_stops(spark):
    df = spark.createDataFrame([("bad",)], "v string")
    steps = (Step("trim", {}), Step("parse_date", {"accepted_formats": []}), Step("default", {"value": "x"}))
    s = pipeline.pipeline_columns(df, [Mapping("t", "f", ("v",), steps)], True, {"v": "v"}).first()["_p0"]
    assert s.v is None and [t.operation for t in s.trace] == ["trim", "parse_date"]


def test_scalars(spark):
    df = spark.createDataFrame([("7d", " yes", "1-555-010-9999", "P.P.O"), ("1e3", "F", "12", "high_deductible/Plan"), ("nan", "x", None, None), ("Infinity", None, "", " ")], "n string, b string, p string, t string")
    rows = df.select(text.number(F.col("n")).alias("n"), text.boolean(F.col("b")).alias("b"), text.phone(F.col("p")).alias("p"), text.token(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [(None, True, "555-010-9999", "p p o"), (1000.0, False, None, "high deductible plan"), (None, None, None, None), (None, None, None, "")]


def test_age_by_calendar_day(spark):
    df = spark.createDataFrame([("2000-02-29", "2025-02-28"), ("2000-02-29", "2025-03-01"), ("2000-01-31", "2025-01-31")], "a string, b string")
    assert [r[0] for r in df.select(dates.age(F.to_date("a"), F.to_date("b"))).collect()] == [24, 25, 25]


def test_unknown_directives_raise():
    with pytest.raises(ValueError):
        dates.spark_format("%Q")
    assert dates.spark_format("%d-%b-%Y") == "d-MMM-yyyy"


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("x",)], "v string")
    out = pipeline.pipeline_columns(df, [Mapping("t", "f", ("v",), (Step("title_case", {}), Step("split", {"delimiter": " "})))], True, {"v": "v"})
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_patterns_are_those_of_python(spark):
    patterns = [r"\w+", r"\W+", r"[\w.]+", r"[^\w]", r"[[a]", r"[]a]+", r"(?i)É", r"\bé", r"\d+", r"[\d,]+", r"\s", r"(?a)\d+", r"(?i)(?P<x>ß|ü)(?P=x)?", r"a\Z", r"[\W_]+", r"[^\W\d]+", r"\[\w"]
    texts = ["Ünïted Zürich_5", "é ÉÉ e\u0301x", "١٢,3 \u00a0a", "[ab]", "x]a[", "üÜ ß\tа", "a\na"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1)
    got = df.select(*[F.regexp_replace("v", F.lit(text.java_pattern(p)), F.lit("#")).alias(f"c{k}") for k, p in enumerate(patterns)]).collect()
    for t, r in zip(texts, got, strict=True):
        for p, value in zip(patterns, r, strict=True):
            assert value == re.sub(p, "#", t), (p, t)
