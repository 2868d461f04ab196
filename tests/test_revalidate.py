"""Validation by key closure gives what a validation of the whole file gives."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import normalize, pipeline, revalidate, rules
from millrace.plans.fixtures import COLUMNS, CONTRACT, identity_mappings
from millrace.plans.mapping import Mapping
from millrace.sources.checkpoint import cut

pytestmark = pytest.mark.usefixtures("interpreted")


def asof():
    return F.lit("2026-01-01").cast("date")


def random_row(rng):
    pick = {
        "member_number": ["M1", "M2", "M3", "M4", "M5", ""], "first": ["Ann"], "last": ["Lee", "Lee", "Lee", "Low"], "dob": ["1990-05-01", "1990-05-01", "1990-05-01", "2035-01-01", "bad"], "sex": ["F", "?"], "email_address": ["a@b.c", "no"], "phone": ["555-010-1234", "1"],
        "plan_code": ["P1", "P2", "P3", ""], "plan_name": ["Silver", "Silver", "Gold"], "plan_type": ["PPO", "PPO", "?"], "carrier": ["Acme"], "effective_date": ["2024-01-01", "2024-01-01", "2025-01-01"], "term_date": ["", "2023-01-01"], "status": ["Active", "T"],
        "relation": ["Self", "Child", "Spouse"], "subscriber_id": ["M1", "M2", "M4", "M9", ""],
    }
    return tuple(rng.choice(pick[c]) for c in COLUMNS)


def rows_of(df):
    return sorted(map(repr, df.select(*rules.ISSUE).collect()))


def frames(spark, rows, mappings):
    df = spark.createDataFrame([(n, *r) for n, r in rows], "source_row_number int, " + ", ".join(f"`{c}` string" for c in COLUMNS))
    flat = pipeline.build_flat(df, mappings, CONTRACT)
    return flat, cut(normalize.normalize(flat.df, CONTRACT))


@pytest.mark.parametrize("seed", range(4))
def test_closure_is_the_whole(spark, seed):
    rng = random.Random(seed)
    rows = {n: random_row(rng) for n in range(2, 42)}
    fixed = {n: random_row(rng) for n in rng.sample(list(rows), (0, 1, 3, 12)[seed])}
    mappings = identity_mappings()
    if seed == 2:  # a field that two tables fill from different columns
        mappings = [m if (m.table, m.field) != ("member_coverage", "member_id") else Mapping("member_coverage", "member_id", ("subscriber_id",)) for m in mappings]
    flat, typed = frames(spark, rows.items(), mappings)
    issues = cut(rules.validate(typed, CONTRACT, flat, asof()))
    part, changed = frames(spark, fixed.items(), mappings)
    again, whole = frames(spark, (rows | fixed).items(), mappings)
    assert rows_of(revalidate.revalidate(typed, issues, changed, CONTRACT, part, asof())) == rows_of(rules.validate(whole, CONTRACT, again, asof()))


def test_other_groups_are_not_judged_again(spark, monkeypatch):
    """Rows of other members reach no rule."""
    rng = random.Random(1)
    rows = {n: random_row(rng)[:0] + ("M%d" % n, *random_row(rng)[1:]) for n in range(2, 30)}
    flat, typed = frames(spark, rows.items(), identity_mappings())
    issues = cut(rules.validate(typed, CONTRACT, flat, asof()))
    part, changed = frames(spark, [(5, rows[5])], identity_mappings())
    seen = []
    plain = rules.SET_PRESETS["identity_conflicts"]
    monkeypatch.setitem(rules.SET_PRESETS, "identity_conflicts", (plain[0], lambda df: seen.extend(r[0] for r in df.select("source_row_number").collect()) or plain[1](df)))
    revalidate.revalidate(typed, issues, changed, CONTRACT, part, asof())
    assert seen == [5]
