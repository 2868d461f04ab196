"""Profiles from merged sketches, against whole profiles."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import profile, sketches
from millrace.sources.store import Store

COLUMNS = ["id", "kind", "mail", "day", "empty"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    made = [(i, f"u{r.randrange(6000)}", r.choice(["PPO", "hmo", "Dental", " ", None]), f"a{i % 50}@x.org" if i % 3 else None, r.choice(["2020-01-31", "2021-02-01", "none"]), None) for i in range(2, 9002)]
    return spark.createDataFrame(made, "source_row_number long, id string, kind string, mail string, day string, empty string")


def both(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for run, part in enumerate((rows.where("source_row_number < 4000"), rows.where("source_row_number >= 4000")), 1):
        store.append("profile_sketches", sketches.sketch(part, COLUMNS, samples=5), run)
    return sketches.merge(store.audit("profile_sketches"))


def test_two_halves_make_the_whole(spark, rows, tmp_path):
    merged = both(spark, rows, tmp_path)
    got = {r.column_name: r.asDict() for r in sketches.to_profile(merged, COLUMNS).collect()}
    want = {r.column_name: r.asDict() for r in profile.profile(rows, COLUMNS).collect()}
    for c in COLUMNS:
        assert abs(got[c]["unique_count"] - want[c]["unique_count"]) <= 0.03 * want[c]["unique_count"]
        assert abs(got[c]["unique_rate"] - want[c]["unique_rate"]) <= 0.03
        assert {k: v for k, v in got[c].items() if not k.startswith("unique")} == {k: v for k, v in want[c].items() if not k.startswith("unique")}
    small = ["kind", "mail", "day", "empty"]  # fewer values than a sketch follows: exact
    assert sorted(map(tuple, sketches.top_values(merged).where("column_name <> 'id'").collect())) == sorted(map(tuple, profile.top_values(rows, small).collect()))
    columns = ["column_name", "value", "first_row", "rank"]
    assert sorted(map(tuple, sketches.sample_values(merged).select(columns).collect())) == sorted(map(tuple, profile.sample_values(rows, COLUMNS).select(columns).collect()))


def test_no_value_is_shuffled(spark, rows, tmp_path):
    plan = profile.profile(rows.repartition(4), COLUMNS, approximate=True)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1].split(",")[:2] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert keys and all(k[0].startswith("column_name#") and k[1].strip().isdigit() for k in keys)  # the column's name and the number of partitions


def test_tables_without_rows(spark, rows):
    none = rows.where("id is null and id is not null")
    made = sketches.merge(sketches.sketch(none, COLUMNS, samples=5))
    assert made.count() == 0
    assert [r.asDict() for r in sketches.to_profile(made, COLUMNS).collect()] == [r.asDict() for r in profile.profile(none, COLUMNS).collect()]
    one = sketches.merge(sketches.sketch(none, COLUMNS, samples=5).unionByName(sketches.sketch(rows.limit(1), COLUMNS, samples=5)))
    assert {r.column_name: r.rows for r in one.collect()} == {c: 1 for c in COLUMNS}
    assert sketches.sample_values(one).where("column_name = 'empty'").count() == 0
