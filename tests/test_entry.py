import pytest

import __spark_entry__ as entry
from millrace.plans import catalogue


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    names = set(entry.queries())
    assert set(catalogue.queries()) <= names and set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["elig_issue_summary", "elig_members", "customer_forecast_counts", "profile_customer"])
def test_queries_match_their_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "customer orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert key(got.select(*columns).collect()) == key(want.select(", ".join(columns)).fetchall())
