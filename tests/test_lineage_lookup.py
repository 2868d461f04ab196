"""Stored lineage is looked up by record without reading the rest."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import normalize, outputs, pipeline, rules
from millrace.operators.outputs import record_id
from millrace.plans.fixtures import COLUMNS, CONTRACT, identity_mappings
from millrace.sources.checkpoint import cut
from millrace.sources.store import Store

ROWS = 3000


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    n = F.col("id")
    values = {c: F.concat(F.lit(f"{c}-"), n.cast("string")) for c in COLUMNS}
    source = spark.range(ROWS).select((n + 2).alias("source_row_number"), *[v.alias(c) for c, v in values.items()])
    flat = pipeline.build_flat(source, identity_mappings(), CONTRACT, True)
    typed = cut(normalize.normalize(flat.df, CONTRACT))
    issues = cut(rules.validate(typed, CONTRACT, flat))
    fixed = source.where("source_row_number = 77").select("source_row_number", F.lit("dob").alias("source_column"), F.lit("1980-01-01").alias("corrected_value"))
    made = Store(spark, str(tmp_path_factory.mktemp("store")))
    made.append("lineage", outputs.lineage(flat, typed, issues, "hash", fixed, clustered=True), 1)
    made.append("lineage", outputs.lineage(flat, typed, issues, "other"), 2)
    return made


def rows_read(df):
    """(rows of the result, rows that its scans gave on)."""
    found = df.collect()
    nodes, read = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            read += node.metrics().get("numOutputRows").get().value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found, read


def of(spark, file_hash, row):
    return spark.range(1).select(record_id(file_hash, F.lit(row))).first()[0]


def test_a_record_is_a_few_pages(spark, store):
    fields = len(CONTRACT.fields)
    assert store.audit("lineage", 1).count() == ROWS * fields
    found, read = rows_read(store.lineage_of([of(spark, "hash", 77)], 1))
    assert len(found) == fields and {r.source_row_number for r in found} == {77}
    assert {r.corrected_values_json for r in found if r.source_column == "dob"} == {'{"dob":"1980-01-01"}'} and {r.corrected_values_json for r in found if r.source_column != "dob"} == {"{}"}
    assert fields <= read <= 2 * 2000 + fields < ROWS * fields / 10
    found, read = rows_read(store.lineage_of([of(spark, "hash", i) for i in (5, 900)], 1))
    assert sorted({r.source_row_number for r in found}) == [5, 900] and read < ROWS * fields / 5


def test_records_that_are_not_there_read_nothing(spark, store):
    assert rows_read(store.lineage_of([of(spark, "none", 5)], 1)) == ([], 0)
    assert rows_read(store.lineage_of([], 1))[0] == [] and store.lineage_of(["x"], 9) is None
    found, read = rows_read(store.lineage_of([of(spark, "hash", 77)]))  # of all runs: the files of the other have other ids
    assert {r.import_run_id for r in found} == {1} and read < ROWS * len(CONTRACT.fields) / 10
