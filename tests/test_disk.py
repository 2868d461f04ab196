"""What queries leave on disk, and that thinner frames hold the same rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import outputs
from millrace.plans import catalogue
from millrace.plans.fixtures import CONTRACT, ORDER_BOOK_SQL, order_book
from millrace.sources.checkpoint import checkpoint_dir, kept
from millrace.sources.ingest import numbered
from millrace.sources.store import Store


def folder_bytes(path):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(path.removeprefix("file:")) for x in names)


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_stored_lineage_leaves_little_beside_it(spark, sf):
    """With checkpoints of all columns it left some 1,200 bytes a record."""
    before = folder_bytes(checkpoint_dir(spark))
    n = catalogue.queries()["elig_lineage_corrected"](spark, sf).count()
    assert folder_bytes(checkpoint_dir(spark)) - before < 700 * n / len(CONTRACT.fields)


def test_lineage_in_parts_is_the_whole(spark, sf, tmp_path, monkeypatch):
    """And rows with issues and corrections are as if they were joined."""
    run = catalogue.Run(spark, sf, trace=True)
    fixed = run.source.where("source_row_number % 3 = 0").select("source_row_number", F.lit("dob").alias("source_column"), F.lit("1980-01-01").alias("corrected_value"))
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*outputs.LINEAGE).collect())
    want = rows(outputs.lineage(run.flat, run.typed, run.issues, "h", fixed))
    monkeypatch.setattr(outputs, "PART_ROWS", 400)
    parts = outputs.lineage_parts(run.flat, run.typed, run.issues, "h", fixed)
    store = Store(spark, str(tmp_path / "store"))
    store.append("lineage", parts, 1)
    assert 2 < len(parts) <= outputs.PARTS and rows(store.audit("lineage", 1)) == want
    broken = parts[1].withColumn("final_value", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        store.append("lineage", [parts[0], broken], 2)
    assert not [x for x in (tmp_path / "store/audit/lineage/import_run_id=2").iterdir() if x.name.endswith(".parquet")]


@pytest.mark.parametrize("name", ["order_book_lines", "order_book_orders", "order_book_issues"])
def test_the_order_book_is_written_thinly(spark, sf, name):
    """With checkpoints of all its columns it took some 500 bytes a line and more."""
    before = folder_bytes(checkpoint_dir(spark))
    catalogue.queries()[name](spark, sf).collect()
    assert folder_bytes(checkpoint_dir(spark)) - before < 160 * spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_kept_frames_leave_no_shuffles(spark):
    before = shuffle_files(spark)
    got = kept(spark.range(1000).repartition(7, "id"))
    assert sorted(r.id for r in got.collect()) == list(range(1000)) and shuffle_files(spark) <= before


def test_the_order_book_has_the_numbers_of_its_sql(spark, sf, tmp_path):
    """With orders that are missing or have no customer, with keys that are null, and one that many lines have."""
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.sql(f"create table {t} as select * from '{sf}/{t}.parquet'")
    con.sql("delete from orders where o_orderkey % 7 = 3")
    con.sql("delete from customer where c_custkey % 11 = 5")
    con.sql("update orders set o_orderkey = null where o_orderkey % 13 = 4")
    con.sql("update lineitem set l_orderkey = null where l_orderkey % 17 = 2")
    con.sql("update lineitem set l_orderkey = 8 where l_orderkey % 5 = 0")
    for t in ("customer", "orders", "lineitem"):
        con.sql(f"copy (select * from {t} order by random()) to '{tmp_path}/{t}.parquet' (format parquet)")
    got = sorted(tuple(r) for r in numbered(order_book(spark, str(tmp_path))).collect())
    want = sorted(con.sql(ORDER_BOOK_SQL).fetchall())
    assert len(want) > 1000 and got == want
