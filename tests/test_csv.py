"""CSV files with line breaks in quotes: in splits as in one task; uploads of corrections through files."""

import csv
import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import corrections
from millrace.sources import csv_splits, ingest
from millrace.sources.checkpoint import cut


def state_by_characters(line, inside):
    """The plain way: one character after another."""
    at_start, k = not inside, 0
    while k < len(line):
        c = line[k]
        if inside:
            if c == '"' and line[k + 1 : k + 2] == '"':
                k += 1
            elif c == '"':
                inside = False
                while k + 1 < len(line) and line[k + 1] != ",":
                    k += 1
            at_start = False
        elif c == ",":
            at_start = True
        elif c == '"' and at_start:
            inside, at_start = True, False
        else:
            at_start = False
        k += 1
    return inside


@given(st.text('",ab\r', max_size=14), st.booleans())
@settings(max_examples=1000, deadline=None)
def test_state_at_a_lines_end(line, inside):
    assert csv_splits.ends_inside(line, inside) == state_by_characters(line, inside)


def one_task(spark, path):
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return ingest.null_tokens(ingest.number_rows(df, block=[F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]))


def value(rng):
    return rng.choice(["", "x", "NA", "12", '"a,b"', '"two\nlines"', '"say ""hi""\n\n"', '5" pipe', '""', '"\n"', '"' + "long\n" * rng.randint(1, 60) + '"', "é中"])


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_read_what_one_task_reads(spark, tmp_path, seed, end):
    rng, folder = random.Random(seed), tmp_path / "in"
    folder.mkdir()
    for name in ("b.csv", "a.csv", "c.csv"):
        lines = ['"k,\n1",source_row_number,v', *[",".join((f"{name}{i}", value(rng), value(rng))) for i in range(rng.randint(0, 150))]]
        text = "\n".join(lines + [""] * rng.randint(0, 2))
        (folder / name).write_bytes(text.replace("\n", end).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = ingest.read_csv(spark, str(folder), multiline=True)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 3
        rows = sorted(map(tuple, got.collect()), key=lambda r: r[0])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted(map(tuple, one_task(spark, str(folder)).collect()), key=lambda r: r[0])
    assert rows == want and [r[0] for r in rows] == list(range(2, len(rows) + 2))


def test_an_open_quote_ends_with_its_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"open\nto the end\n')
    (tmp_path / "b.csv").write_text("a,b\n2,x\n")
    got = sorted(map(tuple, csv_splits.read_records(spark, str(tmp_path), ["a", "b"]).collect()))
    assert [r[:2] for r in got] == [(2, "1"), (3, "2")] and got[0][2].startswith("open\nto the end")


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("a,b\n")
    (tmp_path / "c.csv").write_text("a,b\n1,2")
    assert list(map(tuple, csv_splits.read_records(spark, str(tmp_path), ["a", "b"]).collect())) == [(2, "1", "2")]


def test_corrections_go_through_a_file(spark, tmp_path):
    """The queue is written, edited by hand, and read again."""
    source = spark.createDataFrame([(2, "M1", "bad", 'he said "no",\nthen left'), (3, "M2", "bad", None), (4, "M3", "1990-01-01", "x")], "source_row_number long, member_number string, dob string, note string")
    rejected = source.where("dob = 'bad'").select("source_row_number", *[F.col(c).alias(f"original__{c}") for c in ("member_number", "dob", "note")])
    queue = cut(corrections.work_queue(rejected, source, "h"))
    columns = corrections.source_columns(source)
    ingest.write_csv(queue, str(tmp_path / "queue"))
    edited = ingest.read_upload(spark, str(tmp_path / "queue")).withColumn("corrected__dob", F.lit("1980-02-03")).withColumn("correction_comment", F.lit("called,\nagain"))
    ingest.write_csv(edited, str(tmp_path / "edited"))
    up = ingest.read_upload(spark, str(tmp_path / "edited"))
    checked = cut(corrections.checked_upload(up, queue, columns))
    assert [r.error for r in checked.collect()] == [None, None]
    fixed = corrections.apply_overlays(source, corrections.overlays(checked)).orderBy("source_row_number").collect()
    assert [(r.dob, r.note) for r in fixed] == [("1980-02-03", 'he said "no",\nthen left'), ("1980-02-03", None), ("1990-01-01", "x")]
    moved = up.withColumn("source_row_number", F.col("source_row_number") + 1)
    assert {r.error for r in corrections.checked_upload(moved, queue, columns).collect()} == {"source_row_number does not match."}


def test_exports_are_sorted_parts_of_one_file(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(5)]), i, rng.choice([' a,"b" ', None, "two\nlines", ""])) for i in rng.sample(range(500), 500)]
    df = spark.createDataFrame(rows, '`k,1` int, i int, v string')
    sizes = ingest.export_csv(df, str(tmp_path / "out"), ["`k,1`", "i"], 6)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) == len(sizes) > 3 and sum(sizes) == 500 and json.loads((tmp_path / "out/_parts.json").read_text())["rows"] == sizes
    got = list(csv.reader(io.StringIO("".join(f.read_text() for f in files), newline="")))
    assert got[0] == ["k,1", "i", "v"]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r) for r in got[1:]] == [("" if k is None else str(k), str(i), v or "") for k, i, v in want]
    assert ingest.export_csv(df.limit(0), str(tmp_path / "none"), ["i"]) == []
    assert "".join(f.read_text() for f in (tmp_path / "none").glob("part-*")) == '"k,1",i,v\n'
