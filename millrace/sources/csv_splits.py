"""CSV files whose quoted values hold line breaks, read in splits.

A split can't tell by itself whether it starts inside a quoted value. So a first pass works out, for each split and for both ways it may start, how it ends
and how many records start in it. These thin rows are scanned in file order, which fixes how each split really starts and which numbers its records have. The
second pass then cuts each split's lines into records. A record that goes on in later splits is passed on as pieces, at most two a
split, that meet by the record's number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A value: quoted, then all up to the next comma; or anything that doesn't start with a quote.
_VALUE = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
_REST = rf"(?:,{_VALUE})*+"
#: A line that starts outside, or inside, a quoted value, and ends outside.
_WHOLE = re.compile(_VALUE + _REST, re.S)
_CLOSED = re.compile(rf'(?:[^"]++|"")*+"[^,]*+{_REST}', re.S)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted value is open at the end of the line. A quote counts only where a value starts, and within a quoted value."""
    return (_CLOSED if inside else _WHOLE).fullmatch(line) is None


_MEASURED = {"file": pa.string(), "start": pa.int64(), "out": pa.bool_(), "ins": pa.bool_(), "n_out": pa.int64(), "n_ins": pa.int64(), "crlf": pa.bool_()}


class _Lines:
    """The lines of a batch, with the file and split of each, and whether it has a quote."""

    def __init__(self, b: pa.RecordBatch):
        self.text = b.column(0)
        self.file, self.start = b.column(1).to_pylist(), b.column(2).to_pylist()
        self.quoted = pc.match_substring(self.text, '"').to_pylist()

    def __iter__(self) -> Iterator[tuple[str, tuple[str, int], bool]]:
        for t, f, s, q in zip(self.text, self.file, self.start, self.quoted, strict=True):
            yield t.as_py(), (f, s), q


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, ends inside and records, by how the split starts: outside, inside; whether its first line ends with CRLF)."""
    state: dict[tuple[str, int], list] = {}
    for b in batches:
        for line, split, quoted in _Lines(b):
            s = state.setdefault(split, [False, True, 0, 0, line.endswith("\r")])
            for k in (0, 1):
                if not s[k] and line not in ("", "\r"):
                    s[2 + k] += 1
                if quoted:
                    s[k] = ends_inside(line, s[k])
    rows = [(f, at, *s) for (f, at), s in state.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(_MEASURED, r, strict=True)) for r in rows], pa.schema(list(_MEASURED.items())))


def _cutter(states: dict[tuple[str, int], tuple[bool, int, int, int, bool]]):
    """states: by split, whether it starts inside, its first own record, its file's first record (the header), what to add for a row number, and whether lines of its file end with CRLF. Gives (record, number, piece, text, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, record, header, add, crlf, held, piece = None, False, 0, 0, 0, False, [], 0
        out: list[tuple] = []

        def closed(whole: bool) -> None:
            if record != header:
                out.append((record, record + add, piece, "\n".join(held), whole))
            held.clear()

        for b in batches:
            for line, own, quoted in _Lines(b):
                if own != split:
                    if held:
                        closed(False)
                    split = own
                    inside, record, header, add, crlf = states[own]
                    record, piece = record - 1, own[1]  # until a record starts here, lines belong to the one before
                if not inside:
                    if line in ("", "\r"):
                        continue
                    record, piece = record + 1, -1
                held.append(line.removesuffix("\r") if crlf else line)
                if quoted:
                    inside = ends_inside(line, inside)
                if not inside:
                    closed(piece == -1)
            if out:
                yield _rows(out)
                out.clear()
        if held:
            closed(False)
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"record": pa.int64(), "number": pa.int64(), "piece": pa.int64(), "text": pa.string(), "whole": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))


def split_states(measured: list, first: int) -> dict[tuple[str, int], tuple[bool, int, int, int, bool]]:
    """The scan over splits in file order; see _cutter."""
    states, record, header, headers, file = {}, 0, 0, 0, None
    for r in sorted(measured, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            headers += record > header
            file, crlf, inside, header = r["file"], r["crlf"], False, record
        states[file, r["start"]] = (inside, record, header, first - 1 - headers, crlf)
        record += r["n_ins"] if inside else r["n_out"]
        inside = r["ins"] if inside else r["out"]
    return states


def read_records(spark: SparkSession, path: str, columns: list[str], first: int = 2) -> DataFrame:
    """source_row_number and the columns as text: the records of the files in the order of their names, headers left out, numbered from first.

    Lines end with LF or CRLF, as a file's first line does; a line break in quotes is an LF then, empty lines between records are skipped, and a quote that is open
    at a file's end is closed there. A record's pieces are put together in one row, as any reader must; nothing else is gathered. One thin row a split reaches the driver.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    measured = lines.mapInArrow(_measure, "file string, start long, out boolean, ins boolean, n_out long, n_ins long, crlf boolean").collect()
    shared = spark.sparkContext.broadcast(split_states(measured, first))  # a row a split

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cutter(shared.value)(batches)

    cut = lines.mapInArrow(run, "record long, number long, piece long, text string, whole boolean")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "\n")
    pieces = cut.where("not whole").groupBy("record", "number").agg(text.alias("text")).select("number", "text")
    records = cut.where("whole").select("number", "text").unionByName(pieces)
    kinds = ", ".join(f"c{k} string" for k in range(len(columns)))
    made = records.select("number", F.from_csv(F.regexp_replace("text", r"\r\z", ""), kinds, {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}).alias("c"))
    return made.select(F.col("number").alias("source_row_number"), *[F.col(f"c.c{k}").alias(c) for k, c in enumerate(columns)])
