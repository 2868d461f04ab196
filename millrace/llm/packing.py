"""Best-fit packing by minimum bin slack.

Bins differ only in the lengths they hold, so the search runs over the histogram of piece lengths: at most `capacity` numbers, however many
documents there are. Per bin, a bitset subset-sum dynamic programme over the available lengths finds the fullest feasible
combination that holds the largest piece; the combination is then removed as often as the histogram allows, and each
removal uses up at least one length, so there are at most `capacity` searches.

Pieces are then dealt to the planned slots by their rank among pieces of the same length. The rank comes from one range
partitioning by (length, id, piece) with an offset for each partition and length, so a length that a third of all pieces have is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_u32, cut
from .word_tokens import id_table, map_ids

CAPACITY = 4096


def fullest(counts: np.ndarray, seed: int, capacity: int) -> list[int]:
    """Lengths of the fullest combination of available pieces that holds one of length seed; larger pieces are taken first among equals."""
    room = capacity - seed
    reach = [1]  # bit s: sum s can be made from the items so far
    items: list[int] = []
    full = (1 << (room + 1)) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        have = min(int(counts[length]) - (length == seed), room // length)
        for _ in range(have):
            now = (reach[-1] | reach[-1] << length) & full
            if now == reach[-1]:
                break
            items.append(length)
            reach.append(now)
        if reach[-1] >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    out = [seed]
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> total & 1:
            out.append(items[k - 1])
            total -= items[k - 1]
    return out


def bin_plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of a bin) until all pieces are placed; counts[l] pieces have length l."""
    left, plan = counts.astype(np.int64).copy(), []
    top = len(left) - 1
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top <= 0:
            return plan
        lengths = fullest(left, top, capacity)
        used = np.bincount(lengths, minlength=len(left))
        some = np.flatnonzero(used)
        times = int((left[some] // used[some]).min())
        left -= used * times
        plan.append((times, lengths))


def slots(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset of the first, offset step) by length and first rank.

    Pieces of one length stand next to each other in a bin, so their offsets are an arithmetic series.
    """
    rows, taken, bins = [], {}, 0
    for times, lengths in plan:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            m = lengths.count(length)
            rank = taken.get(length, 0)
            rows.append((length, rank, m, bins, offset))
            taken[length] = rank + m * times
            offset += m * length
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, order: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: each sequence's pieces are gapless from 0 and hold at most capacity tokens.

    Lengths are 1 to capacity; rows of length 0 or null are not placed and get nulls. order: columns that, after the length, fix which piece
    gets which slot; rows equal in all of them are interchangeable. Extra columns pass through, but for those named like the two. An empty frame gives an empty frame.
    """
    spark = pieces.sparkSession
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    names = {f.name: f"_c{k}" for k, f in enumerate(fields)}
    length = F.coalesce(F.col(length_col).cast("long"), F.lit(0))
    own = [names[c] for c in order]
    dealt = pieces.select(*[F.col(f"`{n}`").alias(a) for n, a in names.items()], length.alias("_len")).repartitionByRange("_len", *own).sortWithinPartitions("_len", *own)
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()))  # a row keeps the number of its range however it is read from here on
    # One row for each length and range it reaches into: capacity + ranges rows at most.
    sizes = dealt.where("_len > 0").groupBy("_range", "_len").count().collect()
    counts, first = np.zeros(capacity + 1, np.int64), {}
    for r in sorted(sizes, key=lambda r: r["_range"]):
        if r["_len"] > capacity:
            raise ValueError(f"a piece has {r['_len']} tokens, a sequence holds {capacity}")
        first[r["_range"], r["_len"]] = int(counts[r["_len"]])
        counts[r["_len"]] += r["count"]
    table = slots(bin_plan(counts, capacity))
    shared = spark.sparkContext.broadcast((table, first))  # at most a few slots for each of capacity plans

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = shared.value
        seen = {}
        keys = table[:, 0] << 44 | table[:, 1]
        for b in rows:  # the rows of a range come one after another, in its order, whether a task reads one range or several
            lens, ranges = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            rank = np.zeros(len(lens), np.int64)
            start = np.flatnonzero(np.append(True, (np.diff(lens) != 0) | (np.diff(ranges) != 0))) if len(lens) else []
            for s, e in zip(start, np.append(start[1:], len(lens)), strict=True):
                run = (int(ranges[s]), int(lens[s]))
                at = seen.get(run, first.get(run, 0))
                rank[s:e] = at + np.arange(e - s)
                seen = {run: at + int(e - s)}  # a run that goes on in the next batch is the last one of this
            if len(table):
                slot = table[np.clip(np.searchsorted(keys, lens << 44 | rank, "right") - 1, 0, None)]
                inside = rank - slot[:, 1]
                seq, offset = slot[:, 3] + inside // slot[:, 2], slot[:, 4] + inside % slot[:, 2] * lens
            else:
                seq = offset = np.zeros(len(lens), np.int64)
            none = lens <= 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(seq, mask=none), pa.array(offset, mask=none)], [*[f.name for f in fields], "sequence_id", "offset"])

    return dealt.mapInArrow(place, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "sequence_id long", "`offset` long"]))


def document_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut into pieces of capacity only where longer."""

    def make(own: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        end = np.array([end_id], "<u4").tobytes()
        row, piece, start, length, crc = [], [], [], [], []
        for k, data in enumerate(ids):
            data += end
            for j, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                row.append(k), piece.append(j), start.append(at // 4), length.append(len(part) // 4), crc.append(crc32_u32(part))
        own = own.take(pa.array(row, pa.int64()))
        cols = [own.column(0), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    return map_ids(rows, "_t", ["_id"], lambda: make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", tokenizer)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs.

    Null and empty texts are the end id alone. Null ids and repeated rows are packed like others. An empty table gives no rows.
    """
    pieces = cut(document_pieces(docs, id_col, text_col, end_id, capacity, tokenizer))  # tokenized once, thin rows from here on
    return pack_pieces(pieces, ["doc_id", "piece", "ids_crc32"], "length", capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack_documents(id_table(spark, sf_dir))
