"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of word shingles. Equal fingerprints collapse to one node first, so
exact copies never make pairs. Candidate buckets are exact: two fingerprints within radius r that are cut into r + 2 parts agree
on at least two of them, so a bucket for every pair of parts misses nothing. A bucket with too many nodes is cut again on
its remaining bits (r + 1 parts, of which one must agree), until it is small or has no more than r bits left; then it has at most 2 ** r nodes.

Inside a bucket the comparison is bit-sliced: bit planes are stored vertically, 64 nodes to a machine word; the planes of the
differences go into carry-save counters that saturate above the radius, and a block of words whose nodes have all passed the
radius is abandoned. A bucket gives the edges of a spanning forest, never all its pairs. Components come from alternating
large-star and small-star rounds over those edges.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, spread_join, table

BITS = 64
SEED = 42
#: Nodes of a bucket above which its remaining bits are cut again. It bounds a comparison's time, not the result: about half a second.
BUCKET = 16384
#: Nodes that are compared as one block; small buckets share a block. Queries that run against a block at a time.
BLOCK = 512
QUERIES = 256


# ------------------------------------------------------------------------------------------------ fingerprints


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Of A-Z lower-cased UTF-8 text: words between ASCII white space, shingles with repeats, a bit where over half the hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 65536):
        counts += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp long): the fingerprint as a signed number. Null texts count as empty; empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            texts = b.column(1).cast(pa.binary()) if not pa.types.is_binary(b.column(1).type) else b.column(1)
            fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp long")


# --------------------------------------------------------------------------------------- bit-sliced comparison


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words) uint64: bit j of word w of plane p is bit p of fingerprint 64 * w + j. A fingerprint is a number of 64 bits or a row of them."""
    bits = _bits(fps)
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, -len(bits) % 64), (0, 0))).T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def _bits(fps: np.ndarray) -> np.ndarray:
    """(fingerprints, bits) of 0 and 1."""
    rows = np.ascontiguousarray(fps.reshape(len(fps), -1) if len(fps) else fps.reshape(0, 1)).astype("<u8")
    return np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")


def within_radius(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, that differ in at most radius bits."""
    planes = bit_planes(fps)
    found = [_against(fps, planes, at, min(at + QUERIES, len(fps)), radius) for at in range(0, len(fps), QUERIES)]
    return np.concatenate([f[0] for f in found] or [np.empty(0, int)]), np.concatenate([f[1] for f in found] or [np.empty(0, int)])


def _against(fps: np.ndarray, planes: np.ndarray, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of within_radius with first <= i < last."""
    n, words = len(fps), planes.shape[1]
    levels = radius.bit_length()  # counters hold 0 to 2**levels - 1; the carry out of the last one saturates
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    own = np.where(_bits(fps[first:last]), full, np.uint64(0))
    # Lanes of (query, word) pairs that are still open; words before the query's own are left out.
    q, w = np.nonzero(np.arange(words)[None, :] >= (np.arange(first, last) // 64)[:, None])
    counters = [np.zeros(len(q), np.uint64) for _ in range(levels)]
    over = np.zeros(len(q), np.uint64)
    for p in range(len(planes)):
        carry = planes[p][w] ^ own[q, p]
        for level in range(levels):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        over |= carry
        if p % 8 == 7:
            open_ = over != full
            if not open_.all():
                q, w, over = q[open_], w[open_], over[open_]
                counters = [c[open_] for c in counters]
                if not len(q):
                    break
    if 2**levels - 1 > radius and len(q):  # the counter can show values above the radius: sum is compared bit by bit
        more = np.zeros(len(q), np.uint64)
        same = np.full(len(q), full)
        for level in reversed(range(levels)):
            if radius >> level & 1:
                same &= counters[level]
            else:
                more |= same & counters[level]
                same &= ~counters[level]
        over |= more
    hit = np.nonzero(~over != 0)[0]
    lanes = np.unpackbits((~over[hit]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    h, lane = np.nonzero(lanes)
    i, j = q[hit][h] + first, w[hit][h] * 64 + lane
    real = (j > i) & (j < n)
    return i[real], j[real]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each element's component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        diff = a != b
        i, j, a, b = i[diff], j[diff], a[diff], b[diff]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def block_edges(fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of a spanning forest of the nodes' links. nodes ascend."""
    planes, left, right = bit_planes(fps), [], []
    for at in range(0, len(fps), QUERIES):
        i, j = _against(fps, planes, at, min(at + QUERIES, len(fps)), radius)
        if len(i):  # each slice is thinned to a forest at once, so memory follows the nodes
            root = forest(len(fps), i, j)
            linked = np.flatnonzero(root != np.arange(len(fps)))
            left.append(root[linked]), right.append(linked)
    if not left:
        return nodes[:0], nodes[:0]
    root = forest(len(fps), np.concatenate(left), np.concatenate(right))
    linked = root != np.arange(len(fps))
    return nodes[root][linked], nodes[linked]


def _compare(radius: int):
    """Over rows (mask, key, fp, node) sorted by bucket: the edges (a, b) of each block's spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 4
        for b in itertools.chain(batches, [None]):
            cols = rest if b is None else [np.concatenate([r, b.column(k).to_numpy()]) for k, r in enumerate(rest)]
            n = len(cols[0])
            if not n:
                continue
            starts = np.flatnonzero(np.append(True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)))  # of buckets
            ends = np.append(starts[1:], n)
            usable = len(starts) if b is None else len(starts) - 1  # the last bucket may go on in the next batch
            at = 0
            while at < usable:
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
                to = min(to, usable)
                # Buckets of one node need no comparison.
                take = np.concatenate([np.arange(s, e) for s, e in zip(starts[at:to], ends[at:to], strict=True) if e - s > 1] or [np.empty(0, np.int64)])
                if len(take):
                    nodes, first = np.unique(cols[3][take], return_index=True)  # a node can be in several buckets of a block
                    left, right = block_edges(cols[2][take][first].view(np.uint64), nodes, radius)
                    if len(left):
                        yield pa.RecordBatch.from_pydict({"a": left, "b": right})
                at = to
            keep = starts[usable] if usable < len(starts) else n
            rest = [c[keep:] for c in cols]

    return run


# ------------------------------------------------------------------------------------------------- candidates


def parts_of(bits: list[int], parts: int) -> list[list[int]]:
    parts = min(parts, len(bits))
    return [bits[len(bits) * k // parts : len(bits) * (k + 1) // parts] for k in range(parts)]


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def first_masks(radius: int, agree: int = 2) -> list[int]:
    """Masks of every choice of agree parts out of radius + agree: two fingerprints within the radius agree on one of these masks."""
    parts = parts_of(list(range(BITS)), radius + agree)
    return [mask_of(sum(c, [])) for c in itertools.combinations(parts, agree)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """The mask with one more part of its free bits, for each of radius + 1 parts."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    if len(free) <= radius:
        return [mask]
    return [mask_of([b for b in range(BITS) if mask >> b & 1] + p) for p in parts_of(free, radius + 1)]


def links(nodes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect nodes (fp, node) exactly as all pairs within the radius would. fp and node are unique."""
    spark = nodes.sparkSession
    fields = ["fp", "node"]
    masks = first_masks(radius)
    rows = nodes.select(F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"), *fields)
    rows = rows.withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))
    made = None
    while True:
        sizes = rows.groupBy("mask", "key").count()
        few = cut(sizes.where(F.col("count") > 1))
        whole = [m for m in masks if finer_masks(m, radius) == [m]]
        too_big = (F.col("count") > bucket) & ~F.col("mask").isin(whole)
        big = few.where(too_big)
        has_big = bool(big.take(1))
        small = rows.join(few.where(~too_big).select("mask", "key"), ["mask", "key"], "left_semi")
        dealt = small.select("mask", "key", *fields).repartition("mask", "key").sortWithinPartitions("mask", "key")
        edges = dealt.mapInArrow(_compare(radius), "a long, b long")
        made = edges if made is None else made.unionByName(edges)
        if not has_big:
            return made
        children = {m: finer_masks(m, radius) for m in masks if m not in whole}
        masks = sorted({c for cs in children.values() for c in cs})
        finer = spark.createDataFrame([(m, c) for m, cs in children.items() for c in cs], "mask long, child long")
        rows = spread_join(rows, big, ["mask", "key"], "count", rows.count(), "left_semi").join(F.broadcast(finer), "mask").select(F.col("child").alias("mask"), *fields).distinct()  # masks can share a child
        rows = cut(rows.withColumn("key", F.col("mask").bitwiseAND(F.col("fp"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternating star rounds: large-star hangs each larger neighbour on the smallest neighbour, small-star the node and its smaller
    neighbours. Each is a partial minimum and an equi-join that spreads the edges of a node with many, so no node's neighbours are gathered. Ends when nothing moves.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        n = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("_n"))
        large = spread_join(both.where("v > u"), low, ["u"], "_n", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = spread_join(large, low, ["u"], "_n", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("v")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component): one row per row of docs; component is the smallest id of the linked documents, its own included.

    Ids are whole numbers. Null texts count as empty; texts without words have fingerprint zero, which links like any other. Rows with a
    null id get their fingerprint and a null component and link nothing. Where ids repeat, each row goes by its own text, and a component's id is the
    smallest of its rows. Repeated rows come back as often as they are there. An empty frame gives an empty frame.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(fps.where("id is not null").groupBy("fp").agg(F.min("id").cast("long").alias("least"), F.count("*").alias("copies")))  # a node is a fingerprint
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), radius, bucket)).withColumnRenamed("node", "fp")
    named = cut(nodes.join(found, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component"))
    lows = named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("_n"))
    labels = cut(spread_join(named, lows, ["root"], "_n", named.count()).select("fp", "component", "copies"))
    out = spread_join(fps, labels, ["fp"], "copies", fps.count(), "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


# ------------------------------------------------------------------------------------------------- the query


def hex16(fp: Column) -> Column:
    """A signed 64-bit number as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
