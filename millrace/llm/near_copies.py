"""Near copies of texts: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. The sets decide.

1. Min-hash bands give buckets of candidates; only (bucket, node) is shuffled, and only buckets of two nodes or more go on.
2. A bucket's nodes meet with their sets (thin 32-bit hashes) and a sketch of one bit for each minimum. The bit-sliced comparison of
   simhash.py takes all pairs of nodes too far apart out; the sets of the others are compared, but for pairs that are connected already.
3. A bucket gives the edges of a spanning forest, never its pairs. The first of two rounds takes some of the buckets; its components settle
   most of the others, which need no comparison where all their nodes are connected.

A bucket too large for a task is dealt as a grid of blocks, every two of which meet in a task of their own, but for blocks of one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, slices, spread_join
from .exact_dedup import without
from .simhash import QUERIES, SEED, _against, bit_planes, components
from .url_filter import bloom_filter, might_contain

#: Near copies share SAME or more of their shingles of SHINGLE words.
SAME, SHINGLE = 0.8, 5
#: Candidates share all minima of a band: a pair at 0.8 shares none of the bands with a chance of (1 - 0.8 ** 4) ** 40 = 7e-10, less above 0.8.
BANDS, MINIMA = 40, 4
#: A sketch has a bit of each minimum. A pair at 0.8 differs in 16 of the 160, give or take 3.8, and in more than SKETCH_RADIUS with a chance of 6e-8.
SKETCH_RADIUS = 36
SKETCH = ["s0", "s1", "s2"]
#: One in FIRST buckets is looked at in the first round.
FIRST = 8
#: The size of a task's bucket or block, in nodes; a set of more than SET_UNIT shingles counts as several. Beyond it buckets become grids.
BLOCK, SET_UNIT = 2048, 4096
#: Nodes of small buckets that are compared as one block.
SHARED = 512
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (3, BANDS * MINIMA), np.uint64) | np.array([[1], [0], [1]], np.uint64)


# ------------------------------------------------------------------------------------------------- sets and bands


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles (fewer words: the whole sequence; none: the empty set)."""
    words = text.lower().split()
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))) if len(words) > size else {b" ".join(words)} if words else set()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash by each of BANDS * MINIMA orders."""
    out = np.full(BANDS * MINIMA, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(out, ((hashes[at : at + 256, None] ^ _MIX[1]) * _MIX[0]).min(axis=0), out=out)
    return out


def node_of(hashes: np.ndarray) -> int:
    """The name of a set: a signed hash of it."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED) - 2**63


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _id(id_col: str) -> Column:
    return F.col(id_col).cast("long")


def min_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, node, bands) of rows with an id; node names the shingle set. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            nodes, keys = [], []
            for t in b.column(2):
                hashes = shingle_set((t.as_py() or "").encode())
                low = minima(hashes)
                nodes.append(node_of(hashes))
                keys += [xxhash.xxh3_64_intdigest(low[k : k + MINIMA].tobytes(), k) for k in range(0, BANDS * MINIMA, MINIMA)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), bands], ["id", "text_hash", "node", "bands"])

    text = _text(text_col)
    rows = docs.where(F.col(id_col).isNotNull()).select(_id(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_arrow(rows, run, "id long, text_hash long, node long, bands array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, owners: DataFrame) -> DataFrame:
    """(node, size, data, s0 ..): at least the sets of the documents whose ids are in owners (id), each once. A Bloom filter of bounded size picks the texts where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            sets = [shingle_set((t.as_py() or "").encode()) for t in b.column(0)]
            low = np.array([minima(h) for h in sets], np.uint64).reshape(-1, BANDS * MINIMA)
            bits = ((low ^ low >> np.uint64(29)) * _MIX[2] >> np.uint64(63)).astype(np.uint8)
            sketch = np.packbits(np.pad(bits, ((0, 0), (0, 64 * len(SKETCH) - bits.shape[1]))), axis=1).view(np.int64).reshape(-1, len(SKETCH))
            thin = [np.unique(h >> np.uint64(32)).astype("<u4") for h in sets]
            cols = [pa.array([node_of(h) for h in sets], pa.int64()), pa.array([len(h) for h in thin], pa.int64()), pa.array([h.tobytes() for h in thin], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(w)) for w in sketch.T]], ["node", "size", "data", *SKETCH])

    name = owners.select(F.col("id").cast("string").alias("k"))
    may = might_contain(_id(id_col).cast("string"), *bloom_filter(name, "k", owners.count()))
    rows = docs.where(F.col(id_col).isNotNull()).where(may).select(_text(text_col).alias("text"))
    made = map_arrow(rows, run, ", ".join(["node long", "size long", "data binary", *[f"{w} long" for w in SKETCH]]))
    return made.dropDuplicates(["node"])


# --------------------------------------------------------------------------------------------------- comparison


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets of rows that are sorted by their first column; small buckets share a block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        key = b.column(0).to_numpy()
        if sum(x.num_rows for x in held) < SHARED or held[0].column(0)[0].as_py() == key[-1]:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows.column(0).to_numpy()
        start, end = 0, int(np.searchsorted(key != key[-1], False))  # the last bucket may go on in the next batch
        for at in np.flatnonzero(np.append(key[1 : end + 1] != key[:end], True)[:end]) + 1:
            if at - start >= SHARED or at == end:
                yield rows.slice(start, at - start)
                start = at
        held = rows.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (g, side, node, label, size, data, s0 ..) sorted by bucket g: edges (a, b) of nodes whose sets are near copies, a forest over the labels. Nodes of side 1 meet those of side 2 alone."""
    for rows in _blocks(batches):
        g, side, node, label, size = (rows.column(k).to_numpy() for k in range(5))
        data = rows.column(5)
        sets: dict[int, np.ndarray] = {}

        def of(i: int, data=data, sets=sets) -> np.ndarray:
            if i not in sets:
                sets[i] = np.frombuffer(data[i].as_py(), "<u4")
            return sets[i]

        sketch = np.stack([rows.column(6 + k).to_numpy().view(np.uint64) for k in range(len(SKETCH))], axis=1)
        planes, root, left, right = bit_planes(sketch), np.unique(label, return_inverse=True)[1], [], []
        for at in range(0, len(g), QUERIES):
            i, j = _against(sketch, planes, at, min(at + QUERIES, len(g)), SKETCH_RADIUS)
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            open_ = (g[i] == g[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (root[i] != root[j]) & (5 * small >= 4 * large)
            i, j = i[open_], j[open_]
            for a in np.unique(i):
                other = j[i == a]
                other = other[root[other] != root[a]]
                if not len(other):
                    continue
                own, theirs = of(a), [of(b) for b in other]
                every = np.concatenate(theirs)
                hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                both = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum([len(x) for x in theirs])[:-1]))
                for b in other[9 * both >= 4 * (len(own) + size[other])]:  # both / (a + b - both) >= 4 / 5
                    if root[a] != root[b]:
                        root[root == root[b]] = root[a]
                        left.append(node[a]), right.append(node[b])
        if left:
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def tasks(rows: DataFrame, block: int) -> DataFrame:
    """(g, side, node, label): the nodes of rows (key, node, label, w) that meet in one task, for each two nodes of a bucket with different labels."""
    keys = cut(rows.groupBy("key").agg(F.count("*").alias("_n"), F.sum("w").alias("weight"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").drop("low", "high"))
    rows = cut(spread_join(rows, keys, ["key"], "_n", rows.count()))
    small = rows.where(F.col("weight") <= block).select(F.col("key").alias("g"), F.lit(0).alias("side"), "node", "label")
    big = rows.where(F.col("weight") > block)
    if not big.take(1):
        return small
    # A label with many nodes in a bucket has blocks of its own, which need not meet each other; all others share blocks.
    labels = big.groupBy("key", "label").agg(F.sum("w").alias("c"), F.count("*").alias("_n")).withColumn("own", F.col("c") > block / 2)
    shared = labels.where(~F.col("own")).groupBy("key").agg(F.sum("c").alias("rest"))
    labels = labels.join(shared, "key", "left").withColumn("parts", F.ceil(F.when(F.col("own"), F.col("c")).otherwise(F.col("rest")) / block))
    big = spread_join(big, cut(labels.select("key", "label", "own", "parts", "_n")), ["key", "label"], "_n", big.count())
    big = big.withColumn("lab", F.when(F.col("own"), F.col("label"))).withColumn("bid", F.xxhash64("key", "lab", F.pmod(F.xxhash64("node"), F.col("parts"))))
    big = cut(big.select("key", "node", "label", "lab", "bid"))
    blocks = big.select("key", "lab", "bid").distinct()
    other = blocks.select("key", F.col("lab").alias("lab2"), F.col("bid").alias("bid2"))
    met = blocks.join(other, "key").where("bid <= bid2 and not coalesce(lab = lab2, false)").select("bid", "bid2", F.xxhash64("bid", "bid2").alias("g"))  # of blocks, not of rows
    end = lambda bid, side: F.struct(F.col(bid).alias("bid"), F.lit(side).alias("side"))
    sent = met.select("g", F.explode(F.when(F.col("bid") == F.col("bid2"), F.array(end("bid", 0))).otherwise(F.array(end("bid", 1), end("bid2", 2)))).alias("e")).select("g", "e.bid", "e.side")
    return small.unionByName(big.join(sent, "bid").select("g", "side", "node", "label"))


def near_labels(docs: DataFrame, id_col: str, text_col: str, marks: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """(node, component) of the nodes of marks (see min_hashes) that have a near copy; None where no bucket has two nodes."""
    nodes = marks.groupBy("node").agg(F.first("bands").alias("bands"))
    every = cut(nodes.select("node", F.explode("bands").alias("key")))
    many = cut(every.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"))
    shared = cut(spread_join(every, many, ["key"], "_n", every.count(), "left_semi"))
    if not shared.take(1):
        return None
    owners = marks.groupBy("node").agg(F.min("id").alias("id")).join(shared.select("node").distinct(), "node", "left_semi")
    sets = cut(shingle_sets(docs, id_col, text_col, cut(owners.select("id").distinct())))
    weight = (1 + F.floor(F.col("size") / SET_UNIT)).alias("w")
    rows = cut(shared.join(sets.select("node", weight), "node"))
    first = F.pmod("key", F.lit(FIRST)) == 0
    edges = found = None
    for part in (first, ~first):
        named = rows.where(part)
        named = named.withColumn("label", F.col("node")) if found is None else named.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        dealt = tasks(cut(named), block).join(sets, "node").select("g", "side", "node", "label", "size", "data", *SKETCH)
        made = cut(map_arrow(dealt.repartition("g").sortWithinPartitions("g"), _forest, "a long, b long"))
        edges = made if edges is None else edges.unionByName(made)
        found = cut(components(edges))
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, text_hash, component, keep): for every document with an id its group of near copies, and whether it is the one that stays: the one with the smallest id.

    Ids are whole numbers; rows with a null id take no part. Rows are told apart by id and text: where texts of a group share the smallest id, one text stays. Texts without words are copies of each other.
    """
    marks = cut(min_hashes(docs, id_col, text_col))
    found = near_labels(docs, id_col, text_col, marks, block)
    sizes = marks.groupBy("node").agg(F.count("*").alias("_n"))
    if found is None:
        sizes = sizes.withColumn("root", F.col("node"))
    else:
        sizes = sizes.join(found, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    n = marks.count()
    out = cut(spread_join(marks.select("id", "text_hash", "node"), cut(sizes), ["node"], "_n", n))
    best = cut(out.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("o"), F.count("*").alias("_n")))
    own = (F.col("id") == F.col("o.id")) & (F.col("text_hash") == F.col("o.text_hash"))
    return spread_join(out, best, ["root"], "_n", n).select("id", "text_hash", F.col("o.id").alias("component"), own.alias("keep"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay when one document of each group of near copies does: the one with the smallest id. Rows with a null id stay. Only texts that may go are shuffled."""
    gone = cut(near_copies(docs, id_col, text_col, block).where(~F.col("keep")).select(F.col("id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct())
    name = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    blocks, words = bloom_filter(gone.select(name(F.col("_gone")).alias("k")), "k", gone.count())
    return without(docs, _id(id_col), F.xxhash64(_text(text_col)), gone, lambda c: might_contain(name(c), blocks, words))
