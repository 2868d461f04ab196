import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import near_copies as N
from millrace.llm import simhash as S


def slow_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(ids, linked):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_fingerprints():
    for t in ["", "a", "A b", "a b c", "Ä b c d e É", "x " * 999, "q\x0bq\x0cq q"]:
        assert S.fingerprint(t.encode()) == slow_fingerprint(t)


def test_bit_slices_against_popcounts():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.concatenate([base] + [base ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, k, replace=False)) for k in range(1, 12)])
    for radius in (0, 1, 2, 3, 4, 7, 9):
        got = set(zip(*map(list, S.within_radius(fps, radius)), strict=True))
        assert got == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}


def test_masks_miss_nothing():
    rng = np.random.default_rng(2)
    for radius in (3, 9):
        masks = S.first_masks(radius)
        for _ in range(200):
            x = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            m = next(m for m in masks if not x & m & (2**64 - 1))
            while (finer := S.finer_masks(m, radius)) != [m]:
                m = next(f for f in finer if not x & f & (2**64 - 1))


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = {i: slow_fingerprint(t) for i, t in docs}
    ids = sorted(fps)
    want = slow_components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op5_simhash(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_small_buckets_give_the_same(spark):
    """Buckets that have to be cut again and again: near fingerprints in a chain."""
    fps, x = [], 0x123456789ABCDEF0
    rng = np.random.default_rng(5)
    for _ in range(60):
        fps.append(x - 2**64 if x >> 63 else x)
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(fps))], "fp long, node long")
    for bucket in (3, 10_000):
        got = S.components(S.links(nodes, 3, bucket)).collect()
        assert {r.component for r in got} == {0} and len(got) == len(set(fps))


def test_edge_cases(spark):
    rows = [(4, None), (2, ""), (9, " \t"), (7, "one two"), (7, "one two"), (None, "one two"), (5, "x " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component int")
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.id, r.component) for r in got} == {(4, 2), (2, 2), (9, 2), (7, 7), (None, None), (5, 5)}
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_under_two_texts(spark, monkeypatch):
    """Nodes are fingerprints: an id that stands under two of them links neither to the other's neighbours."""
    values = [(0, 7), (1, 8), (0xFF00, 7), (0xFF03, 9), (0xF0F0F0, 20), (0xF0F0F1, 21)]
    monkeypatch.setattr(S, "fingerprints", lambda docs, *_: docs.select("id", "fp"))
    got = S.near_duplicates(spark.createDataFrame([(i, f) for f, i in values], "id long, fp long")).collect()
    assert {(r.id, r.fp, r.component) for r in got} == {(7, 0, 7), (8, 1, 7), (7, 0xFF00, 7), (9, 0xFF03, 7), (20, 0xF0F0F0, 20), (21, 0xF0F0F1, 20)}


def test_near_copies_by_similarity(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    base, rows, group = words(200), [], {}
    for i in range(40):  # a group of many copies, each with a word changed
        w = list(base)
        w[int(rng.integers(0, 200))] = f"new{i}"
        rows.append((i, " ".join(w)))
        group[i] = 0
    shared = words(60)
    for i in range(40, 60):  # clean texts that share a passage
        rows.append((i, " ".join(shared + words(140))))
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = slow_components(list(sets), linked)
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    kept = {r.doc_id for r in N.representatives(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c} | {None}
    assert {i for i in range(40, 60)} <= kept
    assert N.representatives(docs.limit(0)).count() == 0


def test_hex(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,)], "fp long")
    assert [r[0] for r in df.select(S.hex16(F.col("fp"))).collect()] == ["0" * 16, "f" * 16, "00000000000000ff"]


def jaccard_groups(rows):
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    return slow_components(list(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])


def test_near_copies_by_block_edits(spark):
    """Copies that differ in one passage, on either side of 0.8: their shingle sets decide, not an estimate."""
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = []
    for i in range(0, 120, 2):
        base, at, n = words(300), int(rng.integers(0, 250)), int(rng.integers(15, 45))
        rows += [(i, " ".join(base)), (i + 1, " ".join(base[:at] + words(n) + base[at + n :]))]
    want = jaccard_groups(rows)
    assert 20 < sum(i != c for i, c in want.items()) < 50
    got = {r.doc_id for r in N.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, c in want.items() if i == c}


def test_near_copies_share_a_bucket_but_are_none(spark, interpreted):
    """Nodes of common buckets that no star connects: several rounds."""
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    base, rows = words(200), []
    for i in range(90):
        w = list(base)
        for at in rng.choice(200, int(rng.integers(2, 6)), replace=False):
            w[int(at)] = f"new{i}-{at}"
        rows.append((i, " ".join(w)))
    want = jaccard_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 2048):  # grids of blocks, and whole buckets
        assert {r.doc_id for r in N.representatives(docs, block=block).collect()} == {i for i, c in want.items() if i == c}


def test_dense_buckets_end(spark, monkeypatch):
    """All fingerprints of a subcube of as many bits as the radius: no cut parts them into buckets of 3."""
    monkeypatch.setattr(S, "first_masks", lambda radius: [S.mask_of(list(range(3, 64)))])
    nodes = spark.createDataFrame([(x, x) for x in range(8)], "fp long, node long")
    got = S.components(S.links(nodes, 3, 3)).collect()
    assert {(r.node, r.component) for r in got} == {(x, 0) for x in range(8)}


def test_near_copies_of_one_fingerprint(spark):
    """Many near copies whose 64-bit fingerprints are one: the group is settled by a few pairs of each member."""
    base, n = [f"w{x}" for x in range(400)], 300
    rows = [(i, " ".join([*base[:200], f"new{i}", *base[201:]])) for i in range(n)]
    assert len({S.fingerprint(t.encode()) for _, t in rows}) < n / 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in N.representatives(docs).collect()] == [0]


def test_repeated_ids_keep_other_texts(spark):
    """A near copy and an unrelated text under one id: only the near copy goes."""
    base = [f"w{x}" for x in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "new"])), (2, " ".join(f"v{x}" for x in range(200)))]
    got = [(r.doc_id, r.text) for r in N.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted([rows[0], rows[2]])
