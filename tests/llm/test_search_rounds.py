"""The vector search in rounds: the same best rows, and few rows sent."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import topk_search as t
from millrace.llm.common import cut


def test_rows_sent_do_not_grow_with_tasks(spark):
    values = np.random.default_rng(3).integers(-200, 200, (2560, 8))
    df = spark.createDataFrame([(i, [float(x) / 256 for x in v], i, "x") for i, v in enumerate(values)], "vec_id long, embedding array<double>, id int, h string")
    n, classes = 6, cut(t.vector_classes(t.integer_vectors(df, "vec_id", "embedding"), 5))
    limits = t.cell_limits(classes, 7)
    file = cut(t.approximation_file(classes, limits).repartitionByRange(64, "h"))
    queries = file.where(F.exists("ids", lambda i: i % 50 == 0)).collect()
    batch = {8: ([bytes(r.h) for r in queries], [bytes(r.exact) for r in queries])}
    best = lambda df: {bytes(r.qh): sorted((h.score for h in r.hits), reverse=True)[:n] for r in df.groupBy("qh").agg(F.collect_list(F.struct("score")).alias("hits")).collect()}
    rounds = t.in_rounds(file, 64, first=1)
    assert len(rounds) == 3 and sum(r.count() for r in rounds) == 2560
    sent = t.batch_hits(rounds, limits, batch, n)
    want = {}
    for i in range(0, 2560, 50):
        scores = sorted((int(x) for x in values @ values[i]), reverse=True)
        want[next(bytes(r.h) for r in queries if i in r.ids)] = scores[:n]
    assert best(sent) == want
    once = [f.repartition(64) for f in [file.select("dim", "ids", "codes", "exact")]]
    every = t.batch_hits(once, limits, batch, n)
    assert best(every) == want and every.count() == 64 * len(queries) * n
    assert sent.count() < every.count() / 3


def test_floors_keep_ties(spark):
    """Many vectors of one score: all rounds' ties go to the smaller ids, with clashing names and no rows, too."""
    rows = [(i, [1.0, float(i % 7 == 0) * 0.0, float(i) / 256]) for i in range(400)]
    df = spark.createDataFrame([(i, v[:2] + [0.0 if i % 3 else v[2] * 0], i) for i, v in rows], "vec_id long, embedding array<double>, score long")
    got = [tuple(r) for r in t.exact_top_k(df, "vec_id", "embedding", F.pmod(F.col("id"), F.lit(50)) == 0, 5).collect()]
    want = [(q, k + 1, i, 65536) for q in range(0, 400, 50) for k, i in enumerate([i for i in range(7) if i != q][:5])]
    assert sorted(got) == sorted(want)
    assert t.exact_top_k(df.limit(0), "vec_id", "embedding", F.col("id") == 0).count() == 0
