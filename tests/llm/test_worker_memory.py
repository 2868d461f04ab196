import numpy as np
import pyarrow as pa

from millrace.llm import common, toxicity, word_tokens


def test_batches_of_texts_are_bounded_by_bytes(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('some words ', 1000) AS text")  # 33 MB, which would be a single batch

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    got = common.map_arrow(docs, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 1.1 * common.ARROW_BYTES


def test_workers_give_memory_back_after_a_task(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id", "'you idiot' AS text")
    made = word_tokens.map_ids(docs, "text", ["id"], lambda: lambda own, ids: own, "id long"), toxicity._rows(docs, ["id"], lambda: lambda own, texts: own, "id long")
    for frame in made:
        assert {r.id for r in frame.collect()} == set(range(40))
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    seen = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.append(run))
    common.map_arrow(docs, lambda batches: batches, "id long")
    assert list(seen[0](iter([1, 2]))) == [1, 2] and calls == [1]


def test_memory_that_is_not_used_goes_back():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) / 1024

    common.give_back()
    before = held()
    parts = [pa.array(np.arange(1 << 16)) for _ in range(1)] + [pa.concat_arrays([pa.array(np.arange(1 << 19)), pa.array(np.arange(1 << 19))]) for _ in range(20)]  # 160 MB
    assert held() > before + 100
    del parts
    common.give_back()
    assert held() < before + 60
