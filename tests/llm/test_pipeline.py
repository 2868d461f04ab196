import corpus_pipeline as P
import pytest

from millrace.llm import exact_dedup, secrets, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Every stage's input and output."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "exact dedup", "simhash near-dedup", "secret scans", "best-fit packing"]
    for _, _, after in stages[:-1]:
        assert after.columns == P.COLUMNS


def test_decisions_take_effect(spark, sf, stages):
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = stages
    rejected = {r.doc_id for r in a.collect()} - {r.doc_id for r in b.collect()}
    scores = {r.doc_id: r.score for r in toxicity.op4_toxicity(spark, sf).collect()}
    assert rejected == {i for i, s in scores.items() if s >= toxicity.REJECT}
    norm = lambda t: "".join(x for x in t if x not in " \t\n\r\x0b\x0c")
    best = {}
    for r in b.collect():
        best.setdefault(norm(r.text), []).append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in c.collect()} == {min(v)[1] for v in best.values()}
    sets = {r.doc_id: {tuple(r.text.lower().split()[k : k + 5]) for k in range(max(1, len(r.text.split()) - 4))} for r in c.collect()}
    kept = {r.doc_id for r in d.collect()}
    for i in set(sets) - kept:  # each dropped text has a near copy
        assert any(j != i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for j in sets)
    assert not [(i, j) for i in kept for j in kept if i < j and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    before, after = {r.doc_id: r for r in d.collect()}, {r.doc_id: r for r in e.collect()}
    assert before.keys() == after.keys() == {r.doc_id for r in f.collect()}
    assert all(after[i].n_chars == len(after[i].text) or after[i] == before[i] for i in after)
    spans = secrets.scan_secrets(e).where("size(secret_spans) > 0").count()
    assert spans == 0


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
    assert exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0
