"""Nearest neighbours against brute force, for all physical plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import retrieval
from caseloom.sources import knowledge_base as kbs

PLANS = {"broadcast": {}, "tiles": {"broadcast_bytes": 0, "tile_rows": 16}, "pruned": {"broadcast_bytes": 0}}
QUEUES = ("A", "B")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    docs = rng.normal(size=(90, 7)).astype("float32")
    docs[::3] = docs[0]  # a third of all rows shares one vector
    queries = rng.normal(size=(40, 7)).astype("float32")
    queries[5] = docs[0]
    kb = [(f"d{i:03}", v.tolist(), QUEUES[i % 2], "T") for i, v in enumerate(docs)]
    kb.append(("none", None, "A", "T"))
    q = [
        (i, v.tolist(), [None, "", "A", "B", "missing"][i % 5], "T" if i % 2 else None)
        for i, v in enumerate(queries)
    ]
    q.append((999, None, None, None))
    kb_df = spark.createDataFrame(kb, "doc_id string, embedding array<float>, queue string, type string")
    q_df = spark.createDataFrame(
        q, "query_id long, embedding array<float>, queue_filter string, type_filter string"
    )
    return kb_df, q_df, docs.astype(float), queries.astype(float)


def brute(docs, query, k, metric, allowed):
    if metric == "l2sq":
        d = [sum((query[j] - v[j]) ** 2 for j in range(len(query))) for v in docs]
    else:
        d = [1 - query @ v / (np.linalg.norm(query) * np.linalg.norm(v)) for v in docs]
    order = sorted((i for i in range(len(docs)) if allowed(i)), key=lambda i: (round(d[i], 12), i))
    return [(f"d{i:03}", d[i]) for i in order[:k]]


@pytest.mark.parametrize("metric", retrieval.METRICS)
@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("k", [1, 9, 200])
def test_knn_matches_brute_force(vectors, metric, plan, k):
    kb, queries, docs, raw = vectors
    rows = retrieval.knn_topk(queries, kb, k, metric=metric, **PLANS[plan]).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.doc_id, r.distance, r["rank"]))
    assert set(found) == set(range(len(raw)))
    for q, hits in found.items():
        want = brute(docs, raw[q], k, metric, lambda i: True)
        assert [h[0] for h in hits] == [w[0] for w in want]
        assert [h[2] for h in hits] == list(range(1, len(want) + 1))
        assert np.allclose([h[1] for h in hits], [w[1] for w in want], atol=1e-9)


@pytest.mark.parametrize("plan", PLANS)
def test_filters_apply_before_ranking(vectors, plan):
    kb, queries, docs, raw = vectors
    rows = retrieval.knn_topk(queries, kb, 4, match_on=("queue", "type"), **PLANS[plan]).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.doc_id)
    for q in range(len(raw)):
        wanted = [None, "", "A", "B", "missing"][q % 5]
        want = brute(docs, raw[q], 4, "l2sq", lambda i: not wanted or QUEUES[i % 2] == wanted)
        assert found.get(q, []) == [w[0] for w in want]


def test_empty_knowledge_base_and_bad_metric(vectors):
    kb, queries, *_ = vectors
    assert retrieval.knn_topk(queries, kb.filter("false"), 3).count() == 0
    assert retrieval.knn_topk(queries.filter("false"), kb, 3, broadcast_bytes=0).count() == 0
    with pytest.raises(ValueError):
        retrieval.knn_topk(queries, kb, 3, metric="dot")


def test_index_is_reusable(vectors):
    kb, queries, *_ = vectors
    index = retrieval.prepare_index(kb)
    assert (index.rows, index.dimension) == (90, 7)
    first = retrieval.knn_topk(queries.filter("query_id < 5"), index, 2).count()
    second = retrieval.knn_topk(queries.filter("query_id >= 5"), index, 2).count()
    assert first + second == 80


def test_missing_fields_become_empty_text(spark):
    kb = spark.createDataFrame(
        [("a", None, None, None, None, None, None, "t")],
        "doc_id string, issue_description string, resolution string, type string, queue string, "
        "priority string, tags array<string>, retrieval_text string",
    )
    hits = spark.createDataFrame(
        [(1, "a", 0.5, 1), (1, "gone", 0.6, 2)],
        "query_id long, doc_id string, distance double, rank int",
    )
    rows = retrieval.retrieved_incidents(hits, kb).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["a", "gone"]
    assert rows[0].queue == rows[0].issue_description == rows[0].normalized == ""
    assert rows[0].tags == []


def test_overfetch():
    assert [retrieval.overfetch_k(k) for k in (1, 2, 3, 5)] == [8, 8, 9, 15]


KB_LINES = """{"doc_id": 7, "retrieval_text": "t7", "issue_description": "i", "tags": ["a", "b"]}

{"doc_id": "x", "retrieval_text": "t", "type": "INCIDENT", "queue": "Q", "tags": "c, d"}
   
{"doc_id": "y", "retrieval_text": "u", "source": "s"}
"""


def test_kb_lines_to_incident_table(spark, tmp_path):
    source = tmp_path / "kb.jsonl"
    source.write_text(KB_LINES)
    target = str(tmp_path / "memory")

    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    kbs.rebuild_incident_memory(spark, str(source), target, encoder)
    kbs.rebuild_incident_memory(spark, str(source), target, encoder)  # a rebuild replaces
    memory = kbs.open_incident_memory(spark, target)
    rows = {r.doc_id: r for r in memory.collect()}
    assert set(rows) == {"7", "x", "y"}
    assert rows["7"].tags == ["a", "b"] and rows["x"].tags == ["c", "d"] and rows["y"].tags == []
    assert rows["7"].queue == "" and rows["y"].source == "s"
    assert rows["7"].embedding == [2.0, 1.0]
    state = kbs.verify_incident_memory(memory).first()
    assert (state.n_rows, state.n_null_vectors, state.dim_min, state.dim_max, state.probe_hits) == (
        3, 0, 2, 2, 1,
    )


def test_kb_errors(spark, tmp_path):
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n\n")
    with pytest.raises(ValueError):
        kbs.read_kb_jsonl(spark, str(empty))
    broken = tmp_path / "broken.jsonl"
    broken.write_text('{"doc_id": 1}\n{"doc_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        kbs.read_kb_jsonl(spark, str(broken), require_rows=False).agg(F.max("doc_id")).collect()
    with pytest.raises(FileNotFoundError):
        kbs.open_incident_memory(spark, str(tmp_path / "absent"))


def test_failed_rebuild_leaves_the_published_memory(spark, tmp_path):
    source = tmp_path / "kb.jsonl"
    source.write_text(KB_LINES)
    target = str(tmp_path / "memory")
    first = kbs.rebuild_incident_memory(spark, str(source), target, lambda: lambda texts: np.ones((len(texts), 2)))
    reader = kbs.open_incident_memory(spark, target)

    def broken():
        raise RuntimeError("no model")

    for encoder, error in ((broken, "no model"), (lambda: lambda texts: np.zeros((len(texts), 2)) * np.nan, "finds nothing")):
        with pytest.raises(Exception, match=error):
            kbs.rebuild_incident_memory(spark, str(source), target, encoder)
        again = kbs.open_incident_memory(spark, target)
        assert sorted(r.doc_id for r in again.collect()) == ["7", "x", "y"] and first in again.inputFiles()[0]
    source.write_text(KB_LINES + '{"doc_id": "z", "retrieval_text": "new"}')
    second = kbs.rebuild_incident_memory(spark, str(source), target, lambda: lambda texts: np.ones((len(texts), 2)))
    assert second != first and kbs.open_incident_memory(spark, target).count() == 4
    assert reader.count() == 3  # who had opened the first version still reads it
    assert kbs.check_incident_memory(spark, target).first().valid


def test_memory_by_a_fitted_encoder(spark, tmp_path):
    from caseloom.operators.encoder import fit_encoder

    source = tmp_path / "kb.jsonl"
    source.write_text("\n".join(f'{{"doc_id": "d{i}", "retrieval_text": "login case {i % 3}"}}' for i in range(9)))
    fitted = fit_encoder(kbs.read_kb_jsonl(spark, str(source)), "retrieval_text", dimensions=2)
    kbs.rebuild_incident_memory(spark, str(source), str(tmp_path / "memory"), fitted)
    memory = kbs.open_incident_memory(spark, str(tmp_path / "memory"))
    assert kbs.verify_incident_memory(memory).first().dim_min == 2
