"""What a search costs: it runs once for all that read its hits, and equal vectors are searched once."""

import numpy as np
import pandas as pd
import pytest

from caseloom.operators import metric_index, retrieval

KB = (
    "doc_id string, issue_description string, resolution string, type string, queue string, priority string, "
    "tags array<string>, retrieval_text string"
)


def test_hits_are_computed_once(spark):
    searched = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            searched.add(len(batch))
            yield batch

    hits = spark.createDataFrame(
        [(q, f"d{q % 3}", 0.5, 1) for q in range(40)], "query_id long, doc_id string, distance double, rank int"
    )
    kb = spark.createDataFrame([(f"d{i}", "text", "r", "INCIDENT", "Q", "LOW", ["a"], "text") for i in range(2)], KB)
    found = retrieval.retrieved_incidents(hits.mapInPandas(counted, hits.schema), kb).collect()
    assert len(found) == 40 and sum(r.issue_description == "text" for r in found) == 27
    assert searched.value == 40


@pytest.mark.parametrize("metric", retrieval.METRICS)
@pytest.mark.parametrize("match_on", [(), ("queue",)])
def test_equal_vectors_are_searched_once(monkeypatch, metric, match_on):
    rng = np.random.default_rng(3)
    distinct = np.concatenate([rng.normal(size=(60, 8)), np.zeros((1, 8)), np.full((1, 8), np.nan)])
    of = np.concatenate([rng.integers(0, 62, 900), np.zeros(40, int)])
    docs = pd.DataFrame({"doc_id": [f"d{i:04}" for i in range(940)], "embedding": list(distinct[of]), "queue": [f"q{i % 2}" for i in range(940)]})
    asked = pd.DataFrame({"query_id": range(30), "embedding": list(distinct[:30]), "queue_filter": [(None, "q0", "q1")[i % 3] for i in range(30)]})
    met, best = [], retrieval._best

    def counted(queries, docs, *more):
        met.append(len(docs))
        return best(queries, docs, *more)

    monkeypatch.setattr(retrieval, "_best", counted)
    got = retrieval._search(asked, retrieval._Tile(docs, match_on), 50, metric, match_on)
    assert max(met) <= 62 + 60  # a vector of nothing equals none
    want = []
    for q in range(30):
        wanted = asked["queue_filter"][q] if match_on else None
        rows = [i for i in range(940) if wanted is None or docs["queue"][i] == wanted]
        far = retrieval._distances(np.repeat(distinct[q : q + 1], len(rows), 0), distinct[of[rows]], metric)
        near = sorted((d, docs["doc_id"][i]) for d, i in zip(far, rows) if np.isfinite(d))[:50]
        want += [(q, r + 1, doc, d) for r, (d, doc) in enumerate(near)]
    assert sorted(got[["query_id", "rank", "doc_id", "distance"]].itertuples(index=False, name=None)) == want


def test_a_large_index_is_built_once(spark, monkeypatch):
    rows = [(f"d{i}", [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    kb = spark.createDataFrame(rows, "doc_id string, embedding array<float>")
    queries = kb.selectExpr("doc_id AS query_id", "embedding")
    built, build = [], metric_index.build_metric_index
    monkeypatch.setattr(metric_index, "build_metric_index", lambda *a, **b: built.append(a) or build(*a, **b))
    index = retrieval.prepare_index(kb, broadcast_bytes=0)
    order = ["query_id", "rank"]
    once, again = (retrieval.knn_topk(queries, index, 4, metric="cosine").orderBy(order).collect() for _ in range(2))
    assert len(built) == 1 and once == again
    assert once == retrieval.knn_topk(queries, kb, 4, metric="cosine").orderBy(order).collect()
