"""Rows must not depend on tile sizes, plans or gaps in the input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.operators import metrics, ranking, retrieval
from caseloom.plans import triage
from caseloom.sources import knowledge_base


def brute(queries, docs, k, metric):
    out = {}
    for q, x in queries:
        found = []
        for d, y in docs:
            if x is None or y is None:
                continue
            x_, y_ = np.asarray(x, float), np.asarray(y, float)
            with np.errstate(all="ignore"):
                if metric == "l2sq":
                    distance = ((x_ - y_) ** 2).sum()
                else:
                    distance = 1 - (x_ @ y_) / (np.sqrt((x_**2).sum()) * np.sqrt((y_**2).sum()))
            if np.isfinite(distance):
                found.append((distance, d))
        out[q] = [d for _, d in sorted(found)[:k]]
    return out


def odd_vectors():
    rng = np.random.default_rng(3)
    docs = [(f"d{i:02}", rng.normal(size=8).tolist()) for i in range(12)]
    docs += [(f"z{i:02}", [0.0] * 8) for i in range(15)]
    docs += [("nan", [float("nan")] * 8), ("null", None)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(6)] + [(6, [0.0] * 8), (7, None)]
    return queries, docs


@pytest.mark.parametrize("metric", retrieval.METRICS)
@pytest.mark.parametrize("plan", [{}, {"broadcast_bytes": 0, "tile_rows": 100}, {"broadcast_bytes": 0, "tile_rows": 4}])
def test_vectors_without_distance(spark, metric, plan):
    queries, docs = odd_vectors()
    hits = retrieval.knn_topk(
        spark.createDataFrame(queries, "query_id long, embedding array<double>"),
        spark.createDataFrame(docs, "doc_id string, embedding array<double>"),
        9, metric=metric, **plan,
    ).collect()
    got = {q: [h.doc_id for h in sorted((h for h in hits if h.query_id == q), key=lambda h: h.rank)] for q, _ in queries}
    assert got == brute(queries, docs, 9, metric)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e4])
@pytest.mark.parametrize("block", [7, 64, 8192])
def test_vectors_far_from_the_origin(monkeypatch, scale, block):
    rng = np.random.default_rng(5)
    docs = scale + rng.normal(size=(600, 64)) * 1e-3
    queries = scale + rng.normal(size=(20, 64)) * 1e-3
    q, d, _ = retrieval._best(queries, docs, 5, "l2sq")
    exact = retrieval._distances(np.repeat(queries, len(docs), 0), np.tile(docs, (len(queries), 1)), "l2sq")
    want = np.argsort(exact.reshape(len(queries), -1), axis=1, kind="stable")[:, :5]
    assert d.reshape(-1, 5).tolist() == want.tolist()
    parts = [retrieval._best(queries, docs[lo : lo + block], 5, "l2sq") for lo in range(0, len(docs), block)]
    merged = {i: sorted((p[2][k], p[1][k] + lo) for p, lo in zip(parts, range(0, len(docs), block)) for k in np.flatnonzero(p[0] == i))[:5] for i in range(20)}
    assert [[x for _, x in merged[i]] for i in range(20)] == want.tolist()


def test_repeats_do_not_depend_on_rank_numbers(spark):
    kb = spark.createDataFrame(
        [(str(i), t, "r", "INCIDENT", "Q", "HIGH", ["a"], t) for i, t in enumerate(("same words", "same words", "other"))],
        "doc_id string, issue_description string, resolution string, type string, queue string, priority string, "
        "tags array<string>, retrieval_text string",
    )
    tickets = spark.createDataFrame([(1, "x", "INCIDENT", "Q", "HIGH", 1)], "ticket_id long, issue string, type string, queue string, ml_priority string, query_key long")
    chosen = []
    for first in (1, 2, 5):
        hits = spark.createDataFrame([(1, str(i), 0.1 * i, first + i) for i in range(3)], "query_id long, doc_id string, distance double, rank int")
        found = triage.retrieve_candidates(None, kb, threshold=1.0, hits=hits)
        rows = triage.select_evidence(tickets, found).select(F.transform("evidence", lambda e: e["doc_id"]).alias("ids"))
        chosen.append(rows.first().ids)
    assert chosen == [["0", "2"]] * 3


def test_candidates_can_leave_texts_out(spark):
    incidents = spark.createDataFrame(
        [(1, 1, "a", 0.5, "t", "r", "INCIDENT", "Q", "LOW", ["x"], "t", "t")],
        "query_id long, rank int, doc_id string, distance double, issue_description string, resolution string, type string, "
        "queue string, priority string, tags array<string>, retrieval_text string, normalized string",
    )
    light = ranking.candidates_per_query(incidents, 1.0, with_texts=False)
    assert not set(ranking.TEXTS) & set(light.schema["candidates"].dataType.elementType.names)


def test_confusion_matrix_takes_its_labels_from_the_rows(spark):
    rows = [("CRITICAL", "HIGH"), ("LOW", "CRITICAL"), ("LOW", "LOW")]
    matrix = metrics.confusion_matrix(spark.createDataFrame(rows, "actual_priority string, predicted_priority string"), labels=())
    assert matrix.columns == ["actual_priority", "CRITICAL", "HIGH", "LOW"]
    assert [tuple(r) for r in matrix.collect()] == [("CRITICAL", 0, 1, 0), ("LOW", 1, 0, 1)]


def test_filters_leave_what_they_match(spark):
    kb = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "queue string, type string")
    assert retrieval.filter_metadata(kb, queue="A", type="").count() == 2
    tickets = spark.createDataFrame([(1, "A", "x"), (2, None, "x"), (3, "", ""), (4, "C", "x")], "ticket_id long, queue string, type string")
    found = retrieval.matching_incidents(tickets, kb, ["queue", "type"])
    assert {r.ticket_id: r.incidents for r in found.collect()} == {1: 1, 2: 2, 3: 3, 4: 0}


def test_incident_memory_check(spark, tmp_path):
    rows = spark.createDataFrame([("1", [1.0, 0.0])], "doc_id string, embedding array<double>")
    rows.write.parquet(str(tmp_path / "there"))
    rows.limit(0).write.parquet(str(tmp_path / "empty"))
    rows.withColumn("embedding", F.lit(None).cast("array<double>")).write.parquet(str(tmp_path / "bare"))
    said = {n: tuple(knowledge_base.check_incident_memory(spark, str(tmp_path / n)).first()) for n in ("there", "empty", "bare", "none")}
    assert said["there"] == (True, "ok")
    assert not any(said[n][0] for n in ("empty", "bare", "none"))


def test_two_hundred_labels(spark):
    """All pairs occur but for one row; wide and long forms agree, and the long one waits."""
    pairs = spark.range(200 * 200).selectExpr(
        "concat('L', id div 200) AS actual_priority", "concat('L', id % 200) AS predicted_priority"
    ).filter("actual_priority <> 'L7'")
    matrix = metrics.confusion_matrix(pairs, labels=()).collect()
    assert len(matrix) == 199 and len(matrix[0]) == 201  # L7 is still predicted
    matrix = metrics.confusion_matrix(pairs).collect()
    long = {(r[0], r[1]): r[2] for r in metrics.confusion_counts(pairs).collect()}
    assert long == {(r.actual_priority, c): r[c] for r in matrix for c in r.asDict() if c != "actual_priority"}
    empty = metrics.confusion_counts(pairs.limit(0)).collect()
    assert len(empty) == 9 and all(r.n == 0 for r in empty)


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_single_precision_loses_no_neighbour(metric):
    """Rows that single precision cannot tell apart, far from the origin, and rows without a place."""
    rng = np.random.default_rng(3)
    docs = rng.normal(size=(3000, 8)) + 5.0
    docs[500:900] = docs[5] + rng.normal(size=(400, 8)) * 1e-9
    docs[7], docs[8], docs[9] = np.nan, np.inf, 0.0
    queries = np.vstack([docs[:40], docs[500:540], np.zeros((1, 8))])
    exact = retrieval._distances(np.repeat(queries, len(docs), 0), np.tile(docs, (len(queries), 1)), metric)
    exact = exact.reshape(len(queries), -1)
    q, d, distance = retrieval._best(queries, docs, 9, metric)
    bounded = retrieval._best(queries, docs, 9, metric, np.full(len(queries), 0.01))
    for i, row in enumerate(exact):
        want = [j for j in np.lexsort((np.arange(len(row)), row)) if np.isfinite(row[j])][:9]
        assert d[q == i].tolist() == want and distance[q == i].tolist() == row[want].tolist()
        near = [j for j in want if row[j] <= 0.01]
        assert bounded[1][bounded[0] == i].tolist()[: len(near)] == near


def test_tiles_meet_in_few_groups(spark, monkeypatch):
    """200 and 100 tiles would be 20,000 pairs of tiles; every task says which rows it was given."""
    kb = spark.range(400).selectExpr("cast(id as string) doc_id", "array(double(id), double(id * id % 17)) embedding")
    queries = spark.range(200).selectExpr("id query_id", "array(double(id), 1.0d) embedding")
    schema = "query_id long, doc_id string, distance double, rank int"
    monkeypatch.setattr(retrieval, "_tile_search", lambda *_: lambda q, d: pd.DataFrame(
        {"query_id": [len(q)], "doc_id": [""], "distance": [float(len(d))], "rank": [1]}
    ))
    monkeypatch.setattr(retrieval, "_hit_schema", lambda _: schema)
    met = retrieval._knn_tiles(queries, retrieval.prepare_index(kb, broadcast_bytes=0), 1000, "l2sq", 2)
    assert met.count() <= 256
