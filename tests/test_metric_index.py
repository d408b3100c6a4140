"""Pruned search: the rows of a search through everything, and fewer pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import metric_index as mi
from caseloom.operators import retrieval


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters, a third of all rows in one point, vectors without a place, ties, filter fields with nulls."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6)) * 8
    docs = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)) * 0.3
    docs[::3] = centres[0]
    docs[1] = 0.0
    docs[2] = np.nan
    queries = centres[rng.integers(0, 12, 60)] + rng.normal(size=(60, 6)) * 0.3
    queries[0], queries[1], queries[2] = centres[0], 0.0, np.nan
    queries[3] = rng.normal(size=6) * 50
    kb = [(f"d{i:04}", v.tolist(), [None, "", "A", "B", "C"][i % 5], "T" if i % 2 else "S") for i, v in enumerate(docs)]
    asked = [(i, v.tolist(), [None, "", "A", "B", "missing"][i % 5], "T" if i % 3 else None) for i, v in enumerate(queries)]
    kb_df = spark.createDataFrame(kb + [("none", None, "A", "T")], "doc_id string, embedding array<double>, queue string, type string")
    q_df = spark.createDataFrame(asked + [(99, None, None, None)], "query_id long, embedding array<double>, queue_filter string, type_filter string")
    return kb_df.repartition(6), q_df.repartition(3)


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.distance) for r in df.collect())


@pytest.mark.parametrize(
    "metric, pivots, block_rows, k",
    [("l2sq", 1, 7, 5), ("cosine", 5, 64, 40), ("cosine", None, 1024, 5), ("l2sq", 1500, 20, 1)],
)
def test_any_index_finds_the_same_rows(clustered, metric, pivots, block_rows, k, monkeypatch):
    kb, queries = clustered
    monkeypatch.setattr(mi, "GROUP_QUERIES", 7)  # popular blocks are shared out
    index = mi.build_metric_index(kb, metric=metric, pivots=pivots, block_rows=block_rows)
    assert rows(mi.knn_pruned(queries, index, k)) == rows(retrieval.knn_topk(queries, kb, k, metric=metric))


def test_filters_choose_blocks(clustered, metric="cosine"):
    kb, queries = clustered
    fields = ("queue", "type")
    index = mi.build_metric_index(kb, fields, metric, block_rows=32)
    state = mi.search_state(queries, index, 6)
    want = rows(retrieval.knn_topk(queries, kb, 6, metric=metric, match_on=fields))
    assert rows(mi.hits_of(state)) == want
    visited = state.select("queue_filter", "type_filter", F.explode("visited").alias("number")).collect()
    lines = index.shells.value
    place = {n: i for i, n in enumerate(lines.number)}
    for r in visited:
        at = place[r.number]
        assert not r.queue_filter or lines.fields["queue"][at] == r.queue_filter
        assert not r.type_filter or lines.fields["type"][at] == r.type_filter


def test_most_pairs_never_meet(clustered):
    kb, queries = clustered
    index = mi.build_metric_index(kb, block_rows=20)
    seen = mi.visits_of(mi.search_state(queries, index, 5), index).first()
    assert seen.queries == 60 and seen.blocks == index.blocks >= 75
    assert seen.pairs_met < 0.2 * seen.pairs_in_all


def test_empty_sides_and_too_many_blocks(clustered, monkeypatch):
    kb, queries = clustered
    assert mi.knn_pruned(queries, mi.build_metric_index(kb.limit(0)), 3).count() == 0
    assert mi.knn_pruned(queries.limit(0), mi.build_metric_index(kb), 3).count() == 0
    assert mi.knn_pruned(queries, mi.build_metric_index(kb.filter("doc_id = 'd0002'")), 3).count() == 0
    monkeypatch.setattr(mi, "MAX_BLOCKS", 3)
    with pytest.raises(mi.TooManyBlocks):
        mi.build_metric_index(kb, block_rows=10)
    tiles = retrieval.knn_topk(queries, kb, 4, broadcast_bytes=0)  # goes on with tiles
    assert rows(tiles) == rows(retrieval.knn_topk(queries, kb, 4))


def test_evenly_spread_vectors_go_to_groups_once(spark, monkeypatch):
    """Where no bound excludes a block, what a query carries does not grow with the number of blocks."""
    monkeypatch.setattr(mi, "GROUP_ROWS", 200)
    rng = np.random.default_rng(4)
    docs, asked = rng.normal(size=(900, 48)), rng.normal(size=(30, 48))
    kb = spark.createDataFrame([(f"d{i:03}", v.tolist()) for i, v in enumerate(docs)], "doc_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    index = mi.build_metric_index(kb, block_rows=10)
    state = mi.search_state(queries, index, 4)
    assert rows(mi.hits_of(state)) == rows(retrieval.knn_topk(queries, kb, 4))
    seen = mi.visits_of(state, index).first()
    assert seen.pairs_met > 0.5 * seen.pairs_in_all
    assert state.agg(F.max(F.size("visited"))).first()[0] <= 20
