"""Search by issue text: vectors, neighbours and triage from texts alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import encoder as enc
from caseloom.plans import text_search
from caseloom.plans import triage as T

WORDS = {"login": "login password account locked reset", "pay": "invoice payment refund card gateway", "slow": "slow timeout latency pages cache"}


@pytest.fixture(scope="module")
def incidents(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        topic = sorted(WORDS)[i % 3]
        text = " ".join(rng.choices(WORDS[topic].split(), k=6)) + f" case{i % 20}"
        rows.append((f"d{i:03}", text, "s", text, "fix", "INCIDENT", "QQ", ["HIGH", "MEDIUM", "LOW"][i % 3], [topic]))
    rows.append(("none", None, "s", None, None, None, None, None, None))
    schema = "doc_id string, retrieval_text string, source string, issue_description string, resolution string, type string, queue string, priority string, tags array<string>"
    return spark.createDataFrame(rows, schema)


def test_tickets_find_incidents_by_their_words(spark, incidents):
    memory = text_search.build_text_memory(incidents, dimensions=8)
    issues = ["password reset and login", "refund for invoice by card", "pages slow with timeout", "zzz qqq xxx", None]
    rows = [(10 * i + j, issue, " incident", "zz ", "LOW") for i, issue in enumerate(issues) for j in range(2)]
    tickets = spark.createDataFrame(rows, "ticket_id long, issue string, type string, queue string, ml_priority string")
    asked, candidates = text_search.requests_and_candidates(tickets, memory)
    assert candidates.count() <= len(issues)  # one search for equal texts
    out = {r.ticket_id: r for r in T.predict_and_retrieve(asked, candidates).collect()}
    assert len(out) == len(rows)
    texts = {r.doc_id: r.retrieval_text for r in incidents.collect()}
    vectors = {r.doc_id: np.array(r.embedding, float) for r in enc.encode(incidents, memory.encoder, "retrieval_text").collect()}
    queries = enc.encode(asked.select("ticket_id", "query_key"), memory.encoder, "query_key").collect()
    for q in queries:
        found = [(c.doc_id, c.distance) for c in out[q.ticket_id].retrieved_incidents]
        mine = np.array(q.embedding, float)
        if not mine.any():
            assert found == []
            continue
        near = {d: 1 - mine @ v / (np.linalg.norm(mine) * np.linalg.norm(v)) for d, v in vectors.items() if v.any()}
        want = sorted(near.items(), key=lambda x: (round(x[1], 12), x[0]))[:9]
        assert np.allclose([d for _, d in found], [d for _, d in want], atol=1e-9)
    for i, topic in enumerate(("login", "pay", "slow")):
        for c in out[10 * i].retrieved_incidents:
            assert set(WORDS[topic].split()) & set(texts[c.doc_id].split())


def test_equal_vectors_share_a_search(spark, incidents):
    memory = text_search.build_text_memory(incidents, dimensions=8)
    issues = ["password reset and login", "refund for invoice by card", "zzz"]
    rows = [(i, f"{issues[i % 3]} account{i}", "INCIDENT", "ZZ", "LOW") for i in range(30)]
    tickets = spark.createDataFrame(rows, "ticket_id long, issue string, type string, queue string, ml_priority string")
    asked, candidates = text_search.requests_and_candidates(tickets, memory)
    assert candidates.count() <= len(issues)  # account numbers are no known words
    out = {r.ticket_id: r for r in T.predict_and_retrieve(asked, candidates).collect()}
    assert sorted(out) == list(range(30))
    for i, row in out.items():
        assert f"account{i}" in row.retrieval_query and row.issue_description == rows[i][1]
        assert row.retrieved_incidents == out[i % 3].retrieved_incidents


def test_incidents_are_computed_once(spark, incidents):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    memory = text_search.build_text_memory(incidents.mapInArrow(counted, incidents.schema), dimensions=8)
    assert memory.index.rows == 240 and memory.incidents.count() == 241
    assert seen.value == 241


def test_triage_by_text(spark, incidents):
    memory = text_search.build_text_memory(incidents, dimensions=8)
    rows = [(1, "password reset and login", "INCIDENT", "QQ", "LOW"), (2, "", "INCIDENT", "QQ", "LOW")]
    tickets = spark.createDataFrame(rows, "ticket_id long, issue string, type string, queue string, ml_priority string")
    out = {r.ticket_id: r for r in T.triage(*text_search.requests_and_candidates(tickets, memory)).collect()}
    assert len(out[1].evidence) == 3 and all(e.tags == ["login"] for e in out[1].evidence)
    nothing = text_search.build_text_memory(incidents.filter(F.lit(False)))
    assert all(r.evidence == [] for r in T.triage(*text_search.requests_and_candidates(tickets, nothing)).collect())
