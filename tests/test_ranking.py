"""Reranking, selection and voting: the known case, and a plain greedy as the judge."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from caseloom.functions import similarity
from caseloom.operators import ranking, voting
from caseloom.plans import triage as T
from caseloom.plans.evaluation import evaluate_cases

# The known case.  Candidates by distance, and what has to come out.
KNOWN = (
    ("incident_13638", 0.5895, "TECHNICAL SUPPORT", "HIGH", "Support Required for Authentication Login Issues..."),
    ("incident_9437", 0.6114, "CUSTOMER SERVICE", "LOW", "Customer Support Request for Login Issues..."),
    ("incident_11491", 0.6157, "TECHNICAL SUPPORT", "HIGH", "Login Issues After Recent Server Update..."),
    ("incident_15934", 0.6189, "TECHNICAL SUPPORT", "HIGH", "Support Required for Login Issues..."),
    ("incident_12932", 0.6382, "CUSTOMER SERVICE", "HIGH", "Problem with Login for User Accounts..."),
    ("incident_8567", 0.6441, "CUSTOMER SERVICE", "LOW", "Request for Assistance with Login Failures..."),
    ("incident_13080", 0.6443, "CUSTOMER SERVICE", "LOW", "Customer Support Inquiry for Login Issues..."),
    ("incident_7902", 0.6570, "TECHNICAL SUPPORT", "HIGH", "Problem with Login After Recent Updates..."),
    ("incident_12928", 0.6572, "PRODUCT SUPPORT", "MEDIUM", "Problem with Login Authentication..."),
)
KNOWN_EVIDENCE = ["incident_12932", "incident_9437", "incident_8567"]

KB_KINDS = (
    "doc_id string, issue_description string, resolution string, type string, queue string, "
    "priority string, tags array<string>, retrieval_text string"
)


def known_candidates(spark, threshold=0.88):
    kb = spark.createDataFrame(
        [(d, t, "r", "INCIDENT", q, p, ["login", " it "], t) for d, _, q, p, t in KNOWN], KB_KINDS
    )
    hits = spark.createDataFrame(
        [(1, d, x, i + 1) for i, (d, x, *_) in enumerate(KNOWN)],
        "query_id long, doc_id string, distance double, rank int",
    )
    return T.retrieve_candidates(None, kb, threshold=threshold, hits=hits)


def known_ticket(spark, key=1):
    return spark.createDataFrame(
        [(7, "Customers cannot log in", "INCIDENT", "CUSTOMER SERVICE", "HIGH", key, "case")],
        "ticket_id long, issue string, type string, queue string, ml_priority string, "
        "query_key long, name string",
    )


def test_known_case(spark):
    row = T.triage(known_ticket(spark), known_candidates(spark), debug=True).first()
    assert [e.doc_id for e in row.evidence] == KNOWN_EVIDENCE
    assert [round(e.adjusted_score, 4) for e in row.evidence] == [0.4082, 0.4114, 0.4441]
    assert row.recommended_priority == row.rag_signal_priority == "MEDIUM"
    assert (row.confidence_score, row.confidence_level) == (0.70, "Medium")
    assert all(e.tags == ["login", "it"] for e in row.evidence)
    assert "Retrieved Priorities: HIGH=1, LOW=2\n" in row.evidence_summary
    assert "Queue Match: 3/3" in row.evidence_summary and "0.6312" in row.evidence_summary
    assert [round(e.adjusted_score, 4) for e in row.reranked_incidents] == [
        0.4082, 0.4114, 0.4441, 0.4443, 0.5095, 0.5357, 0.5389, 0.5770, 0.6072,
    ]
    assert [e.adjusted_score for e in row.raw_retrieved_incidents] == [x for _, x, *_ in KNOWN]
    assert row.evidence_summary in row.prompt and "Incident #3" in row.prompt


def test_known_case_without_guardrail(spark):
    row = evaluate_cases(known_ticket(spark), known_candidates(spark)).first()
    assert row.recommended_priority_rule == "LOW" and row.same_queue_ratio == 1.0
    assert row.llm_priority == "UNKNOWN" and row.escalation == "Unknown"


def test_no_candidates(spark):
    by_missing_key = T.triage(known_ticket(spark, key=99), known_candidates(spark)).first()
    without_search = T.triage(known_ticket(spark), None, debug=True).first()
    for row in (by_missing_key, without_search):
        assert row.recommended_priority == "HIGH" and row.evidence == []
        assert (row.confidence_score, row.confidence_level) == (0.20, "Low")
    assert "Queue Match: 0/0\nRetrieved Priorities: none\nAverage Distance: N/A" in (
        without_search.evidence_summary
    )
    assert T.predict_and_retrieve(known_ticket(spark), None).first().retrieval_query == ""


def plain_norm(t):
    return re.sub(r"[^a-z0-9\s]", "", re.sub(r"\s+", " ", t.lower().strip())) if t else ""


def plain_greedy(candidates, queue, max_results, quota, threshold):
    """One candidate at a time; each at most once."""
    kept = []

    def repeated(c):
        a = plain_norm(c["text"])
        for k in kept:
            b = plain_norm(k["text"])
            if k is c or (a and b and SequenceMatcher(None, a, b).ratio() >= threshold):
                return True
        return False

    def visit(rows, limit):
        for c in rows:
            if not repeated(c):
                kept.append(c)
            if len(kept) >= limit:
                break

    if queue:
        visit([c for c in candidates if c["queue"] == queue], min(max_results, quota))
    visit(candidates, max_results)
    return [c["id"] for c in kept]


BASES = [
    "users cannot reach the billing page since monday morning",
    "users cannot reach the billing page since tuesday morning",
    "printer on the second floor is out of paper",
    "",
    "ééé",
    "login fails",
    "login fail",
    "x" * 150 + " the connection pool is exhausted " + "y" * 150,
    "x" * 150 + " the connection pool is exhausted " + "y" * 149,
    "abcdefgh" * 50,
    "bcdefgha" * 50,
]


@pytest.mark.parametrize("max_results, quota", [(3, 2), (2, 2), (1, 2), (5, 0)])
def test_selection_matches_plain_greedy(spark, max_results, quota):
    rng = random.Random(max_results * 10 + quota)
    groups = {}
    for g in range(60):
        groups[g] = [
            {"id": f"d{g}-{i}", "text": rng.choice(BASES) + rng.choice(["", "!", " now"]),
             "queue": rng.choice(["A", "B"]), "score": rng.random()}
            for i in range(rng.randint(1, 9))
        ]
        groups[g].sort(key=lambda c: c["score"])
    queues = {g: rng.choice(["A", "B", "", None, "C"]) for g in groups}
    kb = spark.createDataFrame(
        [(c["id"], c["text"], "r", "T", c["queue"], "LOW", [], "") for cs in groups.values() for c in cs],
        KB_KINDS,
    )
    hits = spark.createDataFrame(
        [(g, c["id"], c["score"], i + 1) for g, cs in groups.items() for i, c in enumerate(cs)],
        "query_id long, doc_id string, distance double, rank int",
    )
    # Boosts move same-queue rows up; the plain greedy sees the reranked order.
    tickets = spark.createDataFrame(
        [(g, "i", "none", queues[g], "none", g) for g in groups],
        "ticket_id long, issue string, type string, queue string, ml_priority string, query_key long",
    )
    found = T.attach_candidates(tickets, T.retrieve_candidates(None, kb, hits=hits))
    found = found.withColumn("reranked", ranking.rerank("candidates", "repeats", "queue", "type", "ml_priority"))
    found = found.withColumn("evidence", ranking.select_from("reranked", "queue", max_results, quota))
    for row in found.select("ticket_id", "queue", "reranked", "evidence").collect():
        ordered = [
            {"id": c.doc_id, "text": c.issue_description, "queue": c.queue} for c in row.reranked
        ]
        want = plain_greedy(ordered, row.queue, max_results, quota, 0.88)
        assert [c.doc_id for c in row.evidence] == want


def test_comparer_matches_plain_ratio():
    rng = random.Random(5)
    letters = "abcdefghij klmnop"
    for _ in range(40):
        base = "".join(rng.choice(letters) for _ in range(rng.choice([5, 40, 250, 600])))
        texts = [base, ""]
        for _ in range(5):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 6))):
                t[rng.randrange(len(t))] = rng.choice(letters)
            texts.append("".join(t))
        got = similarity._Comparer(0.88).repeats(texts)
        for i, a in enumerate(texts):
            want = [
                j + 1
                for j, b in enumerate(texts)
                if i != j and a and b and SequenceMatcher(None, a, b).ratio() >= 0.88
            ]
            assert got[i] == want


def test_ratio_keeps_the_popular_letter_rule(spark):
    a, b = "abcdefghijkl" * 31, "bcdefghijkla" * 31
    df = spark.createDataFrame([(a, b), ("Same  text", "same text!"), (None, "x")], "a string, b string")
    rows = df.select(
        similarity.text_similarity_ratio("a", "b").alias("r"),
        similarity.is_near_duplicate("a", "b").alias("d"),
    ).collect()
    assert rows[0].r == SequenceMatcher(None, a, b).ratio() and not rows[0].d
    assert rows[1].r == 1.0 and rows[1].d and not rows[2].d


EVIDENCE = "array<struct<doc_id: string, queue: string, priority: string, distance: double>>"


def assess(spark, evidence, predicted, queue="Q", guardrail=True):
    df = spark.createDataFrame([(evidence, predicted, queue)], f"e {EVIDENCE}, p string, q string")
    df = df.withColumn("s", voting.evidence_stats("e", "q"))
    return df.select(
        voting.confidence_score("s", "p").alias("score"),
        voting.recommend_priority("s", "p", guardrail).alias("priority"),
        "s.majority_priority",
    ).first()


@pytest.mark.parametrize(
    "evidence, predicted, score, priority",
    [
        ([], "HIGH", 0.20, "HIGH"),
        ([("a", "Q", "LOW", 0.9)], "LOW", 0.40, "LOW"),
        ([("a", "X", "LOW", 0.64), ("b", "X", "LOW", 0.64)], "LOW", 0.75, "LOW"),
        ([("a", "Q", "LOW", 0.7), ("b", "Q", "LOW", 0.7)], "MEDIUM", 0.65, "LOW"),
        ([("a", "Q", "LOW", 0.79), ("b", "Q", "HIGH", 0.79)], "HIGH", 0.35, "HIGH"),
        ([("a", "Q", "LOW", 0.8), ("b", "Q", "HIGH", 0.8)], "LOW", 0.55, "LOW"),
        ([("a", "Q", None, 0.1), ("b", "Q", None, 0.1)], "LOW", 0.70, "LOW"),
        ([("a", "Q", "LOW", 0.1), ("b", "Q", "HIGH", 0.65)], "HIGH", 0.45, "MEDIUM"),
        ([("a", "Q", "HIGH", 0.1), ("b", "Q", "HIGH", 0.1)], "HIGH", 1.0, "HIGH"),
    ],
)
def test_voting(spark, evidence, predicted, score, priority):
    row = assess(spark, evidence, predicted)
    assert (row.score, row.priority) == (score, priority)


def test_tie_goes_to_first_seen(spark):
    row = assess(spark, [("a", "Q", "MEDIUM", 0.9), ("b", "Q", "HIGH", 0.9), ("c", "Q", "LOW", 0.9)], "LOW")
    assert row.majority_priority == "MEDIUM" and row.priority == "LOW"


def test_serialized_defaults(spark):
    df = spark.sql(
        """SELECT named_struct('doc_id', 'd', 'type', null, 'queue', null, 'priority', null,
          'distance', cast(null AS double), 'adjusted_score', cast(null AS double), 'tags', null,
          'issue_description', null, 'resolution', null, 'rank', 1, 'retrieval_text', '') AS c"""
    ).select(ranking.serialize_incident(F.col("c").cast(
        "struct<doc_id: string, type: string, queue: string, priority: string, distance: double, "
        "adjusted_score: double, tags: array<string>, issue_description: string, "
        "resolution: string, rank: int, retrieval_text: string>")).alias("s"))
    s = df.first().s
    assert (s.distance, s.adjusted_score, s.tags) == (0.0, 0.0, [])


def test_digests_stand_for_equal_texts(spark):
    """Where only equal texts repeat each other, no text travels; empty and missing texts repeat nobody."""
    from caseloom.operators.retrieval import retrieved_incidents

    said = ["One thing " * 40, "one  THING " * 40, "...", "!", None, "another"]
    kb = spark.createDataFrame(
        [(f"d{i}", t, "r", "INCIDENT", "Q", "HIGH", ["x"], t) for i, t in enumerate(said)], KB_KINDS
    )
    hits = spark.createDataFrame(
        [(1, f"d{i}", i / 10.0, i + 1) for i in range(len(said) + 2)],
        "query_id long, doc_id string, distance double, rank int",
    )
    found = {d: retrieved_incidents(hits, kb, digests=d) for d in (False, True)}
    assert found[True].agg(F.max(F.length("normalized"))).first()[0] == 64
    plain, short = (ranking.candidates_per_query(f, 1.0, with_texts=False).first() for f in found.values())
    assert plain == short and short.repeats == [[2], [1], [], [], [], [], [], []]
